"""Queries over the keyspace."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import sizes as S
from ..operators import profile as P
from ..sources.keyspace import by_type, keyspace, sample_keyspace, workspace
from ..sources.shared import fresh_path
from ..sources.tables import json_sink, json_source, table
from . import sqltext as T
from .registry import query


@query("keyspace_inspect", f"WITH {T.KEYS} SELECT key, pattern, type, encoding, memory, ttl, size, substr(value, 1, 128) AS head FROM keys")
def keyspace_inspect(spark, d):
    return keyspace(spark, d).select("key", S.key_pattern(F.col("key")).alias("pattern"), "type", "encoding", "memory", "ttl", "size", F.substring("value", 1, 128).alias("head"))


@query("keyspace_sample", f"WITH {T.KEYS} SELECT key, type FROM keys ORDER BY key LIMIT 2000")
def keyspace_sample(spark, d):
    return sample_keyspace(keyspace(spark, d), 2000).select("key", "type")


@query("keyspace_by_type", f"WITH {T.KEYS} SELECT key, size, true AS complete FROM keys WHERE type = 'stream'")
def keyspace_by_type(spark, d):
    return by_type(keyspace(spark, d), "stream").select("key", "size", "complete")


@query("keyspace_by_type_bounded", f"WITH {T.KEYS} SELECT key, size, (SELECT count(*) FROM keys) <= 500 AS complete FROM (SELECT * FROM keys ORDER BY key LIMIT 500) WHERE type = 'hash'")
def keyspace_by_type_bounded(spark, d):
    """A scan that stops after 500 keys, as its feature is, and says whether it saw all."""
    return by_type(keyspace(spark, d), "hash", 500).select("key", "size", "complete")


_KEYS = ("'a:' || o_orderkey", "'run:{' || (o_orderkey % 16) || '}:' || o_custkey", "'x:' || substr(md5(CAST(o_orderkey AS VARCHAR)), 1, 12)", "'sess:' || md5(CAST(o_orderkey AS VARCHAR)) || ':v'", "'u:00000000-0000-4000-8000-' || lpad(CAST(o_orderkey AS VARCHAR), 12, '0')", "'t:' || o_orderpriority || ':-' || o_custkey")


@query("key_pattern", "SELECT pattern, count(*) AS n FROM (" + " UNION ALL ".join(f"SELECT {T.pattern(f'({k})')} AS pattern FROM orders" for k in _KEYS) + ") GROUP BY pattern")
def key_pattern(spark, d):
    keys = table(spark, d, "orders").select(F.explode(F.array(*[F.expr(k.replace("VARCHAR", "STRING")) for k in _KEYS])).alias("key"))
    return keys.groupBy(S.key_pattern(F.col("key")).alias("pattern")).agg(F.count("*").alias("n"))


@query("namespace_profile", f"""WITH {T.PROFILE},
histogram AS (SELECT pattern, string_agg(encoding || '=' || n, ',' ORDER BY encoding) AS encodings FROM (SELECT pattern, encoding, count(*) AS n FROM keys GROUP BY 1, 2) GROUP BY 1)
SELECT pattern, type, n, est_keys, round(avg_memory, 4) AS avg_memory, round(avg_bytes, 4) AS avg_bytes, round(ttl_coverage, 4) AS ttl_coverage, round(est_bytes, 4) AS est_bytes, encodings
FROM ns JOIN histogram USING (pattern) ORDER BY est_bytes DESC, pattern""")
def namespace_profile(spark, d):
    ns = P.namespaces(keyspace(spark, d))
    text = F.array_join(F.transform(F.map_entries("encodings"), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ",")
    shown = [F.round(c, 4).alias(c) if c in ("avg_memory", "avg_bytes", "ttl_coverage", "est_bytes") else F.col(c) for c in ("pattern", "type", "n", "est_keys", "avg_memory", "avg_bytes", "ttl_coverage", "est_bytes")]
    return ns.select(*shown, text.alias("encodings")).orderBy(F.desc("est_bytes"), "pattern")


@query("top_namespaces", f"WITH {T.PROFILE} SELECT pattern, round(est_bytes, 4) AS est_bytes, round(100 * est_bytes / sum(est_bytes) OVER (), 4) AS percent FROM ns ORDER BY est_bytes DESC, pattern LIMIT 8")
def top_namespaces(spark, d):
    ns = P.namespaces(keyspace(spark, d))
    total = ns.agg(F.sum("est_bytes").alias("total"))
    share = F.round(F.lit(100) * F.col("est_bytes") / F.col("total"), 4)
    return ns.crossJoin(F.broadcast(total)).select("pattern", F.round("est_bytes", 4).alias("est_bytes"), share.alias("percent")).orderBy(F.desc("est_bytes"), "pattern").limit(8)


_JSON = f"""{T.KEYS}, shape AS (
  SELECT pattern, count(*) AS parsed, sum(strlen(value)) AS total_bytes, sum(list_sum(list_transform(json_keys(value), lambda k: length(k) + 3))) AS name_bytes FROM keys WHERE substr(value, 1, 1) = '{{' GROUP BY pattern)"""


@query("json_field_tax", f"WITH {_JSON} SELECT pattern, parsed, CAST(total_bytes AS BIGINT) AS total_bytes, CAST(name_bytes AS BIGINT) AS name_bytes, round(100.0 * name_bytes / total_bytes, 4) AS percent FROM shape")
def json_field_tax(spark, d):
    shape = P.json_shape(keyspace(spark, d))
    return shape.select("pattern", "parsed", F.col("total_bytes").cast("long").alias("total_bytes"), F.col("name_bytes").cast("long").alias("name_bytes"), F.round(F.col("name_bytes") * 100.0 / F.col("total_bytes"), 4).alias("percent"))


@query("json_vector_detect", """SELECT CASE WHEN k = 0 THEN 'doubled' ELSE 'plain' END AS pattern, count(*) AS parsed, sum(CASE WHEN len(embedding) * (2 - k) >= 128 THEN 1 ELSE 0 END) AS arrays, max(CASE WHEN len(embedding) * (2 - k) >= 128 THEN len(embedding) * (2 - k) END) AS array_len
FROM embeddings, (VALUES (0), (1)) t(k) GROUP BY 1""")
def json_vector_detect(spark, d):
    vectors = table(spark, d, "embeddings")
    doubled = vectors.select(F.lit("doubled").alias("key"), F.to_json(F.concat("embedding", "embedding")).alias("value"))
    shape = P.json_shape(doubled.union(vectors.select(F.lit("plain"), F.to_json("embedding"))))
    return shape.select("pattern", "parsed", "arrays", "array_len")


@query("raw_vector_detect", f"WITH {T.PROFILE} SELECT pattern, CAST(floor(avg_bytes + 0.5) AS BIGINT) AS width, CAST(floor(avg_bytes + 0.5) / 4 AS BIGINT) AS dim, abs(least - floor(avg_bytes + 0.5)) < 4 AND abs(most - floor(avg_bytes + 0.5)) < 4 AS even FROM ns WHERE type = 'string' AND CAST(floor(avg_bytes + 0.5) AS BIGINT) % 4 = 0")
def raw_vector_detect(spark, d):
    wide = S.js_round(F.col("avg_bytes"))
    ns = P.namespaces(keyspace(spark, d)).where(F.col("type") == "string").withColumn("width", wide.cast("long")).where("width % 4 = 0")
    return ns.select("pattern", "width", (F.col("width") / 4).cast("long").alias("dim"), ((F.abs(F.col("least") - F.col("width")) < 4) & (F.abs(F.col("most") - F.col("width")) < 4)).alias("even"))


_N = "(SELECT CAST(l_orderkey * 37 % 9000 AS BIGINT) AS n FROM lineitem)"


@query("size_class", f"SELECT n, {T.size_class('n')} AS class, count(*) AS records FROM {_N} GROUP BY n")
def size_class(spark, d):
    rows = table(spark, d, "lineitem").select((F.col("l_orderkey") * 37 % 9000).alias("n")).groupBy("n").agg(F.count("*").alias("records"))
    return rows.select("n", S.size_class(F.col("n")).alias("class"), "records")


@query("string_waste", f"SELECT source, count(*) AS n, CAST(sum({T.waste('b')}) AS BIGINT) AS waste, max({T.waste('b')}) AS most FROM (SELECT source, strlen(text) AS b FROM documents) GROUP BY source")
def string_waste(spark, d):
    w = S.string_waste(F.octet_length("text"))
    return table(spark, d, "documents").groupBy("source").agg(F.count("*").alias("n"), F.sum(w).cast("long").alias("waste"), F.max(w).cast("long").alias("most"))


@query("embed_budget", "SELECT role, sum(CASE WHEN 16 + (length(k) + 3) + (4 + strlen(role)) <= 64 THEN 1 ELSE 0 END) AS fits, count(*) AS n FROM (SELECT role, 'conversation:' || conv_id || ':turn:' || turn AS k FROM conversations) GROUP BY role")
def embed_budget(spark, d):
    key = F.concat(F.lit("conversation:"), "conv_id", F.lit(":turn:"), "turn")
    fits = S.embeds(F.length(key), F.octet_length("role"))
    return table(spark, d, "conversations").groupBy("role").agg(F.count_if(fits).alias("fits"), F.count("*").alias("n"))


@query("fmt_bytes", """SELECT n, CASE WHEN n >= 1073741824 THEN printf('%.2f GiB', n / 1073741824.0) WHEN n >= 1048576 THEN printf('%.1f MiB', n / 1048576.0) WHEN n >= 1024 THEN printf('%.1f KiB', n / 1024.0) ELSE printf('%d B', n) END AS label
FROM (SELECT DISTINCT CAST(pow(3, k % 21) AS BIGINT) AS n FROM (SELECT CAST(l_linenumber + l_orderkey AS BIGINT) AS k FROM lineitem))""")
def fmt_bytes(spark, d):
    n = F.pow(F.lit(3.0), ((F.col("l_linenumber") + F.col("l_orderkey")) % 21).cast("double")).cast("long")
    return table(spark, d, "lineitem").select(n.alias("n")).distinct().select("n", S.fmt_bytes(F.col("n")).alias("label"))


_SHAPE = f"""{T.PROFILE}, shape AS (SELECT pattern, count(*) AS parsed, sum(list_sum(list_transform(json_keys(value), lambda k: length(k) + 3))) AS name_bytes FROM keys WHERE substr(value, 1, 1) = '{{' GROUP BY pattern),
lim AS (SELECT greatest(524288.0, sum(est_bytes) * 0.01) AS floor FROM ns),
pend AS (SELECT 'events:' || (user_id % 4) AS key, count(*) AS pending FROM events WHERE event_id % 3 = 0 GROUP BY 1),
found AS (
  SELECT 'critical' AS severity, 'allkeys-eviction' AS rule, 'config' AS subject, 0.0 AS saving FROM (SELECT sum(est_keys) AS k FROM ns WHERE ttl_coverage < 0.5 AND est_keys > 100) WHERE k > 0
  UNION ALL SELECT 'warning', 'maxmemory-unset', 'config', 0
  UNION ALL SELECT 'warning', 'snapshots-only', 'config', 0
  UNION ALL SELECT 'opportunity', 'key-overhead', pattern, s FROM (SELECT pattern, (CASE WHEN type = 'string' THEN greatest(0, avg_memory - {T.size_class(f"(avg_bytes + {T.sds('avg_bytes')} + 1)")}) ELSE 48 + {T.size_class("(avg_key_len + 4)")} END) * est_keys * (1 - 1 / 124.0) AS s FROM ns WHERE est_keys >= 10000 AND pattern NOT LIKE '%{{*}}%'), lim WHERE s >= floor
  UNION ALL SELECT 'opportunity', 'size-class-waste', pattern, avg_waste * est_keys FROM ns, lim WHERE type = 'string' AND est_keys >= 10000 AND avg_waste >= 16 AND avg_waste * est_keys >= floor
  UNION ALL SELECT 'opportunity', 'json-field-names', pattern, name_bytes * 1.0 / parsed * est_keys FROM ns JOIN shape USING (pattern), lim WHERE type = 'string' AND est_keys >= 1000 AND jsonish >= greatest(3, n * 0.5) AND name_bytes * 1.0 / parsed * est_keys >= floor
  UNION ALL SELECT 'opportunity', 'raw-vectors', pattern, (w - (w / 4 + 4)) * est_keys FROM (SELECT *, floor(avg_bytes + 0.5) AS w FROM ns) WHERE type = 'string' AND est_keys >= 1000 AND w IN (1024, 1536, 2048, 3072, 4096, 6144, 8192, 12288, 16384) AND abs(least - w) < 4 AND abs(most - w) < 4
  UNION ALL SELECT 'warning', 'pending-backlog', key, pending * 238.0 FROM (SELECT * FROM pend WHERE pending > {{pending}} ORDER BY key LIMIT 25))"""


def _pending(spark, d):
    return table(spark, d, "events").where("event_id % 3 = 0").groupBy(F.concat(F.lit("events:"), F.col("user_id") % 4).alias("key")).agg(F.count("*").alias("pending"))


@query("doctor_findings", f"WITH {_SHAPE.replace('{pending}', '500')} SELECT severity, rule, subject, CAST(floor(saving + 0.5) AS BIGINT) AS saving, row_number() OVER (ORDER BY CASE severity WHEN 'critical' THEN 0 WHEN 'warning' THEN 1 WHEN 'opportunity' THEN 2 ELSE 3 END, saving DESC, rule, subject) AS position FROM found")
def doctor_findings(spark, d):
    found = P.findings(spark, keyspace(spark, d), pending=_pending(spark, d), limits={"pending": 500})
    return P.rank(found).select("severity", "rule", "subject", S.js_round(F.col("saving")).cast("long").alias("saving"), "position")


@query("doctor_fix_plan", f"""WITH {T.PROFILE}
SELECT 'config' AS tier, 'maxmemory-policy: allkeys-lru -> volatile-ttl' AS action, 'config' AS subject FROM (SELECT sum(est_keys) AS k FROM ns WHERE ttl_coverage < 0.5 AND est_keys > 100) WHERE k > 0
UNION ALL SELECT 'refused', 'quantize vectors to int8', pattern FROM ns WHERE type = 'string' AND est_keys > 1000 AND floor(avg_bytes + 0.5) IN (1024, 1536, 2048, 3072, 4096, 6144, 8192, 12288, 16384)
UNION ALL SELECT 'refused', 'positional schema for JSON records', 'keyspace' FROM totals WHERE scanned > 0""")
def doctor_fix_plan(spark, d):
    return P.fix_plan(keyspace(spark, d))


@query("doctor_verdict", f"WITH {_SHAPE.replace('{pending}', '500')} SELECT (SELECT CAST(sum(memory) AS BIGINT) FROM keys) AS used_bytes, CAST(floor(sum(saving) + 0.5) AS BIGINT) AS saving_bytes, (SELECT sum(memory) FROM keys) < 2147483648 AND sum(saving) < 536870912 AS too_small, max(CASE WHEN severity = 'critical' THEN 1 ELSE 0 END) AS exit_code FROM found")
def doctor_verdict(spark, d):
    keys = keyspace(spark, d)
    return P.verdict(keys, P.findings(spark, keys, pending=_pending(spark, d), limits={"pending": 500}))


@query("doctor_report", f"WITH {_SHAPE.replace('{pending}', '500')} SELECT row_number() OVER (ORDER BY CASE severity WHEN 'critical' THEN 0 WHEN 'warning' THEN 1 WHEN 'opportunity' THEN 2 ELSE 3 END, saving DESC, rule, subject) AS position, severity, rule, subject, CAST(floor(saving + 0.5) AS BIGINT) AS saving FROM found")
def doctor_report(spark, d):
    """The findings as lines of JSON, written and read back: a report may be long, so no value holds all of it."""
    path = fresh_path(spark, "report")
    json_sink(doctor_findings(spark, d).repartition(1), path)
    return json_source(spark, path, "position bigint, severity string, rule string, subject string, saving bigint", lines=True)


#: settings under which the other rules hold: nothing persisted, unbounded clients, an old version; and a log that is not synced during rewrites
BARE = P.CONFIG | {"maxmemory-policy": "noeviction", "maxmemory": "1000000", "save": "", "version": "7.2"}
LOGGED = P.CONFIG | {"maxmemory-policy": "noeviction", "maxmemory": "1000000", "appendonly": "yes", "no-appendfsync-on-rewrite": "yes"}
_LOW = {"floor": 1000, "members": 50, "many": 50}
_WORK = f"""work AS (
  SELECT 'prof:' || c_custkey AS key, 'hash' AS type, 'hashtable' AS encoding, 20 AS size, {T.size_class(f"(20 + {T.sds('20')} + 1)")} + 24 + 16 + {T.size_class("(length('prof:' || c_custkey) + 4)")} + 8 + 20 * 64 AS memory FROM customer
  UNION ALL SELECT 'lat:' || event_type, 'zset', 'skiplist', count(*), count(*) * 88 + 96 FROM events GROUP BY event_type
  UNION ALL SELECT 'tags:' || (o_custkey % 500), 'set', 'hashtable', count(*), count(*) * 54 + 96 FROM orders GROUP BY o_custkey % 500),
wide AS (SELECT {T.pattern("key")} AS pattern, min(type) AS type, count(*) AS n, avg(memory) AS avg_memory, avg(size) AS avg_size, avg(length(key)) AS avg_key_len, avg(memory) * count(*) AS est_bytes FROM work GROUP BY 1),
lim AS (SELECT greatest(1000.0, sum(est_bytes) * 0.01) AS floor FROM wide),
found AS (
  SELECT 'opportunity' AS severity, 'key-overhead' AS rule, pattern AS subject, s AS saving FROM (SELECT pattern, (48 + {T.size_class("(avg_key_len + 4)")}) * n * (1 - 1 / 124.0) AS s FROM wide WHERE n >= 50), lim WHERE s >= floor
  UNION ALL SELECT 'opportunity', 'hashtable-hashes', pattern, 0 FROM wide WHERE type = 'hash' AND n >= 100 AND avg_size <= 512
  UNION ALL SELECT 'opportunity', 'integer-sets', pattern, 0 FROM wide WHERE type = 'set' AND n >= 100
  UNION ALL SELECT 'opportunity', 'sorted-set-series', pattern, s FROM (SELECT pattern, (avg_memory / avg_size - 2.6) * avg_size * n AS s FROM wide WHERE type = 'zset' AND avg_size >= 50 AND avg_memory / avg_size >= 20), lim WHERE s >= floor)"""
_ROUNDED = "SELECT severity, rule, subject, CAST(floor(saving + 0.5) AS BIGINT) AS saving FROM found"


def _rules(spark, d, config, **more):
    found = P.findings(spark, workspace(spark, d), config, limits=_LOW, **more)
    return found.select("severity", "rule", "subject", S.js_round(F.col("saving")).cast("long").alias("saving"))


@query("doctor_findings_bare", f"WITH {_WORK} {_ROUNDED} UNION ALL SELECT * FROM (VALUES ('critical', 'no-persistence', 'config', 0), ('warning', 'client-buffers', 'config', 0), ('info', 'partial-scan', 'config', 0), ('info', 'old-version', 'config', 0))")
def doctor_findings_bare(spark, d):
    return _rules(spark, d, BARE, complete=False)


@query("doctor_findings_logged", f"WITH {_WORK} {_ROUNDED} UNION ALL SELECT * FROM (VALUES ('warning', 'client-buffers', 'config', 0), ('warning', 'no-fsync-on-rewrite', 'config', 0)) UNION ALL SELECT 'opportunity', 'templates-available', 'config', 0 FROM (SELECT 1 FROM wide WHERE type = 'hash' AND n > 50 LIMIT 1)")
def doctor_findings_logged(spark, d):
    return _rules(spark, d, LOGGED)


@query("doctor_apply", f"WITH {_WORK} SELECT CAST(sum(memory) AS BIGINT) AS before, CAST(sum(memory) - 56 * 20 * sum(CASE WHEN type = 'hash' THEN 1 ELSE 0 END) AS BIGINT) AS after, CAST(56 * 20 * sum(CASE WHEN type = 'hash' THEN 1 ELSE 0 END) AS BIGINT) AS freed, sum(CASE WHEN type = 'hash' THEN 1 ELSE 0 END)::BIGINT AS rewritten, 'no 5%' AS settings FROM work")
def doctor_apply(spark, d):
    """The plan for the second keyspace, applied: bytes before and after, keys rewritten, two of the settings it changed."""
    keys = workspace(spark, d)
    after, settings = P.apply_plan(keys, P.fix_plan(keys, LOGGED), LOGGED)
    return P.freed(keys, after).withColumn("settings", F.lit(f"{settings['no-appendfsync-on-rewrite']} {settings['maxmemory-clients']}"))
