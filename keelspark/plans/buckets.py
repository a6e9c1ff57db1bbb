"""Queries over hash buckets, seen sets, bitmaps and indexes."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import hashing as H
from ..functions import sizes as S
from ..operators import buckets as B
from ..operators import seen as N
from ..sources.tables import table
from . import sqltext as T
from .registry import query

_ID = "'order-' || o_orderkey"


def _id():
    return F.concat(F.lit("order-"), "o_orderkey")


@query("fnv1a_hash", f"SELECT o_orderkey, {T.fnv1a('id')} AS h, {T.fnv1a('name')} AS h_text FROM (SELECT o_orderkey, {_ID} AS id, CASE WHEN o_orderkey % 7 = 0 THEN '' ELSE o_orderpriority || 'é€' END AS name FROM orders)")
def fnv1a_hash(spark, d):
    name = F.when(F.col("o_orderkey") % 7 == 0, "").otherwise(F.concat("o_orderpriority", F.lit("é€")))
    return table(spark, d, "orders").select("o_orderkey", H.fnv1a(_id()).alias("h"), H.fnv1a(name).alias("h_text"))


@query("hash52", f"SELECT o_orderkey, {T.hash52('id')} AS h FROM (SELECT o_orderkey, {_ID} AS id FROM orders)")
def hash52(spark, d):
    return table(spark, d, "orders").select("o_orderkey", H.hash52(_id()).alias("h"))


@query("shard_count", "SELECT capacity, CAST(CASE WHEN need <= 1 THEN 1 ELSE pow(2, length(bin(need - 1))) END AS BIGINT) AS shards FROM (SELECT capacity, CAST(ceil(capacity / 124.0) AS BIGINT) AS need FROM (SELECT DISTINCT CAST(l_orderkey * l_linenumber % 20000 AS BIGINT) AS capacity FROM lineitem))")
def shard_count(spark, d):
    return table(spark, d, "lineitem").select((F.col("l_orderkey") * F.col("l_linenumber") % 20000).alias("capacity")).distinct().select("capacity", H.shard_count(F.col("capacity")).alias("shards"))


@query("shard_route", f"SELECT o_orderkey, h % 128 AS shard, h % 162 AS cache_shard, h % 62 AS seen_shard, {T.fnv1a('substr(id, 1, 8)')} % 128 AS prefix_shard FROM (SELECT o_orderkey, id, {T.fnv1a('id')} AS h FROM (SELECT o_orderkey, {_ID} AS id FROM orders))")
def shard_route(spark, d):
    return table(spark, d, "orders").select("o_orderkey", _id().alias("id")).withColumn("h", H.fnv1a(F.col("id"))).select("o_orderkey", F.pmod("h", F.lit(128)).alias("shard"), F.pmod("h", F.lit(162)).alias("cache_shard"), F.pmod("h", F.lit(62)).alias("seen_shard"), H.route(F.substring("id", 1, 8), 128).alias("prefix_shard"))


@query("shard_counts", f"SELECT {T.fnv1a('id')} % 64 AS shard, count(*) AS n FROM (SELECT {_ID} AS id FROM orders) GROUP BY 1")
def shard_counts(spark, d):
    return table(spark, d, "orders").groupBy(H.route(_id(), 64).alias("shard")).agg(F.count("*").alias("n"))


@query("shard_total", "SELECT count(*) AS n FROM orders")
def shard_total(spark, d):
    return shard_counts(spark, d).agg(F.sum("n").alias("n"))


@query("shard_width_sweep", f"""SELECT width, ttl, CAST(ceil(n * 1.0 / width) AS BIGINT) AS shards, {T.size_class('(ceil(n * 1.0 / ceil(n * 1.0 / width)) * (entry + CASE WHEN ttl THEN 8 ELSE 0 END) + 7)')} AS shard_class
FROM (SELECT count(*) AS n, CAST(floor(avg(16 + 2 + strlen(o_orderpriority)) + 0.5) AS BIGINT) AS entry FROM orders), (SELECT unnest([96, 112, 120, 124, 128, 144, 160, 176, 192, 224, 240, 256]) AS width), (VALUES (true), (false)) t(ttl)""")
def shard_width_sweep(spark, d):
    base = table(spark, d, "orders").agg(F.count("*").alias("n"), S.js_round(F.avg(F.lit(18) + F.octet_length("o_orderpriority"))).alias("entry"))
    grid = base.select("*", F.explode(F.array(*map(F.lit, (96, 112, 120, 124, 128, 144, 160, 176, 192, 224, 240, 256)))).alias("width")).select("*", F.explode(F.array(F.lit(True), F.lit(False))).alias("ttl"))
    shards = F.ceil(F.col("n") / F.col("width"))
    per = F.ceil(F.col("n") / shards)
    return grid.select("width", "ttl", shards.cast("long").alias("shards"), S.size_class(per * (F.col("entry") + F.when(F.col("ttl"), 8).otherwise(0)) + 7).alias("shard_class"))


_SPLIT = f"SELECT h % 32 AS old_bucket, h % 64 AS new_bucket FROM (SELECT {T.fnv1a('id')} AS h FROM (SELECT {_ID} AS id FROM orders))"


@query("cache_fields", f"SELECT o_orderkey, lower(printf('%08x', {T.fnv1a('id')}) || rpad(hex(substr(id, 1, 12)), 24, '0')) AS field, lower(printf('%08x', {T.fnv1a('id')}) || printf('%08x', {T.fnv1a("(id || 'salt')")})) AS agent_field FROM (SELECT o_orderkey, {_ID} AS id FROM orders)")
def cache_fields(spark, d):
    return table(spark, d, "orders").select("o_orderkey", F.lower(F.hex(H.cache_field(_id()))).alias("field"), F.lower(F.hex(H.agent_field(_id()))).alias("agent_field"))


_TAGGED = "CASE o_orderkey % 3 WHEN 0 THEN 'run:{' || (o_custkey % 50) || '}:' || o_orderkey WHEN 1 THEN 'x{}:{' || o_custkey || '}' ELSE 'plain:' || o_orderkey END"


@query("tag_colocation", f"SELECT slot, count(*) AS n, count(DISTINCT tag) AS tags FROM (SELECT tag, {T.fnv1a('tag')} % 64 AS slot FROM (SELECT CASE WHEN regexp_extract(key, '^[^{{]*[{{]([^}}]+)[}}]', 1) <> '' THEN regexp_extract(key, '^[^{{]*[{{]([^}}]+)[}}]', 1) ELSE key END AS tag FROM (SELECT {_TAGGED} AS key FROM orders))) GROUP BY slot")
def tag_colocation(spark, d):
    """Keys by the slot of their tag: empty braces are none, so such a key is placed by its whole name."""
    key = F.expr(_TAGGED)
    rows = B.slotted(table(spark, d, "orders").select(key.alias("key")), F.col("key"), 64)
    return rows.groupBy("slot").agg(F.count("*").alias("n"), F.count_distinct(B.hash_tag(F.col("key"))).alias("tags"))


@query("reshard_moves", f"SELECT old_bucket, count(*) AS total, sum(CASE WHEN new_bucket = old_bucket THEN 1 ELSE 0 END) AS stayed, sum(CASE WHEN new_bucket <> old_bucket THEN 1 ELSE 0 END) AS moved, sum(CASE WHEN new_bucket NOT IN (old_bucket, old_bucket + 32) THEN 1 ELSE 0 END) AS strays FROM ({_SPLIT}) GROUP BY old_bucket")
def reshard_moves(spark, d):
    return B.moves(table(spark, d, "orders"), _id(), 5)


@query("reshard_grow", f"SELECT g + 1 AS generation, sum(CASE WHEN h % CAST(pow(2, g) AS BIGINT) <> h % CAST(pow(2, g + 1) AS BIGINT) THEN 1 ELSE 0 END) AS moved, count(*) AS total FROM (SELECT {T.fnv1a('id')} AS h FROM (SELECT {_ID} AS id FROM orders)), (SELECT unnest([5, 6, 7]) AS g) GROUP BY g")
def reshard_grow(spark, d):
    return B.grow(table(spark, d, "orders"), _id(), 5, 8)


@query("generation_marker", "SELECT m AS marker, CAST(split_part(m, ':', 1) AS INTEGER) AS k, CASE WHEN contains(m, ':') THEN CAST(split_part(m, ':', 2) AS INTEGER) END AS prev FROM (SELECT DISTINCT CASE WHEN r_regionkey % 2 = 0 THEN CAST(r_regionkey + 5 AS VARCHAR) ELSE (r_regionkey + 5) || ':' || (r_regionkey + 4) END AS m FROM region)")
def generation_marker(spark, d):
    r = F.col("r_regionkey")
    marks = table(spark, d, "region").select(F.when(r % 2 == 0, (r + 5).cast("string")).otherwise(F.concat_ws(":", r + 5, r + 4)).alias("marker")).distinct()
    k, prev = B.parse_generation(F.col("marker"))
    return marks.select("marker", k.alias("k"), prev.alias("prev"))


@query("mget_ordered", "SELECT r.pos, r.id, o.o_orderpriority AS value FROM (SELECT unnest([5, 1, 5, 999999999, 7, 1, 888888888, 3]) AS id, generate_subscripts([5, 1, 5, 999999999, 7, 1, 888888888, 3], 1) - 1 AS pos) r LEFT JOIN orders o ON o.o_orderkey = r.id")
def mget_ordered(spark, d):
    ids = F.array(*[F.lit(i).cast("long") for i in (5, 1, 5, 999999999, 7, 1, 888888888, 3)])
    asked = spark.range(1).select(F.posexplode(ids).alias("pos", "id"))
    return B.mget(asked, table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("value"))).orderBy("pos")


@query("dual_home_read", f"""SELECT home, count(*) AS n, count(value) AS found FROM (
SELECT CASE WHEN b >= 32 AND o_orderkey % 2 = 0 THEN 'new' ELSE 'old' END AS home, o_orderpriority AS value FROM (SELECT *, {T.fnv1a('id')} % 64 AS b FROM (SELECT *, {_ID} AS id FROM orders))) GROUP BY home""")
def dual_home_read(spark, d):
    rows = B.split(table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("value"), _id().alias("key")), F.col("key"), 5)
    gone = (F.col("new_bucket") != F.col("old_bucket")) & (F.col("id") % 2 == 0)
    return B.dual_home(rows.select("id"), rows.where(gone), rows.where(~gone)).groupBy("home").agg(F.count("*").alias("n"), F.count("value").alias("found"))


@query("upsert_latest", "SELECT user_id, event_type, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn = 1")
def upsert_latest(spark, d):
    rows = table(spark, d, "events").select("user_id", "event_type", "ts", "event_id", "value")
    return B.upsert(rows, ["user_id", "event_type"], ["ts", "event_id"]).select("user_id", "event_type", "event_id", "value")


@query("delete_anti", "SELECT o_orderstatus, count(*) AS n FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING') GROUP BY 1")
def delete_anti(spark, d):
    gone = table(spark, d, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"))
    return B.delete(table(spark, d, "orders"), gone, "o_custkey").groupBy("o_orderstatus").agg(F.count("*").alias("n"))


@query("keyspace_set_operations", "SELECT (SELECT count(*) FROM (SELECT o_custkey FROM orders INTERSECT SELECT c_custkey FROM customer)) AS both, (SELECT count(*) FROM (SELECT c_custkey FROM customer EXCEPT SELECT o_custkey FROM orders)) AS idle, (SELECT count(*) FROM (SELECT c_custkey FROM customer UNION SELECT o_custkey FROM orders)) AS either")
def keyspace_set_operations(spark, d):
    o, c = table(spark, d, "orders").select(F.col("o_custkey").alias("id")), table(spark, d, "customer").select(F.col("c_custkey").alias("id"))
    sides = o.select("id", F.lit(1).alias("side")).unionByName(c.select("id", F.lit(2).alias("side"))).groupBy("id").agg(F.bit_or("side").alias("sides"))
    return sides.agg(F.count_if(F.col("sides") == 3).alias("both"), F.count_if(F.col("sides") == 2).alias("idle"), F.count("*").alias("either"))


@query("first_seen", "SELECT event_id, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) = 1 AS added FROM events")
def first_seen(spark, d):
    return N.first_seen(table(spark, d, "events"), ["user_id", "event_type"], ["ts", "event_id"]).select("event_id", "added")


@query("distinct_exact", "SELECT o_orderpriority, count(DISTINCT o_custkey) AS customers FROM orders GROUP BY 1")
def distinct_exact(spark, d):
    return table(spark, d, "orders").groupBy("o_orderpriority").agg(F.count_distinct("o_custkey").alias("customers"))


@query("distinct_hash52", f"SELECT count(DISTINCT {T.hash52('id')}) AS hashes, count(DISTINCT id) AS ids FROM (SELECT 'c' || o_custkey AS id FROM orders)")
def distinct_hash52(spark, d):
    ids = table(spark, d, "orders").select(F.concat(F.lit("c"), "o_custkey").alias("id")).distinct()
    return ids.agg(F.count_distinct(H.hash52(F.col("id"))).alias("hashes"), F.count("id").alias("ids"))


_HLL = f"""registers AS (SELECT o_orderpriority, {T.digest_bits('o_custkey', 1, 3)} % 1024 AS register, max(CASE WHEN {T.digest_bits('o_custkey', 4, 10)} = 0 THEN 41 ELSE 41 - length(bin({T.digest_bits('o_custkey', 4, 10)})) END) AS rank FROM orders GROUP BY 1, 2),
sums AS (SELECT o_orderpriority, 1024 - count(*) AS empty, sum(pow(2.0, -rank)) AS s FROM registers GROUP BY 1),
raw AS (SELECT *, {0.7213 / (1 + 1.079 / 1024) * 1024 * 1024!r}::DOUBLE / (s + empty) AS raw FROM sums),
guess AS (SELECT o_orderpriority, CASE WHEN raw <= 2560 AND empty > 0 THEN 1024.0::DOUBLE * ln(1024.0::DOUBLE / empty) ELSE raw END AS estimate FROM raw)"""


@query("distinct_hll", f"WITH {_HLL}, truth AS (SELECT o_orderpriority, count(DISTINCT o_custkey) AS customers FROM orders GROUP BY 1) SELECT o_orderpriority, customers, round(estimate, 3) AS estimate, round(100 * (estimate - customers) / customers, 3) AS error_percent FROM guess JOIN truth USING (o_orderpriority)")
def distinct_hll(spark, d):
    rows = table(spark, d, "orders").select("o_orderpriority", "o_custkey")
    guess = N.hll_estimate(N.hll_registers(rows, ["o_orderpriority"], "o_custkey"), ["o_orderpriority"])
    both = guess.join(rows.groupBy("o_orderpriority").agg(F.count_distinct("o_custkey").alias("customers")), "o_orderpriority")
    return both.select("o_orderpriority", "customers", F.round("estimate", 3).alias("estimate"), F.round((F.col("estimate") - F.col("customers")) * 100 / F.col("customers"), 3).alias("error_percent"))


@query("distinct_hll_builtin", "SELECT o_orderpriority, count(DISTINCT o_custkey) AS customers, true AS within FROM orders GROUP BY 1")
def distinct_hll_builtin(spark, d):
    """The engine's own sketch, within three per cent."""
    rows = table(spark, d, "orders").groupBy("o_orderpriority").agg(F.hll_sketch_estimate(F.hll_sketch_agg("o_custkey", F.lit(14))).alias("guess"), F.count_distinct("o_custkey").alias("customers"))
    return rows.select("o_orderpriority", "customers", (F.abs(F.col("guess") - F.col("customers")) <= 0.03 * F.col("customers") + 2).alias("within"))


_SEEN_WIDTH = 244


@query("seen_buckets", f"""WITH ids AS (SELECT DISTINCT 'u' || user_id AS id FROM events), told AS (SELECT DISTINCT {T.hash52('id')} AS h FROM ids), shards AS (SELECT greatest(1, CAST(ceil(count(id) / {_SEEN_WIDTH}.0) AS BIGINT)) AS n FROM ids)
SELECT h % n AS bucket, count(h) AS members, CAST(sum(h) % 1000000007 AS BIGINT) AS digest, string_agg(CAST(h AS VARCHAR), ' ' ORDER BY h) AS added FROM told, shards GROUP BY 1""")
def seen_buckets(spark, d):
    """What a bulk add sends to each shard: as many shards as the number of ids needs at 244 to a shard, each with its members."""
    ids = table(spark, d, "events").select(F.concat(F.lit("u"), "user_id").alias("id")).distinct()
    shards = ids.agg(F.greatest(F.lit(1), F.ceil(F.count("id") / _SEEN_WIDTH)).alias("n"))
    told = ids.select(H.hash52(F.col("id")).alias("h")).distinct().crossJoin(F.broadcast(shards))
    # a long holds the sum of some 4,000 hashes only
    digest = F.pmod(F.sum(F.col("h").cast("decimal(28,0)")), F.lit(1000000007).cast("decimal(10,0)")).cast("long")
    added = F.when(F.count("h") > 0, F.array_join(F.transform(F.array_sort(F.collect_list("h")), lambda h: h.cast("string")), " "))
    return told.groupBy(F.pmod("h", "n").alias("bucket")).agg(F.count("h").alias("members"), digest.alias("digest"), added.alias("added"))


@query("seen_has", "SELECT c_custkey, c_custkey IN (SELECT o_custkey FROM orders) AS has FROM customer")
def seen_has(spark, d):
    seen = table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey")).distinct().withColumn("has", F.lit(True))
    return table(spark, d, "customer").select("c_custkey").join(seen, "c_custkey", "left").select("c_custkey", F.coalesce("has", F.lit(False)).alias("has"))


def _bloom(spark, d, p=0.01):
    docs = table(spark, d, "documents").select("doc_id").distinct()
    members = docs.where("doc_id % 2 = 0")
    m, k = N.bloom_size(members.count(), p)
    return docs, members, N.bloom_probe(docs, "doc_id", N.bloom(members, "doc_id", m, k), m, k)


def _bloom_sql(members: str) -> str:
    """told: the filter by its definition, bit by bit."""
    at = f"({T.digest_bits('doc_id', 1, 10)} + i * {T.digest_bits('doc_id', 11, 10)}) % m"
    return f"""ids AS (SELECT DISTINCT doc_id FROM documents), size AS (SELECT CAST(greatest(64, ceil(-count(*) * ln(0.01) / (ln(2) * ln(2)))) AS BIGINT) AS m, greatest(1, CAST(round_even(greatest(64, ceil(-count(*) * ln(0.01) / (ln(2) * ln(2)))) / greatest(count(*), 1) * ln(2), 0) AS BIGINT)) AS k FROM ids WHERE {members}),
bits AS (SELECT doc_id, {at} AS bit FROM (SELECT doc_id, m, unnest(range(0, k)) AS i FROM ids, size)),
held AS (SELECT bit, count(DISTINCT doc_id) AS n FROM bits WHERE {members} GROUP BY bit)"""


@query("bloom_fp_rate", f"""WITH {_bloom_sql('doc_id % 2 = 0')}, told AS (SELECT doc_id, bool_and(n IS NOT NULL) AS maybe FROM bits LEFT JOIN held USING (bit) GROUP BY doc_id)
SELECT sum(CASE WHEN doc_id % 2 = 0 THEN 1 ELSE 0 END)::BIGINT AS members, sum(CASE WHEN doc_id % 2 = 0 AND NOT maybe THEN 1 ELSE 0 END)::BIGINT AS misses, sum(CASE WHEN doc_id % 2 = 1 THEN 1 ELSE 0 END)::BIGINT AS absent, sum(CASE WHEN doc_id % 2 = 1 AND maybe THEN 1 ELSE 0 END)::BIGINT AS false_positives FROM told""")
def bloom_fp_rate(spark, d):
    _, _, told = _bloom(spark, d)
    odd = F.col("doc_id") % 2 == 1
    return told.agg(F.count_if(~odd).alias("members"), F.count_if(~odd & ~F.col("maybe")).alias("misses"), F.count_if(odd).alias("absent"), F.count_if(odd & F.col("maybe")).alias("false_positives"))


@query("bloom_prefilter", "SELECT doc_id FROM documents WHERE doc_id % 2 = 0 GROUP BY 1")
def bloom_prefilter(spark, d):
    _, members, told = _bloom(spark, d)
    return told.where("maybe").select("doc_id").join(members, "doc_id", "left_semi")


@query("counting_filter", f"""WITH {_bloom_sql('true')}, after AS (SELECT DISTINCT bit FROM bits WHERE doc_id % 3 <> 0), told AS (SELECT doc_id, bool_and(a.bit IS NOT NULL) AS maybe FROM bits LEFT JOIN after a USING (bit) GROUP BY doc_id)
SELECT doc_id % 3 = 0 AS deleted, count(*) AS n, sum(CASE WHEN maybe THEN 1 ELSE 0 END)::BIGINT AS held FROM told GROUP BY 1""")
def counting_filter(spark, d):
    """Every third member deleted, then all asked: those left are held, those deleted are not, but for false positives."""
    docs = table(spark, d, "documents").select("doc_id").distinct()
    m, k = N.bloom_size(docs.count(), 0.01)
    left = N.counting_without(N.counting_filter(docs, "doc_id", m, k), docs.where("doc_id % 3 = 0"), "doc_id", m, k)
    told = N.counting_probe(docs, "doc_id", left, m, k)
    return told.groupBy((F.col("doc_id") % 3 == 0).alias("deleted")).agg(F.count("*").alias("n"), F.count_if(F.col("maybe")).alias("held"))


_CUCKOO = f"""marks AS (SELECT o_orderkey, {T.digest_bits('o_orderkey', 1, 4)} AS mark, {T.digest_bits('o_orderkey', 5, 10)} % 64 AS a FROM orders),
slots AS (SELECT o_orderkey, mark, least(a, b) AS low, greatest(a, b) AS high FROM (SELECT *, (64 + {T.digest_bits('mark', 1, 10)} % 64 - a) % 64 AS b FROM marks)),
held AS (SELECT DISTINCT low, high, mark FROM slots WHERE o_orderkey % 2 = 0 AND o_orderkey % 3 <> 0)"""


@query("cuckoo_membership", f"WITH {_CUCKOO} SELECT o_orderkey % 2 AS odd, o_orderkey % 3 = 0 AS third, count(*) AS n, count(h.mark) AS held FROM slots s LEFT JOIN held h USING (low, high, mark) GROUP BY 1, 2")
def cuckoo_membership(spark, d):
    """Even keys are members, those divisible by three are deleted again; few buckets, so that false positives show."""
    keys = table(spark, d, "orders").select("o_orderkey")
    even = keys.where("o_orderkey % 2 = 0")
    left = N.cuckoo_without(N.cuckoo_table(even, "o_orderkey", 64), even.where("o_orderkey % 3 = 0"), "o_orderkey", 64)
    told = N.cuckoo_has(keys, "o_orderkey", left, 64)
    return told.groupBy((F.col("o_orderkey") % 2).alias("odd"), (F.col("o_orderkey") % 3 == 0).alias("third")).agg(F.count("*").alias("n"), F.count_if(F.col("maybe")).alias("held"))


@query("bitmap_tag_counts", "SELECT l_returnflag || l_linestatus AS tag, count(DISTINCT l_orderkey) AS n FROM lineitem GROUP BY 1")
def bitmap_tag_counts(spark, d):
    rows = table(spark, d, "lineitem").select(F.concat("l_returnflag", "l_linestatus").alias("tag"), "l_orderkey")
    return N.bitmap_sizes(N.tag_bitmap(rows, "tag", "l_orderkey"), "tag")


@query("bitmap_intersection", "SELECT count(*) AS n FROM (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R' INTERSECT SELECT l_orderkey FROM lineitem WHERE l_linestatus = 'O')")
def bitmap_intersection(spark, d):
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_returnflag", "l_linestatus")
    a = N.tag_bitmap(rows.where("l_returnflag = 'R'"), "l_returnflag", "l_orderkey")
    b = N.tag_bitmap(rows.where("l_linestatus = 'O'"), "l_linestatus", "l_orderkey")
    return N.bitmap_both(a, b).agg(F.coalesce(F.sum(F.bitmap_count("bits")), F.lit(0)).alias("n"))


@query("range_shards", "SELECT shard, min(o_orderkey) AS low, max(o_orderkey) AS high, count(*) AS n FROM (SELECT o_orderkey, CAST(floor((row_number() OVER (ORDER BY o_orderkey) - 1) / 400) AS BIGINT) AS shard FROM orders WHERE o_orderstatus = 'P') GROUP BY shard")
def range_shards(spark, d):
    """Ranks without one task for all rows: sorted ranges are counted first, then numbered from the count before them."""
    from ..operators.ordering import global_rank

    ids = table(spark, d, "orders").where("o_orderstatus = 'P'").select("o_orderkey")
    return global_rank(ids, "o_orderkey").groupBy(F.floor((F.col("rank") - 1) / 400).alias("shard")).agg(F.min("o_orderkey").alias("low"), F.max("o_orderkey").alias("high"), F.count("*").alias("n"))


_TENANT = "o_custkey % 40 = 7"
_COUNTS = {"count_status": "o_orderstatus = 'P'", "count_tenant_status": f"{_TENANT} AND o_orderstatus = 'F'", "count_model_status": "o_orderpriority = '1-URGENT' AND o_orderstatus = 'P'", "count_expensive": "o_totalprice > 400000"}
for _name, _where in _COUNTS.items():
    query(_name, f"SELECT count(*) AS n FROM orders WHERE {_where}")(lambda spark, d, where=_where: table(spark, d, "orders").where(where).agg(F.count("*").alias("n")))


@query("index_scard_fanout", "SELECT o_orderstatus AS status, count(*) AS n, count(DISTINCT o_orderkey % 128) AS shards FROM orders GROUP BY 1")
def index_scard_fanout(spark, d):
    part = table(spark, d, "orders").groupBy(F.col("o_orderstatus").alias("status"), (F.col("o_orderkey") % 128).alias("bucket")).agg(F.count("*").alias("c"))
    return part.groupBy("status").agg(F.sum("c").alias("n"), F.count("*").alias("shards"))


@query("index_sintercard", "SELECT count(*) AS n FROM orders WHERE o_orderpriority = '2-HIGH' AND o_orderstatus = 'F'")
def index_sintercard(spark, d):
    rows = table(spark, d, "orders").select((F.col("o_orderkey") % 128).alias("bucket"), "o_orderkey", "o_orderpriority", "o_orderstatus")
    both = rows.where("o_orderpriority = '2-HIGH'").join(rows.where("o_orderstatus = 'F'").select("bucket", "o_orderkey"), ["bucket", "o_orderkey"], "left_semi")
    return both.groupBy("bucket").agg(F.count("*").alias("c")).agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"))


@query("index_zcount", "SELECT count(*) AS n FROM orders WHERE o_totalprice > 400000")
def index_zcount(spark, d):
    return table(spark, d, "orders").where("o_totalprice > 400000").groupBy((F.col("o_orderkey") % 128).alias("bucket")).agg(F.count("*").alias("c")).agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"))


@query("hybrid_index_doc", "SELECT o_custkey % 40 AS tenant, o_orderstatus AS status, o_orderpriority AS model, count(*) AS n, sum(CASE WHEN o_totalprice > 400000 THEN 1 ELSE 0 END) AS expensive FROM orders GROUP BY 1, 2, 3")
def hybrid_index_doc(spark, d):
    thin = table(spark, d, "orders").select((F.col("o_custkey") % 40).alias("tenant"), F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("model"), "o_totalprice")
    return thin.groupBy("tenant", "status", "model").agg(F.count("*").alias("n"), F.count_if(F.col("o_totalprice") > 400000).alias("expensive"))


@query("thread_list", "SELECT conv_id, CAST(floor(turn / 64) AS BIGINT) AS page, string_agg(role || '#' || turn, ',' ORDER BY turn) AS turns, count(*) AS n FROM conversations GROUP BY 1, 2")
def thread_list(spark, d):
    """Threads as lists, a page of 64 turns each, so that no list grows with its thread."""
    page = F.floor(F.col("turn") / 64)
    rows = table(spark, d, "conversations").groupBy("conv_id", page.alias("page")).agg(F.sort_array(F.collect_list(F.struct("turn", "role"))).alias("t"), F.count("*").alias("n"))
    return rows.select("conv_id", "page", F.array_join(F.transform("t", lambda x: F.concat(x["role"], F.lit("#"), x["turn"])), ",").alias("turns"), "n")


@query("chunk_seal", "SELECT conv_id, chunk, count(*) AS turns, CAST(sum(strlen(text)) AS BIGINT) AS bytes, (chunk + 1) * 4 <= max(n) AS sealed FROM (SELECT conv_id, text, CAST(floor((row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1) / 4) AS BIGINT) AS chunk, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations) GROUP BY conv_id, chunk")
def chunk_seal(spark, d):
    return B.chunks(table(spark, d, "conversations"), ["conv_id"], ["turn"], 4).groupBy("conv_id", "chunk", "sealed").agg(F.count("*").alias("turns"), F.sum(F.octet_length("text")).cast("long").alias("bytes"))


@query("index_consistency", """SELECT problem, count(*) AS n FROM (SELECT CASE WHEN o_orderkey % 101 = 0 THEN 'not indexed' WHEN o_orderkey % 97 = 0 AND o_orderstatus <> 'P' THEN 'stale' ELSE 'right' END AS problem FROM orders
  UNION ALL SELECT 'no record' FROM orders WHERE o_orderkey % 89 = 0) GROUP BY 1""")
def index_consistency(spark, d):
    """Records against an index that lags behind: some entries still under their old status, some missing, some of records that are gone."""
    state = table(spark, d, "orders").select("o_orderkey", F.col("o_orderstatus").alias("status"))
    old = F.when(F.col("o_orderkey") % 97 == 0, "P").otherwise(F.col("status"))
    index = state.where("o_orderkey % 101 <> 0").select("o_orderkey", old.alias("indexed"))
    index = index.unionByName(state.where("o_orderkey % 89 = 0").select((-1 - F.col("o_orderkey")).alias("o_orderkey"), F.col("status").alias("indexed")))
    joined = state.join(index, "o_orderkey", "full_outer")
    problem = F.when(F.col("indexed").isNull(), "not indexed").when(F.col("status").isNull(), "no record").when(F.col("status") != F.col("indexed"), "stale").otherwise("right")
    return joined.groupBy(problem.alias("problem")).agg(F.count("*").alias("n"))
