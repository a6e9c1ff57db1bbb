"""Keyspace profile and its rules: each rule is one relational expression over the profile, a configuration and the keys."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.sizes import js_round, key_pattern, looks_json, sds_header, size_class, string_waste
from ..sources.shared import saved
from .layouts import HASHTABLE, LISTPACK
from .ordering import numbered

RANK = {"critical": 0, "warning": 1, "opportunity": 2, "info": 3}
#: thresholds of the rules (fixed values), each a parameter
LIMITS = {"floor": 512 * 1024, "share": 0.01, "many": 10_000, "some": 1_000, "few": 100, "waste": 16, "names": 3, "probes": 12, "dims": 128, "members": 500, "per_member": 20.0, "series": 2.6, "pending": 1_000, "pending_bytes": 238, "fields": 512}
DIMS = (256, 384, 512, 768, 1024, 1536, 2048, 3072, 4096)
CONFIG = {"maxmemory-policy": "allkeys-lru", "maxmemory": "0", "appendonly": "no", "save": "3600 1", "no-appendfsync-on-rewrite": "no", "maxmemory-clients": "0", "hash-max-listpack-entries": "128", "hash-min-template-entries": "0", "version": "8.10"}


def namespaces(keys: DataFrame, dbsize: int | Column | None = None) -> DataFrame:
    """The profile: one row per pattern.  Without dbsize the sample is the whole keyspace.  One shuffle, on the pattern; the encoding
    histogram is a second partial aggregation over (pattern, encoding), a few rows each."""
    ints = F.col("int_members") if "int_members" in keys.columns else F.lit(False)
    rows = keys.withColumn("pattern", key_pattern(F.col("key"))).withColumn("_ints", ints)
    json = _json_columns()
    text = F.when(F.col("type") == "string", F.col("size")).otherwise(0)
    part = rows.groupBy("pattern", "encoding").agg(
        F.count("*").alias("n"), F.sum("memory").alias("memory"), F.sum(text).alias("bytes"), F.sum("size").alias("size"), F.count_if(F.col("ttl") > 0).alias("with_ttl"),
        F.min(F.struct("key", "type")).alias("first"), F.sum(F.length("key")).alias("key_len"), F.sum(F.when(F.col("type") == "string", string_waste(F.col("size")))).alias("waste"),
        F.min("size").alias("least"), F.max("size").alias("most"), F.count_if(looks_json(F.col("value"))).alias("jsonish"),
        F.count_if(F.col("_ints")).alias("int_sets"), *[c.alias(n) for n, c in json.items()],
    )
    whole = part.groupBy("pattern").agg(
        F.sum("n").alias("n"), F.sum("memory").alias("memory"), F.sum("bytes").alias("bytes"), F.sum("size").alias("size"), F.sum("with_ttl").alias("with_ttl"), F.min("first").alias("first"), F.sum("key_len").alias("key_len"), F.sum("waste").alias("waste"),
        F.min("least").alias("least"), F.max("most").alias("most"), F.sum("jsonish").alias("jsonish"), F.sum("int_sets").alias("int_sets"), *[(F.max(n) if n == "array_len" else F.sum(n)).alias(n) for n in json], F.map_from_entries(F.array_sort(F.collect_list(F.struct("encoding", "n")))).alias("encodings"),
    )
    # the total is one row; it joins instead of a window over all patterns, which would be one task's work
    scanned = F.col("scanned")
    size = scanned if dbsize is None else F.lit(dbsize) if isinstance(dbsize, int) else dbsize
    n = F.col("n")
    est = js_round(n / scanned * size).cast("long")
    return whole.crossJoin(F.broadcast(part.agg(F.sum("n").alias("scanned")))).select(
        "pattern", F.col("first.type").alias("type"), "n", est.alias("est_keys"), (F.col("memory") / n).alias("avg_memory"), F.when(F.col("first.type") == "string", F.col("bytes") / n).otherwise(0.0).alias("avg_bytes"), "encodings", (F.col("with_ttl") / n).alias("ttl_coverage"),
        (F.col("memory") / n * est).alias("est_bytes"), (F.col("size") / n).alias("avg_size"), (F.col("key_len") / n).alias("avg_key_len"), (F.col("waste") / n).alias("avg_waste"), "least", "most", "jsonish", "int_sets", *json,
    )


def _json_columns() -> dict[str, Column]:
    """parsed, total_bytes, name_bytes, arrays, array_len over the JSON among some values, as aggregates; a value is parsed only if it looks like JSON."""
    value = F.when(looks_json(F.col("value")), F.col("value"))
    items = F.from_json(F.when(value.startswith("["), value), "array<double>")
    named = F.coalesce(F.aggregate(F.json_object_keys(F.when(value.startswith("{"), value)), F.lit(0), lambda s, k: s + F.length(k) + 3), F.lit(0))
    numeric = F.coalesce((F.size(items) >= LIMITS["dims"]) & F.forall(items, lambda x: x.isNotNull()), F.lit(False))
    return {"parsed": F.count(value), "total_bytes": F.sum(F.octet_length(value)), "name_bytes": F.sum(F.when(value.isNotNull(), named)), "arrays": F.count_if(numeric), "array_len": F.max(F.when(numeric, F.size(items)))}


def json_shape(keys: DataFrame) -> DataFrame:
    """pattern, parsed, total_bytes, name_bytes, arrays, array_len over the JSON values of each pattern."""
    rows = keys.where(looks_json(F.col("value"))).select(key_pattern(F.col("key")).alias("pattern"), "value")
    return rows.groupBy("pattern").agg(*[c.alias(n) for n, c in _json_columns().items()])


def findings(spark: SparkSession, keys: DataFrame, config: dict[str, str] = CONFIG, pending: DataFrame | None = None, limits: dict | None = None, complete: bool = True) -> DataFrame:
    """severity, rule, subject, saving.  pending: key, pending per consumer group; complete: whether they come from all streams.  The keys are read
    once: what the rules need is one row for each pattern, in the shared folder."""
    lim = LIMITS | (limits or {})
    ns = saved(namespaces(keys), "profile")
    floor = ns.agg(F.greatest(F.lit(float(lim["floor"])), F.sum("est_bytes") * lim["share"]).alias("floor"))
    ns = ns.crossJoin(F.broadcast(floor))
    rules: list[DataFrame] = []
    cells: list[Column] = []

    def over(rule: str, severity: str, when: Column, saving: Column, material: bool = True) -> None:
        """A rule over one namespace; all of them are told in a single pass."""
        holds = when & (saving >= F.col("floor")) if material else when
        cells.append(F.when(holds, F.struct(F.lit(severity).alias("severity"), F.lit(rule).alias("rule"), F.col("pattern").alias("subject"), saving.cast("double").alias("saving"))))

    def told(rule: str, severity: str, when: bool) -> None:
        if when:
            rules.append(spark.createDataFrame([(severity, rule, "config", 0.0)], "severity string, rule string, subject string, saving double"))

    aof, save, room = config["appendonly"] == "yes", config["save"].strip(), int(config["maxmemory"])
    if config["maxmemory-policy"].startswith("allkeys"):
        bare = ns.where((F.col("ttl_coverage") < 0.5) & (F.col("est_keys") > lim["few"])).agg(F.sum("est_keys").alias("k")).where("k > 0")
        rules.append(bare.select(F.lit("critical").alias("severity"), F.lit("allkeys-eviction").alias("rule"), F.lit("config").alias("subject"), F.lit(0.0).alias("saving")))
    told("maxmemory-unset", "warning", room == 0)
    told("no-persistence", "critical", not aof and not save)
    told("snapshots-only", "warning", not aof and bool(save))
    told("no-fsync-on-rewrite", "warning", aof and config["no-appendfsync-on-rewrite"] == "yes")
    told("client-buffers", "warning", config["maxmemory-clients"] == "0" and room > 0)
    text, est = F.col("type") == "string", F.col("est_keys")
    payload = size_class(F.col("avg_bytes") + sds_header(F.col("avg_bytes")) + 1)
    overhead = F.when(text, F.greatest(F.lit(0.0), F.col("avg_memory") - payload)).otherwise(F.lit(24 + 16 + 8) + size_class(F.col("avg_key_len") + 4))
    sharded = F.col("pattern").contains("{*}")
    over("key-overhead", "opportunity", (est >= lim["many"]) & ~sharded, overhead * est * (1 - 1 / 124))
    over("size-class-waste", "opportunity", text & (est >= lim["many"]) & (F.col("avg_waste") >= lim["waste"]), F.col("avg_waste") * est)
    json = text & (est >= lim["some"]) & (F.col("jsonish") >= F.greatest(F.lit(lim["names"]), F.col("n") * 0.5)) & (F.col("parsed") > 0)
    arrays = F.col("arrays") >= F.col("parsed") * 0.6
    over("json-vectors", "opportunity", json & arrays, (F.col("total_bytes") / F.col("parsed") - (F.col("array_len") + 4)) * est, material=False)
    over("json-field-names", "opportunity", json & ~arrays & (F.col("name_bytes") > 0), F.col("name_bytes") / F.col("parsed") * est)
    wide = js_round(F.col("avg_bytes"))
    raw = text & (est >= lim["some"]) & wide.isin([4 * d for d in DIMS]) & (F.abs(F.col("least") - wide) < 4) & (F.abs(F.col("most") - wide) < 4)
    over("raw-vectors", "opportunity", raw, (wide - (wide / 4 + 4)) * est, material=False)
    over("hashtable-hashes", "opportunity", (F.col("type") == "hash") & (est >= lim["few"]) & F.map_contains_key("encodings", "hashtable") & (F.col("avg_size") <= lim["fields"]), F.lit(0.0), material=False)
    over("integer-sets", "opportunity", (F.col("type") == "set") & (est >= lim["few"]) & ~F.map_contains_key("encodings", "intset") & (F.col("int_sets") == F.col("n")), F.lit(0.0), material=False)
    per = F.col("avg_memory") / F.col("avg_size")
    over("sorted-set-series", "opportunity", (F.col("type") == "zset") & (F.col("avg_size") >= lim["members"]) & (per >= lim["per_member"]), (per - lim["series"]) * F.col("avg_size") * est)
    told_of = ns.select(F.explode(F.array(*cells)).alias("f")).where("f is not null").select("f.*")
    rules.append(told_of)
    if pending is not None:
        rules.append(pending.where(F.col("pending") > lim["pending"]).orderBy("key").limit(25).select(F.lit("warning").alias("severity"), F.lit("pending-backlog").alias("rule"), F.col("key").alias("subject"), (F.col("pending") * lim["pending_bytes"]).cast("double").alias("saving")))
    told("partial-scan", "info", not complete)
    major, minor = (int(x) for x in config["version"].split("."))
    if (major, minor) >= (8, 10) and config["hash-min-template-entries"] == "0":
        some = ns.where((F.col("type") == "hash") & ~sharded & (est > lim["many"])).limit(1)
        rules.append(some.select(F.lit("opportunity").alias("severity"), F.lit("templates-available").alias("rule"), F.lit("config").alias("subject"), F.lit(0.0).alias("saving")))
    told("old-version", "info", (major, minor) < (7, 4))
    return reduce(DataFrame.unionByName, rules)


def rank(found: DataFrame) -> DataFrame:
    """position: by severity, then saving, then name."""
    order = F.create_map(*[F.lit(x) for kv in RANK.items() for x in kv])[F.col("severity")]
    return numbered(found, [order.asc(), F.desc("saving"), F.asc("rule"), F.asc("subject")], "position")


def fix_plan(keys: DataFrame, config: dict[str, str] = CONFIG, spark: SparkSession | None = None) -> DataFrame:
    """tier, action, subject: what may be set, what is rewritten without loss, what is left to the owner of the data."""
    spark = spark or keys.sparkSession
    ns = saved(namespaces(keys), "profile")
    made: list[DataFrame] = []
    literal = lambda *rows: made.append(spark.createDataFrame(list(rows), "tier string, action string, subject string"))
    if config["maxmemory-policy"].startswith("allkeys"):
        bare = ns.where("ttl_coverage < 0.5 and est_keys > 100").agg(F.sum("est_keys").alias("k")).where("k > 0")
        made.append(bare.select(F.lit("config").alias("tier"), F.lit(f"maxmemory-policy: {config['maxmemory-policy']} -> volatile-ttl").alias("action"), F.lit("config").alias("subject")))
    if config["maxmemory-clients"] == "0" and int(config["maxmemory"]) > 0:
        literal(("config", "maxmemory-clients: 0 -> 5%", "config"))
    if config["appendonly"] == "yes" and config["no-appendfsync-on-rewrite"] == "yes":
        literal(("config", "no-appendfsync-on-rewrite: yes -> no", "config"))
    small = ns.where((F.col("type") == "hash") & F.map_contains_key("encodings", "hashtable") & (F.col("avg_size") > 0) & (F.col("avg_size") <= 512) & (F.col("est_keys") >= 50))
    now = int(config["hash-max-listpack-entries"])
    target = F.greatest(F.lit(128), F.least(F.lit(1024), F.max(F.ceil("avg_size")) * 2))
    made.append(small.agg(target.alias("t"), F.count("*").alias("some")).where((F.col("some") > 0) & (F.col("t") > now)).select(F.lit("config").alias("tier"), F.concat(F.lit(f"hash-max-listpack-entries: {now} -> "), "t").alias("action"), F.lit("config").alias("subject")))
    made.append(small.select(F.lit("rewrite").alias("tier"), F.lit("re-encode to listpack").alias("action"), F.col("pattern").alias("subject")))
    wide = js_round(F.col("avg_bytes"))
    made.append(ns.where((F.col("type") == "string") & (F.col("est_keys") > 1000) & wide.isin([4 * d for d in DIMS])).select(F.lit("refused").alias("tier"), F.lit("quantize vectors to int8").alias("action"), F.col("pattern").alias("subject")))
    made.append(ns.agg(F.sum("n").alias("n")).where("n > 0").select(F.lit("refused").alias("tier"), F.lit("positional schema for JSON records").alias("action"), F.lit("keyspace").alias("subject")))
    return reduce(DataFrame.unionByName, made)


def reencoded(keys: DataFrame, patterns: DataFrame, entries: int) -> DataFrame:
    """keys after a rewrite: hashes of the patterns (one column, pattern) with at most `entries` fields take the compact encoding, all else stays."""
    marked = keys.withColumn("_pattern", key_pattern(F.col("key"))).join(patterns.select(F.col("pattern").alias("_pattern"), F.lit(True).alias("_wanted")), "_pattern", "left")
    goes = (F.col("type") == "hash") & (F.col("encoding") == "hashtable") & (F.col("size") <= entries) & F.coalesce("_wanted", F.lit(False))
    less = F.when(goes, F.col("size") * (HASHTABLE - 2 * LISTPACK)).otherwise(0)
    return marked.withColumn("memory", F.col("memory") - less).withColumn("encoding", F.when(goes, "listpack").otherwise(F.col("encoding"))).select(*keys.columns)


def apply_plan(keys: DataFrame, plan: DataFrame, config: dict[str, str] = CONFIG) -> tuple[DataFrame, dict[str, str]]:
    """The keys and the settings after a plan's config and rewrite tiers; what is refused stays with the owner.  The settings are few rows."""
    after = dict(config)
    for r in plan.where("tier = 'config'").select("action").collect():
        name, value = r["action"].split(": ", 1)
        after[name] = value.rsplit(" -> ", 1)[1]
    patterns = plan.where("tier = 'rewrite'").select(F.col("subject").alias("pattern")).distinct()
    return reencoded(keys, patterns, int(after["hash-max-listpack-entries"])), after


def freed(before: DataFrame, after: DataFrame) -> DataFrame:
    """before, after, freed bytes, and the keys whose encoding changed."""
    a = before.agg(F.sum("memory").cast("long").alias("before"), F.count_if(F.col("encoding") == "hashtable").alias("a"))
    b = after.agg(F.sum("memory").cast("long").alias("after"), F.count_if(F.col("encoding") == "hashtable").alias("b"))
    return a.crossJoin(F.broadcast(b)).select("before", "after", (F.col("before") - F.col("after")).alias("freed"), (F.col("a") - F.col("b")).alias("rewritten"))


def verdict(keys: DataFrame, found: DataFrame) -> DataFrame:
    """used_bytes, saving_bytes, too_small, exit_code."""
    used = keys.agg(F.sum("memory").cast("long").alias("used_bytes"))
    told = found.agg(F.coalesce(F.sum("saving"), F.lit(0.0)).alias("saving"), F.coalesce(F.max((F.col("severity") == "critical").cast("int")), F.lit(0)).alias("exit_code"))
    return used.crossJoin(told).select("used_bytes", js_round(F.col("saving")).cast("long").alias("saving_bytes"), ((F.col("used_bytes") < 2 << 30) & (F.col("saving") < 512 << 20)).alias("too_small"), "exit_code")
