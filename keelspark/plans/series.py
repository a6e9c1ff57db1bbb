"""Queries over time series, quantiles, retention and queues."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.sizes import js_round
from ..operators import series as S
from ..sources.tables import table
from .registry import query

_US = "epoch_us(ts)"


def _events(spark, d):
    return table(spark, d, "events")


@query("ts_rollup_avg_1h", "SELECT event_type, CAST(floor(epoch(ts) / 3600) * 3600 AS BIGINT) AS bucket, round(avg(value), 9) AS avg, count(*) AS n FROM events GROUP BY 1, 2")
def ts_rollup_avg_1h(spark, d):
    return S.rollup(_events(spark, d), "event_type", "ts", "value").withColumn("avg", F.round("avg", 9))


@query("ts_range", "SELECT event_id, user_id, value FROM events WHERE event_type = 'click' AND ts >= TIMESTAMP '2024-01-10 00:00:00' AND ts < TIMESTAMP '2024-01-11 00:00:00' ORDER BY ts, event_id")
def ts_range(spark, d):
    return _events(spark, d).where("event_type = 'click' AND ts >= TIMESTAMP_NTZ '2024-01-10 00:00:00' AND ts < TIMESTAMP_NTZ '2024-01-11 00:00:00'").orderBy("ts", "event_id").select("event_id", "user_id", "value")


@query("ts_retention", f"""WITH e AS (SELECT *, {_US} > (SELECT max({_US}) FROM events) - 86400000000 AS raw FROM events)
SELECT 'raw' AS kind, event_type, NULL::BIGINT AS bucket, count(*) AS n, round(avg(value), 9) AS avg FROM e WHERE raw GROUP BY event_type
UNION ALL SELECT 'rollup', event_type, CAST(floor(epoch(ts) / 3600) * 3600 AS BIGINT), count(*), round(avg(value), 9) FROM e WHERE NOT raw GROUP BY event_type, 3""")
def ts_retention(spark, d):
    events = _events(spark, d)
    last = events.agg(F.max(S.epoch_us(F.col("ts"))).alias("last"))
    marked = events.crossJoin(F.broadcast(last)).withColumn("raw", S.epoch_us(F.col("ts")) > F.col("last") - F.lit(86_400_000_000))
    raw = marked.where("raw").groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.avg("value"), 9).alias("avg")).select(F.lit("raw").alias("kind"), "event_type", F.lit(None).cast("long").alias("bucket"), "n", "avg")
    rolled = S.rollup(marked.where("not raw"), "event_type", "ts", "value").select(F.lit("rollup").alias("kind"), "event_type", "bucket", "n", F.round("avg", 9).alias("avg"))
    return raw.unionByName(rolled)


@query("ts_delta_of_delta", f"SELECT event_id, d, d - lag(d) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS dd FROM (SELECT *, {_US} - lag({_US}) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS d FROM events)")
def ts_delta_of_delta(spark, d):
    return S.delta_of_delta(_events(spark, d), "user_id", "ts", "event_id").select("event_id", "d", "dd")


@query("metric_rounding", "SELECT event_type, CAST(sum(floor(value + 0.5)) AS BIGINT) AS total, count(DISTINCT floor(value + 0.5)) AS kinds, sum(CASE WHEN abs(value - floor(value + 0.5)) > 0.5 THEN 1 ELSE 0 END) AS off FROM events GROUP BY 1")
def metric_rounding(spark, d):
    r = js_round(F.col("value"))
    return _events(spark, d).groupBy("event_type").agg(F.sum(r).cast("long").alias("total"), F.count_distinct(r).alias("kinds"), F.count_if(F.abs(F.col("value") - r) > 0.5).alias("off"))


_QS = (0.5, 0.95, 0.99, 0.999)


def _exact(where: str = "true", by: str = "event_type") -> str:
    return f"SELECT {by}, q, list_sort(list(value))[CAST(least(count(*) - 1, floor(q * count(*))) AS BIGINT) + 1] AS v FROM events, (SELECT unnest([0.5, 0.95, 0.99, 0.999]::DOUBLE[]) AS q) WHERE {where} GROUP BY {by}, q"


@query("latency_quantiles", _exact())
def latency_quantiles(spark, d):
    return S.nearest_rank(_events(spark, d), ["event_type"], "value", _QS)


@query("latency_stats", "SELECT event_type, count(*) AS n, round(avg(value), 6) AS mean, min(value) AS least, " + ", ".join(f"list_sort(list(value))[CAST(least(count(*) - 1, floor({q} * count(*))) AS BIGINT) + 1] AS p{p}" for p, q in ((50, 0.5), (95, 0.95), (99, 0.99))) + ", max(value) AS most FROM events GROUP BY 1")
def latency_stats(spark, d):
    events = _events(spark, d)
    plain = events.groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean"), F.min("value").alias("least"), F.max("value").alias("most"))
    ranks = S.nearest_rank(events, ["event_type"], "value", (0.5, 0.95, 0.99)).groupBy("event_type").agg(*[F.max(F.when(F.col("q") == q, F.col("v"))).alias(f"p{p}") for p, q in ((50, 0.5), (95, 0.95), (99, 0.99))])
    return plain.join(ranks, "event_type").select("event_type", "n", "mean", "least", "p50", "p95", "p99", "most")


@query("latency_excl_timeouts", f"SELECT q.event_type, q.q, q.v, t.timeouts FROM ({_exact('value < 200')}) q JOIN (SELECT event_type, sum(CASE WHEN value >= 200 THEN 1 ELSE 0 END) AS timeouts FROM events GROUP BY 1) t USING (event_type)")
def latency_excl_timeouts(spark, d):
    events = _events(spark, d)
    late = events.groupBy("event_type").agg(F.count_if(F.col("value") >= 200).alias("timeouts"))
    return S.nearest_rank(events.where("value < 200"), ["event_type"], "value", _QS).join(late, "event_type").select("event_type", "q", "v", "timeouts")


_SLOT = "(SELECT event_type, user_id % 8 AS part, value, more * 256 + (n >> more) AS slot FROM (SELECT *, CAST(greatest(0, length(bin(n)) - 8) AS BIGINT) AS more FROM (SELECT *, CAST(floor(value * 1000000 + 0.5) AS BIGINT) AS n FROM events)))"
_GUESS = f"""slots AS (SELECT event_type, slot, count(*) AS n FROM {_SLOT} GROUP BY 1, 2),
ranked AS (SELECT event_type, slot, n, sum(n) OVER (PARTITION BY event_type ORDER BY slot) AS upto, sum(n) OVER (PARTITION BY event_type) AS total FROM slots),
guess AS (SELECT event_type, q, ((slot % 256) + CASE WHEN slot >= 256 THEN 0.5::DOUBLE ELSE 0 END) * pow(2.0, floor(slot / 256)) / 1000000 AS guess
  FROM ranked, (SELECT unnest([0.5, 0.95, 0.99, 0.999]::DOUBLE[]) AS q) WHERE least(total - 1, floor(q * total)) < upto AND least(total - 1, floor(q * total)) >= upto - n)"""


@query("quantile_sketch_error", f"WITH {_GUESS} SELECT event_type, q, v, round(guess, 6) AS guess, round(abs(guess - v) / v, 6) AS error FROM guess JOIN ({_exact()}) USING (event_type, q)")
def quantile_sketch_error(spark, d):
    """The sketch's quantiles against the exact ones, and their relative errors."""
    events = _events(spark, d)
    guess = S.sketch_quantiles(S.sketch(events, ["event_type"], "value"), ["event_type"], _QS)
    both = S.nearest_rank(events, ["event_type"], "value", _QS).join(guess, ["event_type", "q"])
    return both.select("event_type", "q", "v", F.round("guess", 6).alias("guess"), F.round(F.abs(F.col("guess") - F.col("v")) / F.col("v"), 6).alias("error"))


def _sketches(spark, d):
    """One sketch for each eighth of the users."""
    return S.sketch(_events(spark, d).withColumn("part", F.col("user_id") % 8), ["event_type", "part"], "value")


@query("quantile_sketch_merge", f"WITH {_GUESS} SELECT event_type, q, round(guess, 6) AS guess, n, least, most FROM guess JOIN (SELECT event_type, count(*) AS n, min(value) AS least, max(value) AS most FROM events GROUP BY 1) USING (event_type)")
def quantile_sketch_merge(spark, d):
    """Eight sketches merged say what one over all rows says.  Merging is a sum, so a part that is merged twice counts twice."""
    told = S.sketch_quantiles(S.merged(_sketches(spark, d), ["event_type"]), ["event_type"], _QS)
    whole = _events(spark, d).groupBy("event_type").agg(F.count("*").alias("n"), F.min("value").alias("least"), F.max("value").alias("most"))
    return told.join(whole, "event_type").select("event_type", "q", F.round("guess", 6).alias("guess"), "n", "least", "most")


@query("sketch_archive_merge", f"WITH {_GUESS} SELECT event_type, round(guess, 6) AS median, CAST(total AS BIGINT) AS n FROM guess JOIN (SELECT event_type, max(upto) AS total FROM ranked GROUP BY 1) USING (event_type) WHERE q = 0.5")
def sketch_archive_merge(spark, d):
    """Sketches as bytes of a table, one value each; read back, merged and asked."""
    kept = _sketches(spark, d).groupBy("event_type", "part").agg(F.to_json(F.array_sort(F.collect_list(F.struct("slot", "n")))).cast("binary").alias("sketch"))
    back = kept.select("event_type", F.inline(F.from_json(F.col("sketch").cast("string"), "array<struct<slot: bigint, n: bigint>>")))
    whole = S.merged(back, ["event_type"])
    told = S.sketch_quantiles(whole, ["event_type"], (0.5,)).join(whole.groupBy("event_type").agg(F.sum("n").alias("n")), "event_type")
    return told.select("event_type", F.round("guess", 6).alias("median"), "n")


@query("sketch_builtin_merge", "SELECT event_type, count(*) AS n, min(value) AS least, max(value) AS most, true AS close FROM events GROUP BY 1")
def sketch_builtin_merge(spark, d):
    """The engine's own rank-error sketch, archived as hexadecimal text and merged; the median's rank stays within two per cent."""
    events = _events(spark, d)
    parts = events.groupBy("event_type", (F.col("user_id") % 8).alias("part")).agg(F.hex(F.expr("kll_sketch_agg_double(value, 800)")).alias("sketch"), F.min("value").alias("least"), F.max("value").alias("most"))
    told = parts.withColumn("sketch", F.unhex("sketch")).groupBy("event_type").agg(F.expr("kll_merge_agg_double(sketch)").alias("sketch"), F.min("least").alias("least"), F.max("most").alias("most"))
    asked = told.select("event_type", "least", "most", F.expr("kll_sketch_get_quantile_double(sketch, 0.5D)").alias("g"), F.expr("kll_sketch_get_n_double(sketch)").alias("n"))
    rank = events.join(F.broadcast(asked.select("event_type", "g")), "event_type").groupBy("event_type").agg((F.count_if(F.col("value") <= F.col("g")) / F.count("*")).alias("r"))
    return asked.join(rank, "event_type").select("event_type", "n", "least", "most", (F.abs(F.col("r") - 0.5) <= 0.02).alias("close"))


@query("retain_last_n", "SELECT user_id, sum(CASE WHEN rn <= 20 THEN 1 ELSE 0 END) AS kept, sum(CASE WHEN rn > 20 THEN 1 ELSE 0 END) AS dropped, min(CASE WHEN rn <= 20 THEN event_id END) AS oldest FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) GROUP BY user_id")
def retain_last_n(spark, d):
    events = _events(spark, d).select("user_id", "ts", "event_id")
    kept = S.last_n(events, ["user_id"], [F.desc("ts"), F.desc("event_id")], 20).groupBy("user_id").agg(F.count("*").alias("kept"), F.min("event_id").alias("oldest"))
    total = events.groupBy("user_id").agg(F.count("*").alias("n"))
    return total.join(kept, "user_id").select("user_id", "kept", (F.col("n") - F.col("kept")).alias("dropped"), "oldest")


@query("pending_entries", "SELECT user_id % 4 AS consumer, count(*) AS pending, CAST(count(*) * 238 AS BIGINT) AS bytes FROM events WHERE event_id % 3 = 0 GROUP BY 1")
def pending_entries(spark, d):
    events = _events(spark, d).select("event_id", "user_id")
    left = S.pending(events, events.where("event_id % 3 <> 0"), "event_id")
    return left.groupBy((F.col("user_id") % 4).alias("consumer")).agg(F.count("*").alias("pending")).select("consumer", "pending", (F.col("pending") * 238).alias("bytes"))


@query("delayed_queue_due", "SELECT o_orderkey, o_orderpriority FROM orders WHERE o_orderdate <= TIMESTAMP '1998-01-01 00:00:00' ORDER BY o_orderdate, o_orderkey LIMIT 100")
def delayed_queue_due(spark, d):
    return S.due(table(spark, d, "orders"), "o_orderdate", F.expr("TIMESTAMP_NTZ '1998-01-01 00:00:00'"), "o_orderkey", 100).select("o_orderkey", "o_orderpriority")


@query("min_of_repeats", "SELECT event_type, min(value) AS bytes, arg_min(event_id, (value, event_id)) AS run FROM events GROUP BY 1")
def min_of_repeats(spark, d):
    return _events(spark, d).groupBy("event_type").agg(F.min("value").alias("bytes"), F.min_by("event_id", F.struct("value", "event_id")).alias("run"))


@query("exact_counter", "SELECT user_id % 16 AS shard, sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END)::BIGINT AS errors, count(*) AS calls FROM events GROUP BY 1")
def exact_counter(spark, d):
    return _events(spark, d).groupBy((F.col("user_id") % 16).alias("shard")).agg(F.count_if(F.col("event_type") == "error").alias("errors"), F.count("*").alias("calls"))


@query("survivors", "SELECT event_type, count(*) AS acked, sum(CASE WHEN event_id % 5 <> 0 THEN 1 ELSE 0 END)::BIGINT AS alive, sum(CASE WHEN event_id % 5 = 0 THEN 1 ELSE 0 END)::BIGINT AS lost FROM events WHERE event_id % 3 <> 0 GROUP BY 1")
def survivors(spark, d):
    """Acknowledged writes that are still there: the arithmetic of a crash test, over two sets of ids."""
    acked = _events(spark, d).where("event_id % 3 <> 0").select("event_id", "event_type")
    alive = _events(spark, d).where("event_id % 5 <> 0").select("event_id", F.lit(True).alias("here"))
    return acked.join(alive, "event_id", "left").groupBy("event_type").agg(F.count("*").alias("acked"), F.count("here").alias("alive"), F.count_if(F.col("here").isNull()).alias("lost"))
