"""Synthetic agent data.  Every value is a hash of its row number, a field name and a seed: parallel, repeatable, no order of draws, and the same in any
engine that has MD5."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.hashing import digest_bits

# fixed values of the example workload
STATUSES = ("queued", "running", "awaiting_tool", "succeeded", "failed", "cancelled")
REGIONS = ("iad1", "sfo1", "fra1", "hnd1", "syd1")
TOOLS = ("web_search", "read_file", "write_file", "bash", "sql_query", "vector_search", "http_request", "send_email", "code_interpreter", "browser")
MODELS = ("large", "medium", "small", "tiny")
ROLES = ("user", "assistant")
EPOCH = 1_760_000_000


def uniform(field: str, seed: int, *by: Column) -> Column:
    """In [0, 1), from 13 hexadecimal digits of a hash."""
    return digest_bits(F.concat_ws("/", *(b.cast("string") for b in by or (F.col("id"),)), F.lit(field), F.lit(str(seed))), 1, 13) / float(1 << 52)


def between(field: str, seed: int, low: int, high: int) -> Column:
    return (F.lit(low) + F.floor(uniform(field, seed) * (high - low + 1))).cast("long")


def pick(field: str, seed: int, values: tuple) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (F.floor(uniform(field, seed) * len(values)) + 1).cast("int"))


def normal(field: str, seed: int, *by: Column) -> Column:
    u, v = uniform(f"{field}/u", seed, *by), uniform(f"{field}/v", seed, *by)
    return F.sqrt(F.lit(-2.0) * F.log(F.greatest(u, F.lit(1e-16)))) * F.cos(v * (2 * math.pi))


def uuid_like(field: str, seed: int) -> Column:
    h = F.md5(F.concat_ws("/", F.lit(field), F.lit(seed), F.col("id")))
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("4"), F.substring(h, 14, 3)), F.concat(F.lit("8"), F.substring(h, 18, 3)), F.substring(h, 21, 12))


def runs(spark: SparkSession, n: int, seed: int = 1) -> DataFrame:
    now = F.lit(EPOCH) + F.col("id")
    return spark.range(n).select(
        "id", *[uuid_like(c, seed).alias(c) for c in ("run_id", "tenant_id", "agent_id", "parent_run_id", "thread_id")], pick("status", seed, STATUSES).alias("status"), pick("model", seed, MODELS).alias("model"), now.alias("created_at"), (now + between("updated", seed, 1, 900)).alias("updated_at"),
        (now + between("started", seed, 0, 5)).alias("started_at"), (now + 3600).alias("deadline_at"), between("steps", seed, 1, 240).alias("step_count"), between("calls", seed, 0, 180).alias("tool_call_count"), between("prompt", seed, 500, 400_000).alias("prompt_tokens"),
        between("completion", seed, 50, 32_000).alias("completion_tokens"), between("cached", seed, 0, 380_000).alias("cached_tokens"), between("cost", seed, 100, 9_000_000).alias("cost_micros"), between("retry", seed, 0, 4).alias("retry_count"), between("priority", seed, 0, 9).alias("priority"), pick("region", seed, REGIONS).alias("region"),
    )


def spans(spark: SparkSession, n: int, per_run: int = 100, seed: int = 2) -> DataFrame:
    step = F.col("id") % per_run
    return spark.range(n).select(
        "id", uuid_like("span", seed).alias("span_id"), F.floor(F.col("id") / per_run).alias("run"), step.alias("step"), pick("tool", seed, TOOLS).alias("tool"), (F.lit(EPOCH * 1000) + step * between("gap", seed, 40, 5000)).alias("ts_ms"), between("dur", seed, 3, 30_000).alias("dur_ms"), (uniform("ok", seed) > 0.06).cast("int").alias("ok"),
        between("in", seed, 40, 40_000).alias("input_bytes"), between("out", seed, 40, 200_000).alias("output_bytes"), F.when(uniform("again", seed) > 0.9, between("retry", seed, 1, 3)).otherwise(0).alias("retry"), (uniform("hit", seed) > 0.55).cast("int").alias("cache_hit"), pick("http", seed, (200, 200, 200, 200, 201, 400, 429, 500, 503)).alias("http_status"),
    )


def zipf_words(spark: SparkSession, n: int, words: list[str], seed: int = 3, power: float = 1.07) -> DataFrame:
    """id, word: words by a power law of their rank.  The cumulative shares are cut into slices, so finding a word is an equi-join with a small table."""
    weight = [1 / (i + 1) ** power for i in range(len(words))]
    total, upto, rows = sum(weight), 0.0, []
    slices = 1024
    for w, x in zip(words, weight):
        low, upto = upto, upto + x / total
        rows += [(k, w, low, upto) for k in range(int(low * slices), min(slices, int(upto * slices) + 1))]
    table = F.broadcast(spark.createDataFrame(rows, "slice int, word string, low double, high double"))  # at most the words plus the slices
    draws = spark.range(n).withColumn("u", uniform("zipf", seed)).withColumn("slice", F.floor(F.col("u") * slices).cast("int"))
    return draws.join(table, "slice").where("u >= low and u < high").select("id", "word")


def turns(spark: SparkSession, n: int, words: list[str], per_turn: int = 20, seed: int = 4) -> DataFrame:
    said = zipf_words(spark, n * per_turn, words, seed).groupBy(F.floor(F.col("id") / per_turn).alias("turn_id")).agg(F.array_sort(F.collect_list(F.struct("id", "word"))).alias("w"))
    return said.select("turn_id", F.when(F.col("turn_id") % 2 == 0, "user").otherwise("assistant").alias("role"), F.array_join("w.word", " ").alias("content"), (F.lit(EPOCH * 1000) + F.col("turn_id") * 1500).alias("ts"))


def embeddings(spark: SparkSession, n: int, dim: int = 64, rank: int = 16, topics: int = 5, noise: float = 0.18, seed: int = 5) -> DataFrame:
    """id, v: unit vectors that mix a few of `rank` random directions with heavy-tailed weights, and a little noise."""
    axis = F.sequence(F.lit(0), F.lit(dim - 1))
    weights = F.transform(F.sequence(F.lit(0), F.lit(topics - 1)), lambda t: F.struct(F.floor(uniform("topic", seed, F.col("id"), t) * rank).alias("b"), (F.pow(uniform("weight", seed, F.col("id"), t), F.lit(2.2)) * F.when(uniform("sign", seed, F.col("id"), t) < 0.5, -1).otherwise(1)).alias("w")))
    raw = F.transform(axis, lambda k: F.aggregate("mix", normal("noise", seed, F.col("id"), k) * (noise * 0.05), lambda s, m: s + m["w"] * normal("basis", seed, m["b"], k)))
    made = spark.range(n).withColumn("mix", weights).withColumn("raw", raw)
    size = F.sqrt(F.aggregate("raw", F.lit(0.0), lambda s, x: s + x * x))
    return made.withColumn("size", size).select("id", F.transform("raw", lambda x: (x / F.when(F.col("size") == 0, 1.0).otherwise(F.col("size"))).cast("float")).alias("v"))


def latencies(spark: SparkSession, n: int, series: int = 200, timeouts: float = 0.0, seed: int = 6) -> DataFrame:
    """series, i, ms: lognormal, with a share of calls that hit the timeout."""
    ms = F.greatest(F.lit(1), F.round(F.lit(120.0) * F.exp(normal("ms", seed) * 0.9)).cast("long"))
    return spark.range(n).select((F.col("id") % series).alias("series"), F.floor(F.col("id") / series).alias("i"), F.when(uniform("late", seed) < timeouts, 30_000).otherwise(ms).alias("ms"))


def contention(spark: SparkSession, n: int, runs_: int, seed: int = 7) -> DataFrame:
    """id, run: attempts skewed towards the first runs."""
    return spark.range(n).select("id", F.floor(uniform("run", seed) * uniform("run", seed) * runs_).alias("run"))
