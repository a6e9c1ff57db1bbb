"""Time series, quantiles, retention and queues."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ordering import with_rows_before


def epoch_s(ts: Column) -> Column:
    return F.unix_seconds(ts.cast("timestamp"))


def epoch_us(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp"))


def rollup(df: DataFrame, series: str, ts: str, value: str, seconds: int = 3600) -> DataFrame:
    """series, bucket (epoch seconds of its start), avg, n: one shuffle, pre-aggregated."""
    at = epoch_s(F.col(ts))
    return df.groupBy(series, (at - F.pmod(at, F.lit(seconds))).alias("bucket")).agg(F.avg(value).alias("avg"), F.count("*").alias("n"))


def retained(df: DataFrame, ts: str, hours: int) -> DataFrame:
    """Rows of the last hours; the newest time is one value."""
    last = df.agg(F.max(epoch_us(F.col(ts))).alias("last"))
    return df.crossJoin(F.broadcast(last)).where(epoch_us(F.col(ts)) > F.col("last") - F.lit(hours * 3_600_000_000)).drop("last")


def delta_of_delta(df: DataFrame, series: str, ts: str, tie: str) -> DataFrame:
    """d and dd: the step to the row before and the step of steps, in microseconds; a long series is no one task's work."""
    rows = with_rows_before(df.withColumn("us", epoch_us(F.col(ts))), [series], [ts, tie], ["us"], 2)
    us = [F.col("before")[i]["us"] for i in range(3)]
    return rows.withColumn("d", us[2] - us[1]).withColumn("dd", us[2] - us[1] - (us[1] - us[0])).drop("us", "before")


def nearest_rank(df: DataFrame, by: list[str], value: str, qs: tuple[float, ...], name: str = "v", slack: float = 3e-4) -> DataFrame:
    """by, q, v: the exact quantile sorted[min(n - 1, floor(q n))].

    A mergeable sketch, whose rank error is at most 1e-4, brackets each quantile; rows below the bracket are only counted, and only the distinct values
    inside it (a few ten-thousandths of the rows) are ranked.  No group is gathered or sorted as a whole."""
    rows = df.select(*by, F.col(value).alias("x")).where("x is not null")
    edges = [e for q in qs for e in (max(0.0, q - slack), min(1.0, q + slack))]
    told = rows.groupBy(*by).agg(F.percentile_approx("x", edges, 10000).alias("e"), F.count("*").alias("n"))
    one = F.array(*[F.struct(F.lit(float(q)).alias("q"), F.get("e", F.lit(2 * i)).alias("low"), F.get("e", F.lit(2 * i + 1)).alias("high")) for i, q in enumerate(qs)])
    brackets = told.select(*by, "n", one.alias("b"))
    joined = rows.join(brackets, by) if by else rows.crossJoin(F.broadcast(brackets))
    asked = joined.select(*by, "x", "n", F.explode("b").alias("b")).select(*by, "n", "b.*", "x").where("x <= high")
    # all values below a bracket are one entry; those inside keep their own
    counts = asked.groupBy(*by, "q", F.when(F.col("x") >= F.col("low"), F.col("x")).alias("y")).agg(F.count("*").alias("c"), F.first("n").alias("n"))
    run = counts.withColumn("upto", F.sum("c").over(Window.partitionBy(*by, "q").orderBy(F.col("y").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0)))
    at = F.least(F.col("n") - 1, F.floor(F.col("q") * F.col("n")))
    return run.where((at < F.col("upto")) & (at >= F.col("upto") - F.col("c"))).select(*by, "q", F.col("y").alias(name))


#: binary digits that a sketch keeps of a value; its relative error is at most 2**-DIGITS
DIGITS, UNIT = 7, 1_000_000


def sketch_slot(value: Column, digits: int = DIGITS, unit: int = UNIT) -> Column:
    """The slot of a non-negative value: its first binary digits and how many follow, taken from whole units so that every engine agrees."""
    n = F.floor(value * unit + 0.5).cast("long")
    more = F.greatest(F.lit(0), F.length(F.bin(n)) - digits - 1)
    return (more.cast("long") * (2 << digits) + F.call_function("shiftright", n, more.cast("int")))


def slot_value(slot: Column, digits: int = DIGITS, unit: int = UNIT) -> Column:
    """The middle of a slot."""
    more, head = F.floor(slot / (2 << digits)), F.pmod(slot, F.lit(2 << digits))
    return (head + F.when(more > 0, 0.5).otherwise(0.0)) * F.pow(F.lit(2.0), more.cast("double")) / unit


def sketch(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """by, slot, n: a mergeable quantile sketch as rows; sketches of parts merge by adding n.  A group has some hundred slots whatever its size."""
    return df.where(F.col(value).isNotNull()).groupBy(*by, sketch_slot(F.col(value)).alias("slot")).agg(F.count("*").alias("n"))


def merged(sketches: DataFrame, by: list[str]) -> DataFrame:
    return sketches.groupBy(*by, "slot").agg(F.sum("n").alias("n"))


def sketch_quantiles(sketches: DataFrame, by: list[str], qs: tuple[float, ...]) -> DataFrame:
    """by, q, guess: the middle of the slot that holds the value of rank floor(q n)."""
    held = sketches.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("slot", "n"))).alias("s"), F.sum("n").alias("total"))
    asked = held.withColumn("q", F.explode(F.array(*[F.lit(float(q)) for q in qs])))
    at = F.least(F.col("total") - 1, F.floor(F.col("q") * F.col("total")))
    found = F.aggregate("s", F.struct(F.lit(0).cast("long").alias("upto"), F.lit(None).cast("long").alias("slot")), lambda a, x: F.struct((a["upto"] + x["n"]).alias("upto"), F.when(a["slot"].isNull() & (a["upto"] + x["n"] > F.col("at")), x["slot"]).otherwise(a["slot"]).alias("slot")), lambda a: a["slot"])
    return asked.withColumn("at", at).withColumn("slot", found).select(*by, "q", slot_value(F.col("slot")).alias("guess"))


def last_n(df: DataFrame, by: list[str], order: list[Column], n: int) -> DataFrame:
    """The last n rows per group; Spark prunes to n per task before the shuffle."""
    return df.withColumn("rn", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("rn") <= n).drop("rn")


def pending(delivered: DataFrame, acked: DataFrame, key: str) -> DataFrame:
    """Delivered and not acknowledged, whatever has been trimmed from the log."""
    return delivered.join(acked.select(key), key, "left_anti")


def due(tasks: DataFrame, at: str, now: Column, key: str, limit: int) -> DataFrame:
    return tasks.where(F.col(at) <= now).orderBy(at, key).limit(limit)
