"""Capacity and cost: volumes, measured bytes and price lists joined."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: component, records, naive and optimised bytes per record (fixed values: published measurements)
LINES = (
    ("Agent run state", 2_000_000, 2253.2762, 146.7552),
    ("Conversation transcripts", 80_000_000, 2060.38503125, 594.52496875),
    ("Tool-call spans", 200_000_000, 346.21312, 36.635733333333334),
    ("Semantic memory (searchable)", 20_000_000, 32814.542625, 2291.708),
    ("Idempotency / dedup", 500_000_000, 54.081488, 8.984554),
    ("Tool-result cache", 50_000_000, 276.52298, 160.51996),
    ("Secondary indexes", 100_000_000, 64.999968, 4.427115),
    ("Task queue", 2_000_000, 216.6338, 55.25072),
    ("Telemetry", 500_000_000, 88.645031, 2.071104),
)
#: list price per GiB and month, usable share (fixed values: published price lists)
SKUS = (
    ("ElastiCache Valkey r8g.16xlarge", 8.13, 0.75),
    ("ElastiCache Valkey r7g.xlarge", 9.70, 0.75),
    ("ElastiCache Redis OSS r7g.xlarge", 12.12, 0.75),
    ("GCP Memorystore highmem", 10.80, 0.80),
    ("Azure Managed Redis M2000", 10.51, 0.80),
    ("MemoryDB Valkey r7g.xlarge", 11.98, 0.75),
    ("ElastiCache Valkey r6gd (SSD-tiered)", 3.63, 0.75),
    ("Redis Cloud Essentials Flex", 5.00, 1.0),
)
#: step, multiplier of the usable price (fixed values)
LADDER = (("advertised", None, 1.0), ("reserved", 1.0, 1.0), ("replica", 1.0, 2.0), ("synchronous", 1.0, 2.36))


def lines(spark: SparkSession, rows=LINES) -> DataFrame:
    df = spark.createDataFrame(list(rows), "component string, records long, naive_bytes double, opt_bytes double")
    return df.select("*", (F.col("records") * F.col("naive_bytes")).alias("naive_total"), (F.col("records") * F.col("opt_bytes")).alias("opt_total"), F.round(F.col("naive_bytes") / F.col("opt_bytes"), 2).alias("factor"))


def totals(df: DataFrame) -> DataFrame:
    return df.agg(F.sum("naive_total").alias("naive_total"), F.sum("opt_total").alias("opt_total")).withColumn("factor", F.round(F.col("naive_total") / F.col("opt_total"), 2))


def pricing(df: DataFrame, skus=SKUS) -> DataFrame:
    """sku, per_usable, naive, optimized: monthly cost; one total against a short price list."""
    prices = df.sparkSession.createDataFrame(list(skus), "sku string, advertised double, usable double")
    per = F.col("advertised") / F.col("usable")
    gib = float(1 << 30)
    return prices.crossJoin(F.broadcast(totals(df))).select("sku", F.round(per, 2).alias("per_usable"), F.floor(F.col("naive_total") / gib * per + 0.5).alias("naive"), F.floor(F.col("opt_total") / gib * per + 0.5).alias("optimized"))


def ladder(df: DataFrame, sku=SKUS[1]) -> DataFrame:
    """step, monthly: what durability and a replica add."""
    steps = df.sparkSession.createDataFrame([(n, (sku[2] if m is None else m) * x) for n, m, x in LADDER], "step string, times double")
    return steps.crossJoin(F.broadcast(totals(df))).select("step", F.floor(F.col("opt_total") / float(1 << 30) * (sku[1] / sku[2]) * F.col("times") + 0.5).alias("monthly"))
