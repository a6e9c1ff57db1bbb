"""A keyspace: key, type, encoding, memory, ttl, size, value; built from the tables at hand, bytes modelled, not measured."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.sizes import sds_header, size_class
from .tables import table

COLUMNS = ("key", "type", "encoding", "memory", "ttl", "size", "value")


def modelled_memory(key: Column, size: Column) -> Column:
    return size_class(size + sds_header(size) + 1) + 24 + 16 + size_class(F.length(key) + 4) + 8


def order_json() -> Column:
    return F.to_json(F.struct("o_orderkey", "o_custkey", "o_orderstatus", F.date_format("o_orderdate", "yyyy-MM-dd").alias("o_orderdate"), "o_orderpriority", F.round(F.col("o_totalprice") * 100).cast("long").alias("cents")))


def keyspace(spark: SparkSession, sf_dir: str) -> DataFrame:
    none = F.lit(None)
    orders = table(spark, sf_dir, "orders").select(F.concat(F.lit("order:"), "o_orderkey").alias("key"), F.lit("string").alias("type"), order_json().alias("value"), F.when(F.col("o_orderstatus") != "F", 3600).cast("long").alias("ttl"))
    orders = orders.withColumn("size", F.octet_length("value").cast("long"))
    customers = table(spark, sf_dir, "customer").select(F.concat(F.lit("cust:{"), F.col("c_custkey") % 8, F.lit("}:"), "c_custkey").alias("key"), F.lit("hash").alias("type"), none.cast("string").alias("value"), none.cast("long").alias("ttl"), F.lit(5).cast("long").alias("size"))
    events = table(spark, sf_dir, "events").groupBy("user_id").agg(F.count("*").alias("size")).select(F.concat(F.lit("events:"), "user_id").alias("key"), F.lit("stream").alias("type"), none.cast("string").alias("value"), none.cast("long").alias("ttl"), "size")
    vectors = table(spark, sf_dir, "embeddings").select(F.concat(F.lit("emb:"), "vec_id").alias("key"), F.lit("string").alias("type"), none.cast("string").alias("value"), none.cast("long").alias("ttl"), (F.size("embedding") * 4).cast("long").alias("size"))
    every = orders.select("key", "type", "value", "ttl", "size").unionByName(customers).unionByName(events).unionByName(vectors)
    coded = F.when(F.col("type") == "hash", "listpack").when(F.col("type") == "stream", "stream").when(F.col("size") <= 44, "embstr").otherwise("raw")
    return every.withColumn("encoding", coded).withColumn("memory", modelled_memory(F.col("key"), F.col("size")).cast("long")).select(*COLUMNS)


def sample_keyspace(keys: DataFrame, limit: int) -> DataFrame:
    """The first keys in order, a deterministic stand-in for a cursor's first ones."""
    return keys.orderBy("key").limit(limit)


def by_type(keys: DataFrame, kind: str, most: int | None = None) -> DataFrame:
    """The keys of a type among the first `most` keys in order (all without it), with complete: whether the scan saw every key."""
    if most is None:
        return keys.where(F.col("type") == kind).withColumn("complete", F.lit(True))
    whole = keys.agg((F.count("*") <= most).alias("complete"))
    return sample_keyspace(keys, most).where(F.col("type") == kind).crossJoin(F.broadcast(whole))


def workspace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A second keyspace, of structures that are stored worse than they could be: wide hashes, samples in sorted sets, sets of integers.
    int_members tells whether a set's members are all integers."""
    none = F.lit(None)
    hashes = table(spark, sf_dir, "customer").select(F.concat(F.lit("prof:"), "c_custkey").alias("key"), F.lit("hash").alias("type"), F.lit("hashtable").alias("encoding"), F.lit(20).cast("long").alias("size"), F.lit(False).alias("int_members"))
    hashes = hashes.withColumn("memory", (modelled_memory(F.col("key"), F.col("size")) + F.col("size") * 64).cast("long"))
    series = table(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("size")).select(F.concat(F.lit("lat:"), "event_type").alias("key"), F.lit("zset").alias("type"), F.lit("skiplist").alias("encoding"), "size", F.lit(False).alias("int_members"), (F.col("size") * 88 + 96).alias("memory"))
    sets = table(spark, sf_dir, "orders").groupBy((F.col("o_custkey") % 500).alias("k")).agg(F.count("*").alias("size")).select(F.concat(F.lit("tags:"), "k").alias("key"), F.lit("set").alias("type"), F.lit("hashtable").alias("encoding"), "size", F.lit(True).alias("int_members"), (F.col("size") * 54 + 96).alias("memory"))
    every = hashes.unionByName(series).unionByName(sets)
    return every.withColumn("value", none.cast("string")).withColumn("ttl", none.cast("long")).select(*COLUMNS, "int_members")
