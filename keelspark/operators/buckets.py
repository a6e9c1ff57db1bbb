"""Hash buckets: routing, online split, dual-home reads, keyed upserts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import fnv1a
from .ordering import numbered_in


def routed(df: DataFrame, id_: Column, k: int, name: str = "bucket") -> DataFrame:
    """df with its bucket of 2**k."""
    return df.withColumn(name, F.pmod(fnv1a(id_), F.lit(1 << k)))


def split(df: DataFrame, id_: Column, k: int) -> DataFrame:
    """old_bucket and new_bucket of a step from 2**k to 2**(k+1) buckets; a record stays or moves by exactly 2**k.  The hash is taken once."""
    return df.withColumn("h", fnv1a(id_)).withColumn("old_bucket", F.pmod("h", F.lit(1 << k))).withColumn("new_bucket", F.pmod("h", F.lit(1 << (k + 1)))).drop("h")


def moves(df: DataFrame, id_: Column, k: int) -> DataFrame:
    rows = split(df, id_, k)
    moved = F.col("new_bucket") != F.col("old_bucket")
    return rows.groupBy("old_bucket").agg(F.count("*").alias("total"), F.count_if(~moved).alias("stayed"), F.count_if(moved).alias("moved"), F.count_if(moved & (F.col("new_bucket") != F.col("old_bucket") + (1 << k))).alias("strays"))


def grow(df: DataFrame, id_: Column, k: int, target: int) -> DataFrame:
    """generation, moved, total: what every step from k to target moves.  One pass: every step is a function of the same hash."""
    rows = df.select(fnv1a(id_).alias("h"))
    return rows.agg(F.count("*").alias("total"), *[F.count_if(F.pmod("h", F.lit(1 << g)) != F.pmod("h", F.lit(1 << (g + 1)))).alias(f"m{g}") for g in range(k, target)]).select(
        F.explode(F.array(*[F.struct(F.lit(g + 1).alias("generation"), F.col(f"m{g}").alias("moved"), F.col("total").alias("total")) for g in range(k, target)])).alias("r")
    ).select("r.*")


def mget(requests: DataFrame, store: DataFrame) -> DataFrame:
    """requests: pos, id; store: id, value.  One row per request in its order, null for a miss."""
    return requests.join(store, "id", "left").select("pos", "id", "value")


def dual_home(requests: DataFrame, new_home: DataFrame, old_home: DataFrame) -> DataFrame:
    """The new home's value, else the old one's."""
    one = requests.join(new_home.select("id", F.col("value").alias("new_value")), "id", "left")
    return one.join(old_home.select("id", F.col("value").alias("old_value")), "id", "left").select("id", F.coalesce("new_value", "old_value").alias("value"), F.when(F.col("new_value").isNotNull(), "new").when(F.col("old_value").isNotNull(), "old").otherwise("miss").alias("home"))


def upsert(df: DataFrame, key: list[str], seq: list[str]) -> DataFrame:
    """The last write of each key.  A partial aggregate, not a window: no sort, and copies of a key meet before the shuffle."""
    rest = [c for c in df.columns if c not in key]
    return df.groupBy(*key).agg(F.max_by(F.struct(*rest), F.struct(*seq)).alias("last")).select(*key, *[F.col(f"last.{c}").alias(c) for c in rest])


def delete(df: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    return df.join(gone.select(key), key, "left_anti")


def parse_generation(marker: Column) -> tuple[Column, Column]:
    """`k` or `k:prev` as two numbers, the second null where there is none."""
    parts = F.split(marker, ":")
    return F.get(parts, 0).cast("int"), F.get(parts, 1).cast("int")


def chunks(df: DataFrame, by: list[str], order: list[str], size: int) -> DataFrame:
    """chunk and sealed: runs of `size` rows per group in order; an incomplete last one is not sealed.  A long group is no one task's work."""
    rows = numbered_in(df, by, order).withColumn("chunk", F.floor((F.col("row") - 1) / size))
    return rows.withColumn("sealed", (F.col("chunk") + 1) * size <= F.col("rows")).drop("row", "rows")


def hash_tag(key: Column) -> Column:
    """What decides a key's place: the text in its first braces if there is any, else the whole key.  Keys with one tag share a slot."""
    tag = F.regexp_extract(key, r"^[^{]*\{([^}]+)\}", 1)
    return F.when(tag != "", tag).otherwise(key)


def slotted(df: DataFrame, key: Column, slots: int, name: str = "slot") -> DataFrame:
    """df with the slot of its key's tag.  Tables written with `bucketBy(n, "slot")` join on it without a shuffle."""
    return df.withColumn(name, F.pmod(fnv1a(hash_tag(key)), F.lit(slots)))
