"""Storage layouts as size models: payload bytes are exact, container overhead comes from the constants here.  Modelled, not measured."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.sizes import sds_header, size_class

#: bytes of a key's own bookkeeping and of one entry of each container (model constants)
KEY, LISTPACK, HASHTABLE, STREAM, LIST = 48, 4, 64, 12, 3


def key_cost(key_len: Column | int) -> Column:
    n = F.lit(key_len) if isinstance(key_len, int) else key_len
    return F.lit(KEY) + size_class(n + 4)


def value_cost(n: Column) -> Column:
    return size_class(n + sds_header(n) + 1)


def compare(df: DataFrame, variants: dict[str, Column]) -> DataFrame:
    """variant, records, bytes, ratio: the sum of each variant's bytes per record, against the first.  One pass over the records."""
    names = list(variants)
    sums = df.agg(F.count("*").alias("records"), *[F.sum(c).cast("double").alias(f"b{i}") for i, c in enumerate(variants.values())])
    return sums.select(F.explode(F.array(*[F.struct(F.lit(n).alias("variant"), F.col("records").alias("records"), F.round(F.col(f"b{i}") / F.col("records"), 4).alias("bytes"), F.round(F.col("b0") / F.col(f"b{i}"), 4).alias("ratio")) for i, n in enumerate(names)])).alias("r")).select("r.*")


def with_caveats(told: DataFrame, caveats: dict[str, str]) -> DataFrame:
    """told with caveat: what speaks against a variant, null where nothing does."""
    return told.withColumn("caveat", F.try_element_at(F.create_map(*[F.lit(x) for kv in caveats.items() for x in kv]), F.col("variant")))
