"""Seen sets and sketches: exact, Bloom, bitmap, HyperLogLog."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import digest_bits


def first_seen(df: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """df with added: true for the first row of each key.  The first places are a pre-aggregated minimum that is joined back, so a key with very many rows
    is never sorted in one task; order has to tell rows apart."""
    firsts = df.groupBy(*key).agg(F.min(F.struct(*order)).alias("__first")).select(*[F.col(k).alias(f"__{k}") for k in key], "__first")
    on = [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in key]
    return df.join(firsts, on).withColumn("added", F.struct(*order) == F.col("__first")).drop("__first", *[f"__{k}" for k in key])


def bloom_size(n: int, p: float) -> tuple[int, int]:
    """(bits, hashes) for n members at a false-positive rate p."""
    m = max(64, math.ceil(-n * math.log(p) / math.log(2) ** 2))
    return m, max(1, round(m / max(n, 1) * math.log(2)))


def bloom_positions(value: Column, m: int, k: int) -> Column:
    """The k bit positions of a value, by double hashing with two parts of its MD5, so that any engine finds the same ones."""
    text = value.cast("string") if isinstance(value, Column) else F.col(value).cast("string")
    a, b = digest_bits(text, 1, 10), digest_bits(text, 11, 10)
    return F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: F.pmod(a + i * b, F.lit(m)))


def bloom(members: DataFrame, value: str, m: int, k: int) -> DataFrame:
    """bucket, bits: the filter as bitmaps of 32768 bits each, so that it is a table and not one value on the driver."""
    bits = members.select(F.explode(F.array_distinct(bloom_positions(F.col(value), m, k))).alias("bit"))
    return bits.groupBy(F.bitmap_bucket_number("bit").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("bit")).alias("bits"))


def bloom_probe(probes: DataFrame, value: str, filter_: DataFrame, m: int, k: int) -> DataFrame:
    """probes with maybe: false is certain, true is probable.  Positions meet the filter by bucket number."""
    asked = probes.select(value, F.explode(bloom_positions(F.col(value), m, k)).alias("bit")).withColumn("bucket", F.bitmap_bucket_number("bit")).withColumn("at", F.bitmap_bit_position("bit"))
    byte = F.conv(F.hex(F.substring(F.col("bits"), (F.floor(F.col("at") / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    hit = F.coalesce(F.call_function("shiftright", byte, (F.col("at") % 8).cast("int")).bitwiseAND(F.lit(1)) == 1, F.lit(False))
    told = asked.join(filter_, "bucket", "left").select(value, hit.alias("hit"))
    return told.groupBy(value).agg(F.min("hit").alias("maybe"))


def tag_bitmap(df: DataFrame, tag: str, id_: str) -> DataFrame:
    """tag, bucket, bits: which ids carry a tag."""
    return df.groupBy(tag, F.bitmap_bucket_number(id_).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(id_)).alias("bits"))


def bitmap_sizes(bitmaps: DataFrame, tag: str) -> DataFrame:
    return bitmaps.groupBy(tag).agg(F.sum(F.bitmap_count("bits")).alias("n"))


def bitmap_both(a: DataFrame, b: DataFrame) -> DataFrame:
    """bucket, bits of the ids in both: bitmaps of the same bucket are combined."""
    both = a.select("bucket", "bits").union(b.select("bucket", "bits"))
    return both.groupBy("bucket").agg(F.bitmap_and_agg("bits").alias("bits"), F.count("*").alias("sides")).where("sides = 2").select("bucket", "bits")


def counting_filter(df: DataFrame, value: str, m: int, k: int) -> DataFrame:
    """bit, n: how many members' positions fall on a bit; members are taken out by subtracting theirs."""
    return df.select(F.explode(F.array_distinct(bloom_positions(F.col(value), m, k))).alias("bit")).groupBy("bit").agg(F.count("*").alias("n"))


def counting_without(filter_: DataFrame, gone: DataFrame, value: str, m: int, k: int) -> DataFrame:
    """The filter after members are deleted."""
    less = counting_filter(gone, value, m, k).select("bit", (-F.col("n")).alias("n"))
    return filter_.unionByName(less).groupBy("bit").agg(F.sum("n").alias("n")).where("n > 0")


def counting_probe(probes: DataFrame, value: str, filter_: DataFrame, m: int, k: int) -> DataFrame:
    """probes with maybe: whether all positions of a value are still held."""
    asked = probes.select(value, F.explode(F.array_distinct(bloom_positions(F.col(value), m, k))).alias("bit"))
    return asked.join(filter_.select("bit", F.lit(True).alias("held")), "bit", "left").groupBy(value).agg(F.min(F.coalesce("held", F.lit(False))).alias("maybe"))


def cuckoo_slots(df: DataFrame, value: str, buckets: int) -> DataFrame:
    """df with low, high and mark: a 16-bit mark of the value and its two buckets.  The second bucket follows from the first and the mark alone, as in a
    cuckoo filter; a table has no full buckets, so nothing is ever moved between them and a pair of buckets serves as one home."""
    text = F.col(value).cast("string")
    mark = digest_bits(text, 1, 4)
    first = F.pmod(digest_bits(text, 5, 10), F.lit(buckets))
    second = F.pmod(F.lit(buckets) + digest_bits(mark.cast("string"), 1, 10) % buckets - first, F.lit(buckets))
    return df.withColumn("low", F.least(first, second)).withColumn("high", F.greatest(first, second)).withColumn("mark", mark)


def cuckoo_table(members: DataFrame, value: str, buckets: int) -> DataFrame:
    """low, high, mark, n: the filter; equal marks in the same home are counted, so that each can be deleted once."""
    return cuckoo_slots(members, value, buckets).groupBy("low", "high", "mark").agg(F.count("*").alias("n"))


def cuckoo_without(filter_: DataFrame, gone: DataFrame, value: str, buckets: int) -> DataFrame:
    less = cuckoo_table(gone, value, buckets).withColumn("n", -F.col("n"))
    return filter_.unionByName(less).groupBy("low", "high", "mark").agg(F.sum("n").alias("n")).where("n > 0")


def cuckoo_has(probes: DataFrame, value: str, filter_: DataFrame, buckets: int) -> DataFrame:
    """probes with maybe: false is certain, true is probable; one join, whatever the number of hashes."""
    held = filter_.select("low", "high", "mark", F.lit(True).alias("held"))
    return cuckoo_slots(probes, value, buckets).join(held, ["low", "high", "mark"], "left").drop("low", "high", "mark").withColumn("maybe", F.coalesce("held", F.lit(False))).drop("held")


def hll_registers(df: DataFrame, by: list[str], value: str, bits: int = 10) -> DataFrame:
    """by, register, rank: the highest rank of a first one among the hashes of a register.  Registers of parts merge by their maximum, which is what
    the partial aggregate does before the shuffle."""
    text = F.col(value).cast("string")
    rest = digest_bits(text, 4, 10)
    rank = F.when(rest == 0, 41).otherwise(F.lit(41) - F.length(F.bin(rest)))
    return df.where(F.col(value).isNotNull()).groupBy(*by, F.pmod(digest_bits(text, 1, 3), F.lit(1 << bits)).alias("register")).agg(F.max(rank).alias("rank"))


def hll_estimate(registers: DataFrame, by: list[str], bits: int = 10) -> DataFrame:
    """by, estimate: the usual estimate with linear counting for small sets."""
    m = 1 << bits
    told = registers.groupBy(*by).agg(F.count("*").alias("used"), F.sum(F.pow(F.lit(2.0), -F.col("rank"))).alias("sum"))
    empty = F.lit(m) - F.col("used")
    raw = F.lit(0.7213 / (1 + 1.079 / m) * m * m) / (F.col("sum") + empty)
    return told.select(*by, F.when((raw <= 2.5 * m) & (empty > 0), F.lit(float(m)) * F.log(F.lit(float(m)) / empty)).otherwise(raw).alias("estimate"))
