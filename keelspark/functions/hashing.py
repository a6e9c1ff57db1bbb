"""Record hashes and bucket routing as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values of the public FNV-1a hash and of the second stream's multiplier
BASIS, PRIME, SECOND_PRIME = 2166136261, 16777619, 2246822507
_LOW32 = 0xFFFFFFFF


def code_units(s: Column) -> Column:
    """The UTF-16 code units of a string; empty for an empty string, null for null."""
    points = F.transform(F.split(s, ""), lambda c: F.ascii(c).cast("long"))
    high = lambda p: F.lit(0xD800) + F.shiftright(p - 0x10000, 10)
    low = lambda p: F.lit(0xDC00) + (p - 0x10000).bitwiseAND(F.lit(0x3FF))
    # characters beyond the basic plane are two units; strings without any, nearly all, skip that step
    units = F.when(F.exists(points, lambda p: p > 0xFFFF), F.flatten(F.transform(points, lambda p: F.when(p > 0xFFFF, F.array(high(p), low(p))).otherwise(F.array(p))))).otherwise(points)
    return F.when(s != "", units).when(s == "", F.array().cast("array<bigint>"))


def _first_step(h: Column, c: Column) -> Column:
    return (h.bitwiseXOR(c) * F.lit(PRIME)).bitwiseAND(F.lit(_LOW32))


def _second_step(h: Column, c: Column) -> Column:
    # the multiplier does not fit next to 32 bits in a long, so the product is put together from two halves
    a = h.bitwiseXOR(c)
    low = a.bitwiseAND(F.lit(65535)) * F.lit(SECOND_PRIME)
    high = F.shiftleft((F.shiftright(a, 16) * F.lit(SECOND_PRIME)).bitwiseAND(F.lit(65535)), 16)
    return (low + high).bitwiseAND(F.lit(_LOW32))


def fnv1a(s: Column) -> Column:
    """32-bit FNV-1a over UTF-16 code units, as a non-negative long."""
    return F.aggregate(code_units(s), F.lit(BASIS).cast("long"), _first_step)


def hash52(s: Column) -> Column:
    """52 bits from two FNV-like streams over the same units: the widest that stays exact in a double."""
    start = F.struct(F.lit(BASIS).cast("long").alias("a"), F.lit(PRIME).cast("long").alias("b"))
    step = lambda h, c: F.struct(_first_step(h["a"], c).alias("a"), _second_step(h["b"], c).alias("b"))
    return F.aggregate(code_units(s), start, step, lambda h: h["a"] * F.lit(1 << 20) + F.shiftright(h["b"], 12))


def digest_bits(s: Column, start: int, digits: int) -> Column:
    """A number from `digits` hexadecimal digits (13 at most) of the MD5 of a string, the first being digit 1: the same in any engine."""
    return F.conv(F.substring(F.md5(s), start, digits), 16, 10).cast("long")


def _be32(v: Column) -> Column:
    return F.unhex(F.lpad(F.hex(v), 8, "0"))


def cache_field(key: Column) -> Column:
    """16 bytes for a cache entry: the hash, then as many whole characters of the key as 12 bytes hold, filled up with zeros."""
    most = F.array_max(F.filter(F.sequence(F.lit(0), F.lit(12)), lambda n: F.octet_length(F.substring(key, 1, 12).substr(F.lit(1), n)) <= 12))
    head = F.encode(F.substring(key, 1, 12).substr(F.lit(1), most), "UTF-8")
    return F.concat(_be32(fnv1a(key)), F.unhex(F.rpad(F.hex(head), 24, "0")))


def agent_field(key: Column) -> Column:
    """8 bytes for an agent cache's entry: the hashes of the key and of the salted key."""
    return F.concat(_be32(fnv1a(key)), _be32(fnv1a(F.concat(key, F.lit("salt")))))


def shard_count(capacity: Column, width: int = 124) -> Column:
    """The power of two that holds capacity records at about `width` per shard."""
    need = F.greatest(F.lit(1), F.ceil(capacity / F.lit(width)))
    return F.when(need <= 1, F.lit(1)).otherwise(F.pow(F.lit(2.0), F.length(F.bin(need - 1)).cast("double"))).cast("long")


def route(s: Column, shards: Column | int) -> Column:
    """The shard of an id."""
    return F.pmod(fnv1a(s), F.lit(shards) if isinstance(shards, int) else shards)
