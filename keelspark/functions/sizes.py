"""Byte arithmetic: allocator classes, wire lengths, number texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def js_round(x: Column) -> Column:
    """Rounds halves up, negative ones too."""
    return F.floor(x + F.lit(0.5))


def size_class(n: Column) -> Column:
    """The allocator class that n bytes are charged at."""
    d = n.cast("double")
    # the logarithm by counting binary digits, which is exact at the powers of two
    step = F.pow(F.lit(2.0), (F.length(F.bin(F.greatest(F.floor(d - 1), F.lit(1)))) - 3).cast("double"))
    return F.when(d <= 8, F.lit(8)).when(d <= 128, F.ceil(d / 16) * 16).otherwise((F.ceil(d / step).cast("double") * step).cast("long")).cast("long")


def sds_header(n: Column) -> Column:
    return F.when(n < 256, 3).when(n < 65536, 5).otherwise(9)


def string_waste(n: Column) -> Column:
    """Bytes that rounding to a class costs a string of n bytes."""
    need = n + sds_header(n) + 1
    return size_class(need) - need


def embeds(key_len: Column, value_len: Column) -> Column:
    """Whether key and value share the 64-byte object."""
    return (F.lit(16) + key_len + 3 + 4 + value_len) <= 64


def varint_len(v: Column) -> Column:
    """Bytes of LEB128 over an unsigned 32-bit value; wider and negative values wrap."""
    u = v.cast("long").bitwiseAND(F.lit(0xFFFFFFFF))
    return F.when(u < 1 << 7, 1).when(u < 1 << 14, 2).when(u < 1 << 21, 3).when(u < 1 << 28, 4).otherwise(5)


def zigzag(v: Column) -> Column:
    """32-bit ZigZag, as a non-negative long."""
    w = v.cast("long")
    return F.when(w >= 0, w * 2).otherwise(w * -2 - 1).bitwiseAND(F.lit(0xFFFFFFFF))


def fmt_bytes(n: Column) -> Column:
    a = F.abs(n)
    g, m, k = float(1 << 30), float(1 << 20), 1024.0
    return (
        F.when(a >= g, F.format_string("%.2f GiB", n / g))
        .when(a >= m, F.format_string("%.1f MiB", n / m))
        .when(a >= k, F.format_string("%.1f KiB", n / k))
        .otherwise(F.format_string("%d B", js_round(n.cast("double")).cast("long")))
    )


def factor(a: Column, b: Column) -> Column:
    return F.when(b != 0, F.format_string("%.2f×", a / b))


def uuid_bytes(s: Column) -> Column:
    return F.unhex(F.replace(s, F.lit("-"), F.lit("")))


def uuid_text(b: Column) -> Column:
    h = F.lower(F.hex(b))
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.substring(h, 13, 4), F.substring(h, 17, 4), F.substring(h, 21, 12))


def field_text(b: Column) -> Column:
    """A field back to its id: 16 bytes are a UUID, all else is text."""
    return F.when(F.octet_length(b) == 16, uuid_text(b)).otherwise(F.decode(b, "UTF-8"))


#: segment tests of key_pattern, in order (fixed values)
_SEGMENTS = (
    (r"^\{.*\}$", "{*}"),
    (r"(?i)^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$", "<uuid>"),
    (r"^-?[0-9]+$", "<n>"),
    (r"(?i)^[0-9a-f]{8,}$", "<hex>"),
    (r"^[A-Za-z0-9_-]{16,}$", "<id>"),
)


def key_pattern(key: Column) -> Column:
    """A key with the varying parts of its segments collapsed."""

    def segment(s: Column) -> Column:
        out = None
        for pattern, name in _SEGMENTS:
            out = F.when(s.rlike(pattern), name) if out is None else out.when(s.rlike(pattern), name)
        return out.otherwise(s)

    return F.array_join(F.transform(F.split(key, ":"), segment), ":")


def looks_json(value: Column) -> Column:
    return F.coalesce(F.substring(value, 1, 1).isin("{", "["), F.lit(False))


def dollars(n: Column, per_gib: float = 12.93) -> Column:
    return n / float(1 << 30) * per_gib
