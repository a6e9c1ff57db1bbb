"""Vectors and their quantised forms as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .sizes import js_round


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def cosine(a: Column, b: Column, norm_a: Column | None = None, norm_b: Column | None = None) -> Column:
    """Cosine; a zero vector has cosine 0.  Norms that are known already are not computed again."""
    size = (norm(a) if norm_a is None else norm_a) * (norm(b) if norm_b is None else norm_b)
    return dot(a, b) / F.when(size == 0, 1.0).otherwise(size)


def normalize(a: Column) -> Column:
    n = norm(a)
    return F.transform(a, lambda x: (x / F.when(n == 0, 1.0).otherwise(n)).cast("float"))


def int8_scale(a: Column) -> Column:
    top = F.aggregate(a, F.lit(0.0), lambda m, x: F.greatest(m, F.abs(x.cast("double"))))
    return F.when(top == 0, 1e-9).otherwise(top / 127)


def int8_codes(a: Column, scale: Column) -> Column:
    return F.transform(a, lambda x: F.least(F.lit(127), F.greatest(F.lit(-127), js_round(x.cast("double") / scale))).cast("int"))


def int8_decode(codes: Column, scale: Column) -> Column:
    """Codes times the scale as it is stored, in single precision."""
    return F.transform(codes, lambda c: (c.cast("double") * scale.cast("float").cast("double")).cast("float"))


def sign_code(a: Column) -> Column:
    """One bit per dimension, the first lowest; 64 dimensions fit one long."""
    return F.aggregate(F.transform(a, lambda x, i: F.when(x > 0, F.call_function("shiftleft", F.lit(1).cast("long"), i)).otherwise(F.lit(0).cast("long"))), F.lit(0).cast("long"), lambda s, b: s.bitwiseOR(b))


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def reduced(a: Column, dim: int) -> Column:
    """The first `dim` coefficients of a Walsh-Hadamard transform, scaled so that all of them would keep the length."""
    sign = lambda i, j: F.lit(1) - F.lit(2) * (F.bit_count(i.bitwiseAND(j)) % 2)
    size = F.sqrt(F.size(a).cast("double"))
    coefficient = lambda i: F.aggregate(F.transform(a, lambda x, j: x.cast("double") * sign(i, j)), F.lit(0.0), lambda s, x: s + x)
    return F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: (coefficient(i) / size).cast("float"))


def storage_bytes(dim: Column, quant: Column) -> Column:
    return F.when(quant == "f32", dim * 4).when(quant == "f16", dim * 2).when(quant == "int8", dim + 4).when(quant == "binary", F.ceil(dim / 8)).cast("long")


def decoded(quant: str, codes: Column, scale: Column | None = None) -> Column:
    """Codes back to numbers, where that is possible: sign codes keep no magnitudes."""
    if quant == "int8":
        return int8_decode(codes, scale)
    if quant == "f32":
        return codes
    return F.raise_error(F.lit(f"{quant} codes cannot be decoded here")).cast("array<float>")
