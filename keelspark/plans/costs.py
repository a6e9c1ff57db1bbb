"""Queries over the capacity and cost model."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.sizes import dollars, factor, fmt_bytes
from ..operators import capacity as C
from ..sources.keyspace import keyspace
from . import sqltext as T
from .registry import query

_LINES = "(VALUES " + ", ".join(f"('{n}', {r}::BIGINT, {a}::DOUBLE, {b}::DOUBLE)" for n, r, a, b in C.LINES) + ") l(component, records, naive_bytes, opt_bytes)"
_TOTAL = f"SELECT sum(records * naive_bytes) AS n, sum(records * opt_bytes) AS o FROM {_LINES}"


@query("capacity_lines", f"SELECT component, records, round(records * naive_bytes, 2) AS naive_total, round(records * opt_bytes, 2) AS opt_total, round(naive_bytes / opt_bytes, 2) AS factor FROM {_LINES}")
def capacity_lines(spark, d):
    return C.lines(spark).select("component", "records", F.round("naive_total", 2).alias("naive_total"), F.round("opt_total", 2).alias("opt_total"), "factor")


@query("capacity_total", f"SELECT CAST(floor(n + 0.5) AS BIGINT) AS naive_total, CAST(floor(o + 0.5) AS BIGINT) AS opt_total, round(n / o, 2) AS factor, printf('%.2f×', n / o) AS label FROM ({_TOTAL})")
def capacity_total(spark, d):
    return C.totals(C.lines(spark)).select(F.floor(F.col("naive_total") + 0.5).alias("naive_total"), F.floor(F.col("opt_total") + 0.5).alias("opt_total"), "factor", factor(F.col("naive_total"), F.col("opt_total")).alias("label"))


@query("capacity_pricing", f"SELECT sku, round(a / u, 2) AS per_usable, CAST(floor(n / 1073741824 * a / u + 0.5) AS BIGINT) AS naive, CAST(floor(o / 1073741824 * a / u + 0.5) AS BIGINT) AS optimized FROM (VALUES " + ", ".join(f"('{s}', {a}::DOUBLE, {u}::DOUBLE)" for s, a, u in C.SKUS) + f") s(sku, a, u), ({_TOTAL})")
def capacity_pricing(spark, d):
    return C.pricing(C.lines(spark))


@query("capacity_ladder", f"SELECT step, CAST(floor(o / 1073741824 * (9.70::DOUBLE / 0.75) * times + 0.5) AS BIGINT) AS monthly FROM (VALUES ('advertised', 0.75::DOUBLE), ('reserved', 1.0), ('replica', 2.0), ('synchronous', 2.36)) t(step, times), ({_TOTAL})")
def capacity_ladder(spark, d):
    return C.ladder(C.lines(spark))


@query("attributable_bytes", f"WITH {T.KEYS} SELECT type, CAST(sum(memory) AS BIGINT) AS used, CAST(sum(memory) - sum(CASE WHEN type = 'stream' THEN 24 ELSE 0 END) AS BIGINT) AS attributable FROM keys GROUP BY type")
def attributable_bytes(spark, d):
    return keyspace(spark, d).groupBy("type").agg(F.sum("memory").alias("used"), (F.sum("memory") - F.sum(F.when(F.col("type") == "stream", 24).otherwise(0))).alias("attributable"))


@query("capacity_labels", "SELECT component, CASE WHEN b >= 1073741824 THEN printf('%.2f GiB', b / 1073741824) WHEN b >= 1048576 THEN printf('%.1f MiB', b / 1048576) ELSE printf('%.1f KiB', b / 1024) END AS size, round(b / 1073741824 * 12.93, 2) AS usd FROM (SELECT component, records * opt_bytes AS b FROM " + _LINES + ")")
def capacity_labels(spark, d):
    return C.lines(spark).select("component", fmt_bytes(F.col("opt_total")).alias("size"), F.round(dollars(F.col("opt_total")), 2).alias("usd"))
