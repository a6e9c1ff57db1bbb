"""Order over a whole table without one task that sees all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import saved

#: rows of a range, about; small tables get the session's number of shuffle partitions
RANGE_ROWS = 2_000_000


def _ranged(df: DataFrame, keys: list[Column]) -> DataFrame:
    """df dealt into ranges of all sort keys and sorted, with _part (the range) and _place (0, 1, ... within it), in the shared folder, so that
    both stay what they are however often they are read.  Ties are part of the keys: one value repeated very often is spread like any others."""
    n = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-df.count() // RANGE_ROWS))
    told = df.repartitionByRange(n, *keys).sortWithinPartitions(*keys).withColumn("_at", F.monotonically_increasing_id())
    return saved(told, "ranges").withColumn("_part", F.shiftright("_at", 33)).withColumn("_place", F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))).drop("_at")


def _offsets(parts: DataFrame, measure: Column) -> DataFrame:
    """_part, _offset: the measure's sum over all ranges before; one row per range."""
    sums = parts.groupBy("_part").agg(measure.alias("_measure"))
    before = F.sum("_measure").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    return sums.withColumn("_offset", F.coalesce(before, F.lit(0))).select("_part", "_offset")


def _keys(column: str, ascending: bool, tie: list[str] | None) -> list[Column]:
    return [F.col(c).asc() if ascending else F.col(c).desc() for c in [column, *(tie or [])]]


def numbered(df: DataFrame, keys: list[Column], name: str = "rank") -> DataFrame:
    """df with 1, 2, ... in the order of keys.  Ranges are counted, one number each, and every range is numbered from the count before it."""
    parts = _ranged(df, keys)
    return parts.join(F.broadcast(_offsets(parts, F.count("*"))), "_part").withColumn(name, F.col("_offset") + F.col("_place") + 1).drop("_part", "_place", "_offset")


#: rows of a key beyond which its row is broadcast instead of shuffled to
HOT_ROWS = 100_000


def lookup(rows: DataFrame, keyed: DataFrame, key: list[str], times: str, hot: int = HOT_ROWS) -> DataFrame:
    """rows joined to keyed, which has one row for each key and its number of rows in `times`.  Keys with more than `hot` rows, at most the table's
    rows divided by `hot`, are broadcast, so that a key with a third of all rows is spread over all tasks."""
    often = keyed.where(F.col(times) > hot)
    if not often.limit(1).count():
        return rows.join(keyed, key)
    return rows.join(F.broadcast(often), key).unionByName(rows.join(F.broadcast(often.select(key)), key, "left_anti").join(keyed.where(F.col(times) <= hot), key))


def numbered_in(df: DataFrame, by: list[str], order: list[str], hot: int = HOT_ROWS) -> DataFrame:
    """df with row (1, 2, ... within its group, in order) and rows (the group's number).  Groups are runs of one global order, so a group with a third of
    all rows is spread over many tasks.  The columns of `by` hold no nulls."""
    told = saved(numbered(df, [*map(F.asc, by), *map(F.asc, order)], "_rank"), "numbered")
    groups = told.groupBy(*by).agg(F.min("_rank").alias("_first"), F.count("*").alias("rows"))
    return lookup(told, groups, by, "rows", hot).withColumn("row", F.col("_rank") - F.col("_first") + 1).drop("_rank", "_first")


def with_rows_before(df: DataFrame, by: list[str], order: list[str], values: list[str], back: int, block: int = RANGE_ROWS) -> DataFrame:
    """df with before: the values of the `back` rows before in the group and the row itself, oldest first, nulls where there are none.  The global order is
    cut into blocks, and a block's last rows go to the next one too, so no group is one task's work."""
    told = numbered(df, [*map(F.asc, by), *map(F.asc, order)], "_rank")
    at = F.floor((F.col("_rank") - 1) / block)
    last = F.col("_rank") - 1 - at * block >= block - back
    dealt = told.withColumn("_block", F.explode(F.when(last, F.array(at, at + 1)).otherwise(F.array(at))))
    w = Window.partitionBy("_block").orderBy("_rank")
    same = lambda i: F.lag(F.struct(*by), i).over(w).eqNullSafe(F.struct(*by))
    rows = [F.when(same(i), F.lag(F.struct(*values), i).over(w)) for i in range(back, 0, -1)]
    return dealt.withColumn("before", F.array(*rows, F.struct(*values))).where(F.col("_block") == at).drop("_block", "_rank")


def global_rank(df: DataFrame, column: str, ascending: bool = True, tie: list[str] | None = None) -> DataFrame:
    """df with rank: 1, 2, ... in the order of a column and tie."""
    return numbered(df, _keys(column, ascending, tie))


def global_running_sum(df: DataFrame, value: str, column: str, tie: list[str], name: str = "running", ascending: bool = True) -> DataFrame:
    """df with the running sum of value in the order of a column and tie, the row included, by the same two steps."""
    parts = _ranged(df, _keys(column, ascending, tie))
    inside = parts.withColumn("_inside", F.sum(value).over(Window.partitionBy("_part").orderBy("_place").rowsBetween(Window.unboundedPreceding, 0)))
    return inside.join(F.broadcast(_offsets(parts, F.sum(value))), "_part").withColumn(name, F.col("_offset") + F.col("_inside")).drop("_part", "_place", "_offset", "_inside")
