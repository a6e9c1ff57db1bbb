"""What the training-data operators share: staged tables, tuning and Arrow helpers."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ordering import HOT_ROWS
from ..operators.ordering import lookup as hot_lookup
from ..sources.shared import fresh_path
from ..sources.tables import table  # noqa: F401  the operators' queries read by it


def prepare(spark: SparkSession) -> None:
    """Arrow batches bounded in bytes, so that very long texts do not pile up in a Python worker."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(8 << 20))


def staged(df: DataFrame, label: str) -> DataFrame:
    """Writes df as Parquet into the shared folder and reads it back: lineage ends here, lost executors cost no recomputation,
    and the shuffle files behind it are dropped as soon as the table is written."""
    spark = df.sparkSession
    path = fresh_path(spark, label)
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._keelspark_path = path
    return out


def discard(df: DataFrame) -> None:
    """Deletes a staged table that nothing reads any more."""
    path = getattr(df, "_keelspark_path", None)
    if path:
        jvm = df.sparkSession._jvm
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(at, True)


def map_batches(df: DataFrame, fn: Callable[[pa.RecordBatch], dict[str, list]], schema: str, arrow: pa.Schema) -> DataFrame:
    """df.mapInArrow with a function from a batch to columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_pydict(fn(batch), schema=arrow)

    return df.mapInArrow(run, schema)


def utf8(column: pa.Array) -> list[bytes]:
    """The column's strings as UTF-8 bytes; null is empty."""
    return [x or b"" for x in column.cast(pa.large_string() if pa.types.is_large_string(column.type) else pa.string()).cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()).to_pylist()]


def lookup(rows: DataFrame, keyed: DataFrame, key: str, hot: int = HOT_ROWS) -> DataFrame:
    """rows joined to keyed, which has one row for each key and its number of rows as `times`; keys with very many rows are broadcast."""
    return hot_lookup(rows, keyed, [key], "times", hot).drop("times")


def text_of(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
