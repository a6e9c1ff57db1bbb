"""Structured Streaming twins of the batch operators.  Each runs over what is there now and stops; the same plan runs for ever with another trigger."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.state import LEGAL
from ..sources.shared import fresh_path


def source(spark: SparkSession, path: str, files_per_trigger: int = 16) -> DataFrame:
    """A Parquet folder, or one file, as a stream; what one trigger reads is bounded."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    reader = spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", files_per_trigger)
    if at.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(at).isDirectory():
        return reader.parquet(path)
    return reader.option("pathGlobFilter", at.getName()).parquet(at.getParent().toString())


def settle(stream: DataFrame, mode: str, label: str) -> DataFrame:
    """Runs the stream over all that is there and gives its table.  complete: the last batch's rows; else every batch's, with its number as `batch`."""
    spark = stream.sparkSession
    path = fresh_path(spark, label)

    def write(rows: DataFrame, batch: int) -> None:
        if mode == "complete":
            rows.write.mode("overwrite").parquet(path)
        else:
            rows.withColumn("batch", F.lit(batch)).write.mode("overwrite").parquet(f"{path}/batch_id={batch}")

    query = stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", fresh_path(spark, f"{label}-state")).trigger(availableNow=True).start()
    query.awaitTermination()
    out = spark.read.parquet(path)
    return out.drop("batch_id")


def rollup(events: DataFrame, minutes: int = 60, late: str = "2 hours") -> DataFrame:
    """Averages by event-time window; the watermark bounds the state."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return timed.groupBy(F.window("ts", f"{minutes} minutes").alias("w"), "event_type").agg(F.avg("value").alias("avg"), F.count("*").alias("n")).select("event_type", F.unix_seconds("w.start").alias("bucket"), "avg", "n")


def first_seen(events: DataFrame, keys: list[str], late: str | None = None) -> DataFrame:
    """The first row of each key; with `late` a key is forgotten after that time, which bounds the state."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp"))
    return timed.withWatermark("ts", late).dropDuplicatesWithinWatermark(keys) if late else timed.dropDuplicates(keys)


def fold_states(events: DataFrame) -> DataFrame:
    """user_id, status, version, rejected after each trigger; events: user_id, target, ts, event_id.  Within a trigger rows are taken in order of time."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        status, version, rejected = state.get if state.exists else (0, 0, 0)
        rows = pd.concat(list(frames)).sort_values(["ts", "event_id"])
        for target in rows["target"]:
            if target in LEGAL[status]:
                status, version = int(target), version + 1
            else:
                rejected += 1
        state.update((status, version, rejected))
        yield pd.DataFrame({"user_id": [key[0]], "status": [status], "version": [version], "rejected": [rejected]})

    return events.groupBy("user_id").applyInPandasWithState(step, "user_id long, status int, version long, rejected long", "status int, version long, rejected long", "update", GroupStateTimeout.NoTimeout)


def latest(rows: DataFrame, key: str) -> DataFrame:
    """The last batch's row of each key."""
    rest = [c for c in rows.columns if c not in (key, "batch")]
    return rows.groupBy(key).agg(F.max_by(F.struct(*rest), "batch").alias("r")).select(key, "r.*")
