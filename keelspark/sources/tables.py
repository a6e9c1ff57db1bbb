"""Batch sources: Parquet tables, JSON and text files; sinks for results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def json_source(spark: SparkSession, path: str, schema: str | None = None, lines: bool = False) -> DataFrame:
    """lines: one value to a line, which can be read in parts; else a value to a file."""
    reader = spark.read.option("multiLine", str(not lines).lower())
    return (reader.schema(schema) if schema else reader).json(path)


def word_list(spark: SparkSession, path: str | None, fallback: list[str]) -> DataFrame:
    """rank, word: a vocabulary, one word to a line; the fallback where there is no path."""
    words = spark.read.text(path).select(F.trim("value").alias("word")).where("word <> ''") if path else spark.createDataFrame([(w,) for w in fallback], "word string")
    return words.distinct()


def info(text: str) -> dict[str, str]:
    """`name:value` lines as a mapping; comment lines start with #."""
    return dict(line.strip().split(":", 1) for line in text.splitlines() if ":" in line and not line.startswith("#"))


def json_sink(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def markdown(df: DataFrame, most: int = 1000) -> str:
    """A result table as Markdown; for reports, so its rows are limited."""
    rows = df.limit(most).collect()
    line = lambda cells: "| " + " | ".join(map(str, cells)) + " |"
    return "\n".join([line(df.columns), line(["---"] * len(df.columns)), *(line(r) for r in rows)])
