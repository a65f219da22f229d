"""Examples (context and target of a series) as JSON lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

SCHEMA = "sector string, site string, timestamps array<string>, context array<double>, target double, context_length int"


def write_examples(df: DataFrame, path: str) -> None:
    """One object a line; what is there already stays. ValueError, and nothing written, if there is no example."""
    if df.isEmpty():
        raise ValueError("no series is long enough for an example")
    df.write.mode("ignore").json(path)


def read_examples(spark: SparkSession, path: str) -> DataFrame:
    """Blank lines are skipped; ValueError if there is no example."""
    found = spark.read.schema(SCHEMA).json(path).filter("sector is not null or context is not null")
    if found.isEmpty():
        raise ValueError(f"no examples in {path}")
    return found
