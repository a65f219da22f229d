"""Evaluation reports (one per model and dataset) and ranked summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SERIES = "struct<sector: string, site: string, target: double, prediction: double, squared_error: double>"
SCHEMA = f"model_id string, timestamp_utc string, num_series int, num_samples int, rmse double, per_series array<{SERIES}>"

#: Spellings of datasets in file names, and what they mean; longer ones first.
DATASETS = {"instant_short": "instant_short", "intant_short": "instant_short", "original": "original", "orignal": "original", "instant": "instant"}


def normalize_dataset(name: str) -> str:
    """The dataset a name in any known spelling stands for; ValueError for others."""
    key = name.lower()
    if key not in DATASETS:
        raise ValueError(f"unknown dataset {name!r}; known are {sorted(set(DATASETS))}")
    return DATASETS[key]


def build_reports(scored: DataFrame, num_samples: int = 32, stamp: str | None = None, most_series: int = 100_000) -> DataFrame:
    """dataset, and the report's fields: series sorted by sector within each report.

    A report of more than ``most_series`` series comes in several rows, each
    with the figures of the whole and about so many of the series, so that no
    row grows with the data.
    """
    row = F.struct("sector", "site", "target", "prediction", "squared_error")
    when = F.lit(stamp) if stamp else F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX")
    head = scored.groupBy("dataset", "model_id").agg(F.count("*").cast("int").alias("num_series"), F.sqrt(F.avg("squared_error")).alias("rmse"))
    part = F.pmod(F.xxhash64("sector"), F.ceil(F.col("num_series") / most_series))
    dealt = scored.join(head, ["dataset", "model_id"]).withColumn("_part", part)
    grouped = dealt.groupBy("dataset", "model_id", "num_series", "rmse", "_part").agg(F.sort_array(F.collect_list(row)).alias("per_series"))
    return grouped.select("dataset", "model_id", when.alias("timestamp_utc"), "num_series", F.lit(num_samples).alias("num_samples"), "rmse", "per_series")


def write_reports(reports: DataFrame, path: str, mode: str = "error") -> None:
    """JSON in a folder per dataset, one row of ``build_reports`` a file."""
    reports.write.mode(mode).option("maxRecordsPerFile", 1).partitionBy("dataset").json(path)


def read_reports(spark: SparkSession, path: str) -> DataFrame:
    """One row per (dataset, model, sector) of multi-line JSON reports; the dataset comes from the file's or the folder's name."""
    names = "|".join(sorted(DATASETS, key=len, reverse=True))
    raw = spark.read.schema(SCHEMA).option("multiLine", True).option("recursiveFileLookup", True).json(path)
    file = F.regexp_extract(F.col("_metadata.file_path"), rf"(?:_|dataset=)({names})(?:\.json$|/)", 1)
    table = F.create_map(*[F.lit(x) for pair in DATASETS.items() for x in pair])
    each = raw.select(F.try_element_at(table, file).alias("dataset"), "model_id", "timestamp_utc", "num_series", "num_samples", "rmse", F.explode_outer("per_series").alias("s"))
    return each.select("dataset", "model_id", "timestamp_utc", "num_series", "num_samples", "rmse", "s.*")


def write_summary(summary: DataFrame, path: str, mode: str = "error") -> None:
    """model_id, rmse, parameters as one CSV file: a row per model."""
    summary.select("model_id", "rmse", "parameters").coalesce(1).write.mode(mode).csv(path, header=True)


def read_summary(spark: SparkSession, path: str) -> DataFrame:
    """model_id, rmse, parameters of a summary file."""
    return spark.read.schema("model_id string, rmse double, parameters string").csv(path, header=True)
