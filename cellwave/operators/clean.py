"""Cleaning of raw traffic tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellwave.functions.dates import normalize_timestamp
from cellwave.functions.numbers import to_number

#: Names in exports and the names they get; of several for one, the last that is there counts.
RENAMES = {"secteur": "sector", "tstamp": "timestamp", "trafic_mbps": "value", "psi_instant": "value"}


def standardize_columns(df: DataFrame) -> DataFrame:
    """Columns sector, timestamp, value and site (the sector where there is none), and those besides; ValueError if one of the first three is missing."""
    names = {a: b for a, b in RENAMES.items() if a in df.columns}
    if len(set(names.values())) < len(names):
        raise ValueError("both trafic_mbps and psi_instant are there")
    out = df.withColumnsRenamed(names)
    missing = {"sector", "timestamp", "value"} - set(out.columns)
    if missing:
        raise ValueError(f"columns {sorted(missing)} are missing; found {df.columns}")
    return out if "site" in out.columns else out.withColumn("site", F.col("sector"))


def drop_blank_rows(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Without the rows in which all (or all the given) columns are null."""
    return df.na.drop("all", subset=columns)


def coerce_required(df: DataFrame) -> DataFrame:
    """value as a number, timestamp as a trimmed text; without rows where sector, timestamp or value is null then."""
    typed = df.withColumn("value", to_number(F.col("value"))).withColumn("timestamp", F.trim(F.col("timestamp").cast("string")))
    return typed.na.drop(subset=["sector", "timestamp", "value"])


def canonical(df: DataFrame) -> DataFrame:
    """The long table later operators take: timestamp_iso added, value called trafic_mbps."""
    clean = coerce_required(standardize_columns(df))
    return clean.withColumn("timestamp_iso", normalize_timestamp(F.col("timestamp"))).withColumnRenamed("value", "trafic_mbps")
