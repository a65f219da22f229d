"""Generated series against observed ones: range, sums per bin, alignment, scale."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def clip_to_range(fine: DataFrame, coarse: DataFrame, sector: str = "secteur", time: str = "timestamp", coarse_time: str = "dates_5min") -> DataFrame:
    """The fine rows within their sector's first and last coarse time, both included."""
    bounds = coarse.groupBy(sector).agg(F.min(coarse_time).alias("_from"), F.max(coarse_time).alias("_to"))
    return fine.join(bounds, sector).filter((F.col(time) >= F.col("_from")) & (F.col(time) <= F.col("_to"))).drop("_from", "_to")


def normalize_by_max(df: DataFrame, value: str, sector: str = "secteur", out: str = "normalized") -> DataFrame:
    """``out`` = value / its sector's maximum; the value itself where that is not positive. The maxima are joined back, so no sector is gathered."""
    top = df.groupBy(sector).agg(F.max(value).alias("_top"))
    scaled = F.when(F.col("_top") > 0, F.col(value) / F.col("_top")).otherwise(F.col(value))
    return df.join(top, sector).withColumn(out, scaled).drop("_top")


def resample_sum(df: DataFrame, width: str = "5 minutes", sector: str = "secteur", time: str = "timestamp", value: str = "psi_instant", fill: bool = False) -> DataFrame:
    """Sums by sector and bin (its start, as ``time``), nulls left out, 0 where all are null.

    With ``fill`` the empty bins between a sector's first and last get 0 too.
    """
    sums = df.filter(F.col(time).isNotNull()).groupBy(sector, F.window(time, width).alias("w")).agg(F.coalesce(F.sum(value), F.lit(0.0)).alias(value))
    sums = sums.select(sector, F.col("w.start").alias(time), value)
    if not fill:
        return sums
    ends = sums.groupBy(sector).agg(F.min(time).alias("a"), F.max(time).alias("b"))
    bins = ends.select(sector, F.explode(F.expr(f"sequence(a, b, interval {width})")).alias(time))
    return bins.join(sums, [sector, time], "left").withColumn(value, F.coalesce(value, F.lit(0.0)))


def align_slots(coarse: DataFrame, fine: DataFrame, sector: str = "secteur", time: str = "dates_5min", fine_time: str = "timestamp") -> DataFrame:
    """Coarse rows with the fine row of the same sector and time."""
    return coarse.join(fine.withColumnRenamed(fine_time, time), [sector, time])


def unaligned_sectors(coarse: DataFrame, fine: DataFrame, sector: str = "secteur", time: str = "dates_5min", fine_time: str = "timestamp") -> DataFrame:
    """Sectors of ``coarse`` that have no row in ``align_slots``."""
    return coarse.select(sector).distinct().join(align_slots(coarse, fine, sector, time, fine_time).select(sector), sector, "left_anti")


def normalize_aligned(df: DataFrame, left: str = "trafic_mbps", right: str = "psi_instant", sector: str = "secteur") -> DataFrame:
    """y_real and y_gen: both sides by their own maximum in the sector; null where that is 0."""
    top = df.groupBy(sector).agg(F.max(left).alias("_l"), F.max(right).alias("_r"))
    return df.join(top, sector).withColumn("y_real", F.col(left) / F.nullif("_l", F.lit(0.0))).withColumn("y_gen", F.col(right) / F.nullif("_r", F.lit(0.0))).drop("_l", "_r")
