"""Statistics of sectors and choices among them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def sector_stats(df: DataFrame, sector: str = "secteur", value: str = "trafic_mbps") -> DataFrame:
    """mu, var (sample variance, null for one point) and n of each sector, nulls left out."""
    return df.groupBy(sector).agg(F.avg(value).alias("mu"), F.var_samp(value).alias("var"), F.count(value).alias("n"))


def sector_cv2(stats: DataFrame) -> DataFrame:
    """cv2 added: var / mu ** 2, and 0.1 where mu is not positive."""
    return stats.withColumn("cv2", F.when(F.col("mu") > 0, F.col("var") / (F.col("mu") * F.col("mu"))).otherwise(0.1))


def rank_by_variance(df: DataFrame, sector: str = "secteur", value: str = "trafic_mbps") -> DataFrame:
    """Sectors and their variance, the highest first, null last, ties by name."""
    return df.groupBy(sector).agg(F.var_samp(value).alias("var")).orderBy(F.col("var").desc_nulls_last(), sector)


def top_variable_sectors(df: DataFrame, n: int = 5, sector: str = "secteur", value: str = "trafic_mbps") -> DataFrame:
    """The ``n`` sectors of the highest variance."""
    return rank_by_variance(df, sector, value).limit(n)


def subset_sectors(df: DataFrame, keys: DataFrame, sector: str = "secteur") -> DataFrame:
    """The rows of the sectors in ``keys``. Spark broadcasts the keys if they are small enough by its own measure."""
    return df.join(keys.select(sector).distinct(), sector, "left_semi")


def first_sectors(df: DataFrame, n: int = 10, sector: str = "secteur", seq: str = "row_seq") -> DataFrame:
    """The first ``n`` sectors by first appearance, with first_seq."""
    return df.filter(F.col(sector).isNotNull()).groupBy(sector).agg(F.min(seq).alias("first_seq")).orderBy("first_seq").limit(n)


def sector_max(df: DataFrame, sector: str, time: str, value: str) -> DataFrame:
    """t_min, t_max and v_max of each sector."""
    return df.groupBy(sector).agg(F.min(time).alias("t_min"), F.max(time).alias("t_max"), F.max(value).alias("v_max"))
