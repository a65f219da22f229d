"""Series as tokens: context, scale, bins, and quantiles of bins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cellwave.operators.rank import ranked


def last_context(df: DataFrame, size: int | None, sector: str = "sector", order: tuple[str, ...] = ("first_seq", "row_seq")) -> DataFrame:
    """The ``size`` points of each series before its last one, numbered by pos, 1 to ``size``; shorter ones begin later.

    Without a ``size`` all points but the last, numbered from 1. A series may
    have any number of points (``ranked``); ``series.all_but_last`` does without
    the numbers.
    """
    if size is None:
        rows = ranked(df, sector, [F.col(c) for c in order], "pos", "_size")
        return rows.filter(F.col("pos") < F.col("_size")).drop("_size")
    rows = ranked(df, sector, [F.col(c).desc() for c in order], "_back")
    return rows.filter((F.col("_back") > 1) & (F.col("_back") <= size + 1)).withColumn("pos", F.lit(size + 2) - F.col("_back")).drop("_back")


def padded_context(context: Column, size: int) -> Column:
    """An array's last ``size`` values, with nulls on the left where it is shorter."""
    n = F.size(context)
    tail = F.slice(context, F.greatest(n - size + 1, F.lit(1)), F.lit(size))
    return F.concat(F.array_repeat(F.lit(None).cast("double"), F.greatest(F.lit(size) - n, F.lit(0))), tail)


def mean_scale(df: DataFrame, value: str = "trafic_mbps", sector: str = "sector") -> DataFrame:
    """scale (the mean of absolute values in the series, 1 where that is 0) and scaled = value / scale."""
    s = df.groupBy(sector).agg(F.avg(F.abs(value)).alias("_s"))
    joined = df.join(s, sector).withColumn("scale", F.when(F.col("_s") > 0, F.col("_s")).otherwise(1.0)).drop("_s")
    return joined.withColumn("scaled", F.col(value) / F.col("scale"))


def quantize(df: DataFrame, bins: int = 4094, low: float = -15.0, high: float = 15.0, value: str = "scaled", out: str = "bin") -> DataFrame:
    """The number, from 1, of the bin of each value: centres are even from low to high, borders half-way, the ends open."""
    step = (high - low) / (bins - 1)
    at = F.floor((F.col(value) - low) / step + 0.5) + 1
    return df.withColumn(out, F.least(F.lit(bins), F.greatest(F.lit(1), at)).cast("int"))


def dequantize(df: DataFrame, bins: int = 4094, low: float = -15.0, high: float = 15.0, bin: str = "bin", out: str = "restored") -> DataFrame:
    """The centre of each bin, times scale."""
    step = (high - low) / (bins - 1)
    return df.withColumn(out, (F.lit(low) + (F.col(bin) - 1) * step) * F.col("scale"))


def quantiles_from_bins(df: DataFrame, levels: tuple[float, ...], keys: tuple[str, ...] = ("sector", "step"), bin: str = "bin", p: str = "p") -> DataFrame:
    """keys, level, bin: the first bin whose cumulated probability reaches the level, for rows of (keys, bin, p)."""
    upto = F.sum(p).over(W.partitionBy(*keys).orderBy(bin).rowsBetween(W.unboundedPreceding, 0))
    summed = df.withColumn("_upto", upto).withColumn("level", F.explode(F.array(*[F.lit(x) for x in levels])))
    return summed.filter(F.col("_upto") >= F.col("level") - 1e-12).groupBy(*keys, "level").agg(F.min(bin).alias(bin))
