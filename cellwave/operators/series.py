"""Order, slots and examples of sector series.

``row_seq`` is a column that gives the order of rows in their file.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cellwave.operators.rank import ranked


def sort_series(df: DataFrame, sector: str = "secteur", time: str = "tstamp", seq: str = "row_seq") -> DataFrame:
    """Rows by sector and time, null times last, ties in file order: dealt by range and sorted within partitions, which is a total order."""
    order = [F.col(sector).asc_nulls_last(), F.col(time).asc_nulls_last(), F.col(seq)]
    return df.repartitionByRange(*order).sortWithinPartitions(*order)


def assign_slots(df: DataFrame, start: str = "2025-01-01", minutes: int = 5, sector: str = "secteur", time: str = "tstamp", seq: str = "row_seq") -> DataFrame:
    """dates_5min: the i-th row of a sector, from 0, gets ``start`` and i slots. Rows without a sector vanish; a sector may have any number of rows (``ranked``)."""
    rows = ranked(df.filter(F.col(sector).isNotNull()), sector, [F.col(time).asc_nulls_last(), F.col(seq)], "_rank")
    stamp = F.lit(start).cast("timestamp") + F.make_dt_interval(mins=((F.col("_rank") - 1) * minutes).cast("int"))
    return rows.withColumn("dates_5min", stamp).drop("_rank")


def first_appearance_order(df: DataFrame, stamp: str = "timestamp_iso", seq: str = "row_seq") -> DataFrame:
    """first_seq: where a row's stamp first appears in the whole file. Series ordered by it follow the file, not the calendar."""
    first = df.groupBy(stamp).agg(F.min(seq).alias("first_seq"))
    return df.join(first, stamp)


def min_length(df: DataFrame, n: int = 2, sector: str = "sector") -> DataFrame:
    """Without the rows of sectors that have fewer than ``n``; counts are joined back, so no sector is sorted for it."""
    long = df.groupBy(sector).agg(F.count("*").alias("_n")).filter(F.col("_n") >= n).select(sector)
    return df.join(long, sector, "left_semi")


def build_examples(df: DataFrame, order: str = "file", max_context: int | None = None, stamps: bool = True, sector: str = "sector", value: str = "trafic_mbps", stamp: str = "timestamp_iso", seq: str = "row_seq") -> DataFrame:
    """One row per sector of two points and more: sector, site, timestamps (all), context (all values but the last), target, context_length.

    ``order`` is ``file`` (see ``first_appearance_order``) or ``time``. With
    ``max_context`` only so many points before the last are collected, which
    bounds a row however long a series is; without ``stamps`` no timestamps are.
    """
    rows = first_appearance_order(df, stamp, seq) if order == "file" else df.withColumn("first_seq", F.col(stamp))
    rows = rows.filter(F.col(sector).isNotNull())
    if max_context is not None:
        newest = W.partitionBy(sector).orderBy(F.col("first_seq").desc(), F.col(seq).desc())
        rows = rows.withColumn("_back", F.row_number().over(newest)).filter(F.col("_back") <= max_context + 1)
    point = F.struct(F.col("first_seq").alias("a"), F.col(seq).alias("b"), F.col(value).alias("v"), F.col("site").alias("site"), (F.col(stamp) if stamps else F.lit(None).cast("string")).alias("t"))
    grouped = rows.groupBy(sector).agg(F.sort_array(F.collect_list(point)).alias("p")).filter(F.size("p") >= 2)
    n = F.size("p")
    return grouped.select(
        F.col(sector).alias("sector"),
        F.col("p")[0]["site"].alias("site"),
        (F.transform("p", lambda x: x["t"]) if stamps else F.array().cast("array<string>")).alias("timestamps"),
        F.transform(F.slice("p", F.lit(1), n - 1), lambda x: x["v"]).alias("context"),
        F.element_at("p", -1)["v"].alias("target"),
        (n - 1).alias("context_length"),
    )


def all_but_last(df: DataFrame, sector: str = "sector", order: tuple[str, ...] = ("first_seq", "row_seq")) -> DataFrame:
    """The rows of each series but its last one, by an aggregation and a join alone."""
    ends = df.groupBy(F.col(sector).alias("_of")).agg(F.max(F.struct(*order)).alias("_end"))
    return df.join(ends, F.col(sector) == F.col("_of")).filter(F.struct(*order) < F.col("_end")).drop("_of", "_end")


def last_values(df: DataFrame, sector: str = "sector", value: str = "trafic_mbps", order: str = "first_seq", seq: str = "row_seq") -> DataFrame:
    """sector, target: the last value of each series, by an aggregation alone."""
    return df.groupBy(sector).agg(F.max_by(value, F.struct(order, seq)).alias("target"))


def profile_contexts(df: DataFrame, sector: str = "sector", stamp: str = "timestamp_iso") -> DataFrame:
    """One row: examples, sectors, points, the shortest, longest and mean context, first and last stamp."""
    per = df.groupBy(sector).agg(F.count("*").alias("n"), F.min(stamp).alias("first"), F.max(stamp).alias("last"))
    length = F.when(F.col("n") >= 2, F.col("n") - 1)
    return per.agg(
        F.count(length).alias("examples"), F.count("*").alias("sectors"), F.sum("n").alias("points"), F.min(length).alias("min_context"),
        F.max(length).alias("max_context"), F.avg(length).alias("mean_context"), F.min("first").alias("first_stamp"), F.max("last").alias("last_stamp"),
    )
