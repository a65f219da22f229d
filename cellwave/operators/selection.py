"""Exact quantiles of groups of any size, in memory that does not grow with them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cellwave.sources.shared import stored


def exact_quantiles(df: DataFrame, key: str, value: str, levels: tuple[float, ...] = (0.5,), buckets: int = 1024, few: int = 4096) -> DataFrame:
    """key, level, quantile: at place level * (n - 1) of a group's n values in order, between two neighbours in proportion.

    Of each rank that is asked for an interval of values is known that holds
    it. A round counts the interval's values in ``buckets`` even parts, by an
    aggregation that Spark combines before it shuffles, so that a group with
    all rows is no task of its own, and goes on with the least and greatest
    value of the part with the rank. As these fall into unlike parts the next
    time, every round narrows the interval. Where ``few`` values are left they
    are ranked. The only tables are of ``buckets`` rows a rank at most. Null
    and NaN values are left out, and groups with nothing else. Values whose
    range is beyond the largest double are not allowed for.
    """
    rows = df.select(F.col(key).alias("_key"), F.col(value).cast("double").alias("_v")).filter("_v is not null and not isnan(_v)")
    of = F.array(*[F.lit(float(x)) for x in levels])
    ends = rows.groupBy("_key").agg(F.count("*").alias("n"), F.min("_v").alias("low"), F.max("_v").alias("high"))
    place = F.col("level") * (F.col("n") - 1)
    asked = ends.withColumn("level", F.explode(of)).withColumn("rank", F.explode(F.array_distinct(F.array(F.floor(place), F.ceil(place)))))
    wanted = asked.select("_key", "level", (place - F.floor(place)).alias("part"), "rank")
    state = stored(asked.select("_key", "rank", F.col("rank").alias("left"), "n", "low", "high").distinct(), "selection")
    done = state.filter("low = high")
    while True:
        state = state.filter("low < high")
        open_ = state.filter(F.col("n") > few)
        if open_.isEmpty():
            break
        near = state.filter(F.col("n") <= few)
        cell = F.least(F.lit(buckets - 1), F.floor((F.col("_v") - F.col("low")) / (F.col("high") - F.col("low")) * buckets))
        held = rows.join(open_.withColumnRenamed("_key", "_of"), F.col("_key").eqNullSafe(F.col("_of"))).filter("_v between low and high")
        counted = held.groupBy("_key", "rank", "left", cell.alias("cell")).agg(F.count("*").alias("n"), F.min("_v").alias("low"), F.max("_v").alias("high"))
        upto = F.sum("n").over(W.partitionBy("_key", "rank").orderBy("cell")) - F.col("n")
        found = counted.withColumn("before", upto).filter("before <= left and left < before + n")
        state = stored(found.select("_key", "rank", (F.col("left") - F.col("before")).alias("left"), "n", "low", "high").unionByName(near), "selection")
        done = done.unionByName(state.filter("low = high"))
    last = rows.join(state.withColumnRenamed("_key", "_of"), F.col("_key").eqNullSafe(F.col("_of"))).filter("_v between low and high")
    at = F.row_number().over(W.partitionBy("_key", "rank").orderBy("_v")) - 1
    picked = last.withColumn("at", at).filter("at = left").select("_key", "rank", "_v").unionByName(done.select("_key", "rank", F.col("low").alias("_v")))
    both = wanted.join(picked.withColumnsRenamed({"_key": "_of", "rank": "_rank"}), F.col("_key").eqNullSafe(F.col("_of")) & (F.col("rank") == F.col("_rank")))
    low, high = F.min("_v"), F.max("_v")
    return both.groupBy("_key", "level").agg((low + (high - low) * F.max("part")).alias("quantile")).withColumnRenamed("_key", key)
