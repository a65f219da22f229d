"""Ranks within groups of any size: no group is one task, however many of the rows it holds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cellwave.sources.shared import stored

def ranked(df: DataFrame, key: str, order: list[Column], out: str = "rank", size: str | None = None) -> DataFrame:
    """``df`` with ``out``, the place from 1 of each row in its group by ``order``, and, if named, ``size``, the group's rows.

    Rows are dealt by ranges of key and order, so a large group spans many
    partitions; each row knows its place in its partition, and the rows of each
    key in the partitions before are added. These counts, one row for each
    partition and key in it, are all that a window sorts. The dealt rows are
    written to the shared folder first, as ranges come from a sample that
    another run would draw anew. Rows that are equal in key and order are not
    parted. A null key is a group of its own.
    """
    names = {c: f"c{i}" for i, c in enumerate(df.columns)}  # of its own, so that the columns may have any
    dealt = df.repartitionByRange(F.col(f"`{key}`"), *order).sortWithinPartitions(F.col(f"`{key}`"), *order)
    dealt = dealt.select(*[F.col(f"`{c}`").alias(n) for c, n in names.items()], F.monotonically_increasing_id().alias("id"))
    dealt = stored(dealt, "ranks").withColumn("part", F.shiftright("id", 33))
    counts = dealt.groupBy("part", F.col(names[key]).alias("key")).agg(F.min("id").alias("first"), F.count("*").alias("n"))
    before = F.sum("n").over(W.partitionBy("key").orderBy("part")) - F.col("n")
    offsets = counts.withColumn("before", before).withColumn("all", F.sum("n").over(W.partitionBy("key"))).withColumnRenamed("part", "at")
    joined = dealt.join(offsets, (F.col("part") == F.col("at")) & F.col(names[key]).eqNullSafe(F.col("key")))
    found = [(F.col("id") - F.col("first") + F.col("before") + 1).alias(out)]
    if size is not None:
        found.append(F.col("all").alias(size))
    return joined.select(*[F.col(n).alias(c) for c, n in names.items()], *found)
