"""Connected components of a graph given by its edges, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellwave.llm.store import cut, drop


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """node, label: the least node of each node's component, for every node of an edge (a, b).

    Each round ties a node's larger neighbours to its least neighbour, then its
    smaller ones, which halves the depth of the trees or better. Both steps are
    an aggregation, whose result is written, and a join that Spark can split, so
    that a node with a third of all edges is no task of its own. It ends when
    every node but the labels has one edge, to a label; only two counts that
    tell this reach the driver. Should ``most_rounds`` not be enough, which for
    any graph of fewer than 2 ** 30 nodes would be a fault, it raises.
    """
    now = cut(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    for _ in range(most_rounds):
        told = now.agg(F.count("*").alias("n"), F.countDistinct("a").alias("nodes")).first()
        if told["n"] == told["nodes"] and now.select(F.col("b").alias("a")).join(now.select("a"), "a", "left_semi").isEmpty():
            break
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = cut(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("v"), F.least("a", "m").alias("m")), "least")
        large = both.join(least, both["a"] == least["v"]).filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        large = cut(large, "edges")
        lower = cut(large.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("v"), "m"), "lower")
        tied = large.join(lower, large["a"] == lower["v"])
        small = tied.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(lower.select(F.col("v").alias("a"), F.col("m").alias("b")))
        before, now = now, cut(small.filter("a <> b").distinct(), "edges")
        drop(before, least, large, lower)
    else:
        raise RuntimeError(f"the components are not settled after {most_rounds} rounds")
    labels = now.select(F.col("b").alias("node")).distinct().select("node", F.col("node").alias("label"))
    return now.select(F.col("a").alias("node"), F.col("b").alias("label")).unionByName(labels)
