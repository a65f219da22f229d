import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from cellwave.operators import chunks, forecast, rank, selection, series, tokens
from cellwave.sources import shared


def test_one_sector_with_all_rows_is_spread(spark, monkeypatch):
    parts, real = [], shared.stored

    def stored(df, name):
        made = real(df, name)
        parts.append([r["count"] for r in made.groupBy(F.shiftright("id", 33)).count().collect()])
        return made

    monkeypatch.setattr(rank, "stored", stored)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # which puts small partitions together
    df = spark.range(0, 40_000, 1, 8).select(F.lit("S").alias("secteur"), F.pmod(F.xxhash64("id"), F.lit(10**12)).alias("t"), "id").union(spark.createDataFrame([("A", 1, -1), ("Z", 1, -2)], "secteur string, t long, id long"))
    got = rank.ranked(df, "secteur", [F.col("t"), F.col("id")], size="n")
    order = [r["id"] for r in got.filter("secteur = 'S'").orderBy("rank").select("id").collect()]
    want = [r["id"] for r in df.filter("secteur = 'S'").orderBy("t", "id").collect()]
    assert order == want and got.filter("secteur = 'S'").agg(F.min("rank"), F.max("rank"), F.max("n")).first() == (1, 40_000, 40_000)
    assert got.filter("secteur <> 'S'").select("rank", "n").distinct().collect() == [(1, 1)]
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(parts[0]) >= 4 and max(parts[0]) <= 2 * np.median(parts[0])


def test_ranks_with_nulls_ties_and_clashing_names(spark):
    rows = [("a", 2, 1), ("a", None, 2), ("a", 2, 3), (None, 5, 4), (None, 4, 5), ("b", 1, 6), ("b", 1, 6)]
    df = spark.createDataFrame(rows, "k string, t int, _n int").withColumn("before", F.lit("x")).withColumn("key", F.lit(1)).withColumn("c0", F.lit(2)).withColumn("a.b", F.lit(3))
    got = sorted(((r["k"] or "", r["t"] or 0, r["_n"], r["rank"]) for r in rank.ranked(df, "k", [F.col("t").asc_nulls_last(), F.col("_n")]).collect()))
    assert got == [("", 4, 5, 1), ("", 5, 4, 2), ("a", 0, 2, 3), ("a", 2, 1, 1), ("a", 2, 3, 2), ("b", 1, 6, 1), ("b", 1, 6, 2)]
    assert rank.ranked(df.limit(0), "k", [F.col("t")]).count() == 0


def points(spark, series_, parts=4):
    rows = [(s, "x", i, i * 7, float(v)) for s, values in series_.items() for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "sector string, site string, first_seq int, row_seq int, trafic_mbps double").repartition(parts)


def some_series():
    rng = random.Random(4)
    return {"long": [round(rng.expovariate(0.1), 2) for _ in range(5_000)], "zero": [0.0] * 9, "two": [3.0, 4.0], "one": [1.0], "odd": [rng.randrange(-9, 9) for _ in range(33)]}


@pytest.mark.parametrize("size", [1, 7, 64, 10_000])
def test_folds_are_whole_series(spark, size):
    every = some_series() if size > 1 else {k: v[:40] for k, v in some_series().items()}
    made = chunks.chunk_series(points(spark, every), size)
    assert made.agg(F.max(F.size("values"))).first()[0] <= size
    got = {(r["model_id"], r["sector"]): r["prediction"] for r in chunks.fold_forecasts(made, chunks.FOLDS).collect()}
    want = {}
    for name, f in (("last", forecast.last_value), ("mean", forecast.mean_value), ("binned", forecast.binned_median)):
        for s, values in every.items():
            if len(values) > 1:
                want[name, s] = f([np.array(values[:-1], float)], 1, 0)[0]
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 * max(1, abs(want[k])) for k in want)


def test_whole_series_keep_their_last_point(spark):
    made = chunks.chunk_series(points(spark, {"a": [1, 2, 3], "b": [5]}), 2, keep_last=True)
    assert sorted((r["sector"], r["chunk"], list(r["values"])) for r in made.collect()) == [("a", 0, [1.0, 2.0]), ("a", 1, [3.0]), ("b", 0, [5.0])]
    assert chunks.fold_forecasts(chunks.chunk_series(points(spark, {"a": [1]}).limit(0)), chunks.FOLDS).count() == 0


def test_contexts_are_all_but_the_last(spark):
    df = points(spark, some_series())
    whole = tokens.last_context(df, None)
    short = series.all_but_last(df)
    assert sorted(map(str, whole.drop("pos").collect())) == sorted(map(str, short.collect()))
    assert [r["pos"] for r in whole.filter("sector = 'odd'").orderBy("first_seq").collect()] == list(range(1, 33))
    last = tokens.last_context(df, 4).filter("sector in ('long', 'two')").orderBy("sector", "pos").collect()
    assert [(r["sector"], r["pos"], r["first_seq"]) for r in last] == [("long", i, 4994 + i) for i in (1, 2, 3, 4)] + [("two", 4, 0)]


@pytest.mark.parametrize("buckets,few", [(4, 0), (16, 5), (1024, 4096)])
def test_quantiles_are_exact(spark, monkeypatch, buckets, few):
    rng = random.Random(7)
    groups = {"skew": [rng.lognormvariate(0, 6) for _ in range(3_000)], "ties": [rng.choice([1.0, 2.0, 2.0, 5.0]) for _ in range(400)], "same": [4.0] * 50, "one": [9.0], "two": [1.0, 2.0], "wide": [-1e300, 1e-300, 0.0, 1e300], None: [3.0, 1.0, 2.0]}
    rows = [(k, v) for k, vs in groups.items() for v in vs] + [("none", None), ("none", float("nan")), ("one", None)]
    df = spark.createDataFrame(rows, "k string, v double").repartition(5)
    sizes, real = defaultdict(int), selection.stored

    def stored(df, name):
        made = real(df, name)
        sizes[name] = max(sizes[name], made.count())
        return made

    monkeypatch.setattr(selection, "stored", stored)
    levels = (0.0, 0.25, 0.5, 0.9, 1.0)
    got = {(r["k"], r["level"]): r["quantile"] for r in selection.exact_quantiles(df, "k", "v", levels, buckets, few).collect()}
    assert got.keys() == {(k, q) for k in groups for q in levels}
    for (k, q), v in got.items():
        want = float(np.quantile(groups[k], q))
        assert v == pytest.approx(want, rel=1e-12, abs=0)
    assert sizes["selection"] <= 7 * 10  # ranks, never values


def test_quantiles_of_nothing(spark):
    assert selection.exact_quantiles(spark.createDataFrame([], "k string, v double"), "k", "v").count() == 0


def test_stored_tables_are_deleted(spark):
    import os

    made = shared.stored(spark.range(5), "range")
    paths = [f.partition(":")[2] for f in made.inputFiles()]
    assert made.count() == 5 and all(map(os.path.exists, paths))
    shared.clear_stored(spark)
    assert not any(map(os.path.exists, paths))
