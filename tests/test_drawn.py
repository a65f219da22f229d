import math
from statistics import NormalDist

import numpy as np
import pytest
from pyspark.sql import functions as F

from cellwave.functions import draws
from cellwave.operators import forecast, generate, sequence


@pytest.fixture(scope="module")
def uniforms(spark):
    df = spark.range(20_000).withColumn("digits", draws.named(3, F.col("id"))).select("id", draws.uniform(F.col("digits")).alias("u"), draws.uniform(F.col("digits"), 1).alias("v"))
    return df.withColumn("w", draws.normal_quantile(F.col("u"))).persist()


def test_uniform_numbers(uniforms):
    u, v = np.array([(r["u"], r["v"]) for r in uniforms.collect()]).T
    for x in (u, v):
        assert 0 < x.min() and x.max() < 1 and abs(x.mean() - 0.5) < 0.01 and abs(x.var() - 1 / 12) < 0.003
    assert abs(np.corrcoef(u, v)[0, 1]) < 0.03 and len(set(u)) == len(u)


def test_normal_quantiles(uniforms):
    for r in uniforms.orderBy("u").limit(300).union(uniforms.orderBy(F.desc("u")).limit(300)).union(uniforms.limit(300)).collect():
        want = NormalDist().inv_cdf(r["u"])
        assert abs(r["w"] - want) < 2e-8 * max(1, abs(want))


@pytest.mark.parametrize("mean", [1e-6, 0.3, 4.0, 10.0, 10.5, 60.0, 900.0])
def test_poisson_counts_are_inverted(uniforms, mean):
    m = F.lit(mean)
    rows = uniforms.withColumn("table", draws.poisson_table(m)).select("u", draws.poisson(F.col("u"), F.col("w"), m, F.col("table")).alias("k")).collect()
    k = np.arange(int(mean + 12 * math.sqrt(mean) + 50))
    upto = np.cumsum(np.exp(-mean + k * math.log(mean) - np.array([math.lgamma(x + 1) for x in k])))
    want = np.searchsorted(upto, [r["u"] for r in rows], side="right")
    got = np.array([r["k"] for r in rows])
    assert np.abs(got - want).max() <= 1
    assert (got != want).mean() <= (0 if mean <= draws.POISSON_SUMMED else 0.01)


@pytest.mark.parametrize("k", [1, 5, 12, 13, 400])
def test_sums_of_exponentials(uniforms, k):
    total = draws.exponential_sum(F.lit(k), draws.normal_quantile(F.col("v")), [F.col("id")])
    x = np.array([r["x"] for r in uniforms.select(total.alias("x")).collect()])
    assert x.min() > 0 and abs(x.mean() / k - 1) < 4 / math.sqrt(k * len(x)) + 1e-3 and abs(x.std() / math.sqrt(k) - 1) < 0.05


def params(spark):
    rows = [(s, 10.0 * (i % 4), 0.2 + 0.1 * s, 0.9 - 0.2 * s, rate, 0.5, i) for s, rate in ((0, 0.4), (1, 8.0), (2, 50.0)) for i in range(40)]
    df = spark.createDataFrame(rows, "secteur int, slot_mu double, tau double, zeta double, lambda double, e_psi double, i int")
    return df.withColumn("dates_5min", F.lit("2025-01-01").cast("timestamp") + F.make_dt_interval(mins=F.col("i") * 5)).drop("i")


def test_seconds_follow_the_model(spark):
    p = params(spark)
    made = generate.generate_seconds(p, 60, seed=2)
    rows = sorted(map(tuple, made.collect()))
    assert rows == sorted(map(tuple, generate.generate_seconds(p.repartition(7), 60, seed=2).collect())) and len(rows) == 120 * 60
    assert rows != sorted(map(tuple, generate.generate_seconds(p, 60, seed=3).collect()))
    part = generate.generate_seconds(p.filter("secteur = 1 and slot_mu = 10"), 60, seed=2)
    assert set(map(tuple, part.collect())) <= set(rows)  # any part alone is the same
    plan = generate.generate_seconds(p, 60)._jdf.queryExecution().executedPlan().toString()  # not run, so only one plan
    assert "Python" not in plan and "Arrow" not in plan and plan.count("Exchange hashpartitioning") == 1
    by = made.join(p, ["secteur", "dates_5min"]).groupBy("secteur", F.expr("slot_mu > 0").alias("busy")).agg(F.avg("arrivals").alias("k"), F.avg("psi_instant").alias("x"), F.avg(F.expr("cast(arrivals > 0 as int)")).alias("on"), F.count("*").alias("n"))
    for r in by.collect():
        if not r["busy"]:
            assert r["k"] == r["x"] == 0
            continue
        tau, zeta, rate = 0.2 + 0.1 * r["secteur"], 0.9 - 0.2 * r["secteur"], (0.4, 8.0, 50.0)[r["secteur"]]
        active = zeta / (tau + zeta)
        assert abs(r["k"] / (active * rate) - 1) < 0.15 and abs(r["x"] / (active * rate * 0.5) - 1) < 0.15
        assert abs(r["on"] / (active * (1 - math.exp(-rate))) - 1) < 0.12


def test_states_are_the_chain(spark):
    """The states from turns and sets are those of walking second by second."""
    rows = generate.generate_seconds(params(spark).withColumn("lambda", F.lit(60.0)), 60, seed=9).collect()
    on = {(r["secteur"], r["dates_5min"], r["second"]): r["arrivals"] > 0 for r in rows}
    names = params(spark).select("*", F.explode(F.sequence(F.lit(0), F.lit(60))).alias("second"))
    moves = names.withColumn("u", draws.uniform(draws.named(9, F.col("secteur"), F.unix_micros("dates_5min"), F.col("second")))).orderBy("secteur", "dates_5min", "second").collect()
    for r in moves:
        state = r["u"] < 0.5 if r["second"] == 0 else (r["u"] >= r["tau"] if state else r["u"] < r["zeta"])  # noqa: F821
        if r["second"]:
            assert on[r["secteur"], r["dates_5min"], r["second"]] == (state and r["slot_mu"] > 0)


def context(spark, series):
    rows = [(s, i, i, float(v)) for s, values in series.items() for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "sector string, first_seq int, row_seq int, trafic_mbps double")


def test_paths_follow_the_counts(spark):
    # after 1, 3 comes 1; after 3, 1 comes 1 or 5 evenly: scaled by the mean of 2 tokens are far apart
    df = context(spark, {"a": [1, 3, 1, 1, 3, 1, 5] * 40, "b": [4.0], "c": [0.0, 0.0]})
    made = sequence.sequence_forecasts(df, samples=200, steps=3, seed=1, bins=301)
    rows = made.collect()
    assert len(rows) == 3 * 200 * 3 and {r["sector"] for r in rows} == {"a", "b", "c"}
    again = sequence.sequence_forecasts(df.repartition(5), samples=200, steps=3, seed=1, bins=301).collect()
    assert sorted(map(str, rows)) == sorted(map(str, again))
    a = [r["value"] for r in rows if r["sector"] == "a" and r["step"] == 1]  # the context ends in 1, 5: then 1 comes
    scale = float(np.mean([1, 3, 1, 1, 3, 1, 5]))
    near_one = sum(abs(x - 1) < 0.06 * scale for x in a)
    assert near_one > 0.9 * len(a)  # 0.6 + 0.3 and part of what remains
    assert all(r["value"] == 0 or r["sector"] != "c" or r["value"] >= 0 for r in rows)
    points = forecast.point_from_samples(made)
    assert points.count() == 3


def test_laws_are_counts(spark):
    df = context(spark, {"a": [1, 2, 1, 2, 2], "b": [2, 1]}).withColumn("bin", F.col("trafic_mbps").cast("int"))
    got = {(r["length"], r["context"]): (r["total"], [tuple(x) for x in r["upto"]]) for r in sequence.laws(sequence.count_grams(sequence.with_previous(df))).collect()}
    b = sequence.BASE
    assert got == {(0, 0): (7, [(3, 1), (7, 2)]), (1, 1): (2, [(2, 2)]), (1, 2): (3, [(2, 1), (3, 2)]), (2, b + 2): (2, [(1, 1), (2, 2)]), (2, 2 * b + 1): (1, [(1, 2)])}


def test_levels_of_samples(spark):
    rows = [("m", "s", k, None, 1, float(v)) for k, v in enumerate([5, 1, 3, 3])]
    df = spark.createDataFrame(rows, "model_id string, sector string, k int, level double, step int, value double")
    got = sorted((r["k"], r["level"], r["value"]) for r in sequence.levels_of_samples(df).collect())
    assert got == [(0, 0.125, 1.0), (1, 0.375, 3.0), (2, 0.625, 3.0), (3, 0.875, 5.0)]
    assert forecast.point_from_quantiles(sequence.levels_of_samples(df)).first()["prediction"] == 3.0


def test_sequences_of_nothing(spark):
    assert sequence.sequence_forecasts(context(spark, {"a": [1.0]}).limit(0)).count() == 0
    with pytest.raises(ValueError):
        sequence.sequence_forecasts(context(spark, {"a": [1.0]}), bins=1 << 13)


def test_seconds_are_dealt_and_not_sorted(spark):
    made = generate.generate_seconds(params(spark), 60)
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "Sort" not in plan
    dealt = generate.TASKS_A_CORE * spark.sparkContext.defaultParallelism
    assert f"hashpartitioning(sector#" in plan and f", {dealt})" in plan  # however few the slots, several tasks


def test_paths_are_drawn_once(spark):
    points = spark.range(60).select((F.col("id") % 3).cast("string").alias("sector"), F.col("id").alias("first_seq"), F.col("id").alias("row_seq"), (F.col("id") % 7 + 1).cast("double").alias("trafic_mbps"))
    made = sequence.sequence_forecasts(points, samples=4, steps=2)
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert "Filter (size(" not in plan  # a filter on the path's size draws it again
    assert "lag(" not in plan and plan.count("Exchange") - plan.count("BroadcastExchange") <= 1 + plan.count("SortMergeJoin") * 2  # points and laws are read, not made again
    assert made.count() == 3 * 4 * 2
