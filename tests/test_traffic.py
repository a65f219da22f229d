import numpy as np
from pyspark.sql import functions as F

from cellwave.operators import compare, forecast, generate, score, sectors, series, tokens, traffic
from cellwave.plans import jobs


def history(spark, sectors_=3, points=20):
    rows = [(f"S{s}", f"S{s}"[:1], f"2018-01-{1 + i:02d} 00:00:00", float(10 + s + (i * 7) % 5 * (i % 4 != 0)), s * 1000 + i) for s in range(sectors_) for i in range(points)]
    return spark.createDataFrame(rows, "secteur string, site string, tstamp string, trafic_mbps double, row_seq long").withColumn("tstamp", F.to_timestamp("tstamp"))


def brute_fit(mu, var, slot=300):
    if mu <= 0 or var <= 0:
        return 0.1, 0.5
    axis, best = np.linspace(0.05, 1.0, 40), (1e9, 0.1, 0.5)
    for tau in axis:
        for zeta in axis:
            error = abs(var / mu**2 - (2 * zeta) / (tau * slot * (tau + zeta)))
            if error < best[0]:
                best = (error, tau, zeta)
    return best[1:]


def test_fit_is_brute_force(spark):
    rng = np.random.default_rng(3)
    cases = [(0.0, 1.0), (1.0, 0.0), (5.0, 100.0)] + [(float(m), float(m * m * c)) for m, c in zip(rng.uniform(1, 50, 40), rng.uniform(0.0003, 0.13, 40))]
    cases += [(1.0, (2 * z) / (t * 300 * (t + z))) for t, z in ((0.634615384615384, 0.09871794871794873), (1.0, 0.2692307692307692), (0.05, 1.0))]
    df = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], "i int, mu double, var double")
    got = {r["i"]: (r["tau"], r["zeta"]) for r in traffic.fit_tau_zeta(df).collect()}
    plain = {r["i"]: (r["tau"], r["zeta"]) for r in traffic.fit_tau_zeta_sql(df, ["i"]).collect()}
    for i, case in enumerate(cases):
        assert np.allclose(got[i], brute_fit(*case), atol=1e-12), case
        assert case[0] <= 0 or case[1] <= 0 or got[i] == plain[i]
    lone = traffic.fit_tau_zeta(spark.createDataFrame([(1.0, None)], "mu double, var double")).first()
    assert (lone["tau"], lone["zeta"], lone["ratio"]) == (0.1, 0.5, None)


def test_generation(spark):
    slots = series.assign_slots(history(spark))
    stats = traffic.fit_tau_zeta(sectors.sector_cv2(sectors.sector_stats(slots)))
    params = traffic.arrival_params(traffic.slot_variance(slots, stats)).withColumn("slot_mu", F.when(F.col("row_seq") % 5 == 0, 0.0).otherwise(F.col("slot_mu")))
    one = {(r["secteur"], r["dates_5min"]): r for r in generate.generate_ipp(params.coalesce(1), seed=4).collect()}
    many = {(r["secteur"], r["dates_5min"]): r for r in generate.generate_ipp(params.repartition(7), seed=4).collect()}
    assert len(one) == 60 and all(one[k]["psi"] == many[k]["psi"] and len(one[k]["psi"]) == 300 for k in one)
    none = {(r["secteur"], r["dates_5min"]) for r in params.filter("slot_mu = 0").collect()}
    assert all((sum(one[k]["psi"]) == 0) == (k in none) for k in one)
    seconds = generate.expand_seconds(generate.generate_ipp(params, seed=4))
    assert seconds.count() == 60 * 300
    sums = compare.resample_sum(seconds)
    assert sums.count() == 60
    total = seconds.agg(F.sum("psi_instant")).first()[0]
    assert abs(sums.agg(F.sum("psi_instant")).first()[0] - total) < 1e-6 * total
    y = compare.normalize_aligned(compare.align_slots(slots, sums)).agg(F.max("y_real"), F.max("y_gen"), F.count("*")).first()
    assert tuple(y) == (1.0, 1.0, 60)
    assert compare.clip_to_range(seconds, slots).count() == 3 * (19 * 300 + 1)


def test_mean_of_generated_traffic():
    # on half the time or more: the mean of a slot is mu * zeta / tau
    n, mu, tau, zeta = 3000, 10.0, 0.3, 0.5
    least = 2 * zeta / (tau * 300 * (tau + zeta))
    rate = (tau + zeta) / (tau * 300 * (0.05 - least))
    psi = (tau + zeta) * mu / (tau * rate * 300)
    full = lambda x: np.full(n, x)
    values, arrivals = generate.slot_draws(full(mu), full(tau), full(zeta), full(rate), full(psi), [(1, i) for i in range(n)], 300, 9)
    assert abs(values.sum(1).mean() / (mu * zeta / tau) - 1) < 0.03
    assert ((values > 0) == (arrivals > 0)).all()


def test_order_by_first_appearance(spark):
    rows = [("A", "d1", 1.0, 0), ("A", "d3", 2.0, 1), ("B", "d1", 3.0, 2), ("B", "d2", 4.0, 3), ("B", "d3", 5.0, 4), ("C", "d1", 6.0, 5), (None, "d1", 6.0, 6)]
    df = spark.createDataFrame(rows, "sector string, timestamp_iso string, trafic_mbps double, row_seq int").withColumn("site", F.col("sector"))
    got = {r["sector"]: r for r in series.build_examples(df).collect()}
    assert set(got) == {"A", "B"} and got["B"]["timestamps"] == ["d1", "d3", "d2"] and got["B"]["target"] == 4.0
    short = {r["sector"]: r for r in series.build_examples(df, max_context=1, order="time").collect()}
    assert short["B"]["context"] == [4.0] and short["B"]["target"] == 5.0
    assert series.min_length(df, 2).count() == 5


def test_tokens(spark):
    df = spark.createDataFrame([("s", float(x), i) for i, x in enumerate([-100, -3, 0, 1, 2.5, 400])], "sector string, trafic_mbps double, row_seq int").withColumn("first_seq", F.col("row_seq"))
    scaled = tokens.mean_scale(df)
    back = tokens.dequantize(tokens.quantize(scaled, bins=101), bins=101).collect()
    for r in back:
        assert 1 <= r["bin"] <= 101
        if abs(r["scaled"]) < 15:
            assert abs(r["restored"] - r["trafic_mbps"]) <= 0.3 / 2 * r["scale"] + 1e-9
    assert tokens.last_context(df, 3).select("pos", "trafic_mbps").orderBy("pos").collect() == [(1, 0.0), (2, 1.0), (3, 2.5)]
    padded = spark.createDataFrame([([1.0, 2.0],)], "c array<double>").select(tokens.padded_context(F.col("c"), 3).alias("a"), tokens.padded_context(F.col("c"), 1).alias("b")).first()
    assert padded["a"] == [None, 1.0, 2.0] and padded["b"] == [2.0]


def test_points(spark):
    rows = [("m", "s", k, level, step, v) for k, level, step, v in ((0, 0.4, 0, 9.0), (0, 0.4, 1, 1.0), (1, 0.6, 1, 2.0), (2, 0.9, 1, 6.0))]
    df = spark.createDataFrame(rows, "model_id string, sector string, k int, level double, step int, value double")
    assert forecast.point_from_samples(df).first()["prediction"] == 3.0
    assert forecast.point_from_quantiles(df).first()["prediction"] in (1.0, 2.0)
    assert forecast.point_from_quantiles(df.withColumn("level", F.lit(None).cast("double"))).first()["prediction"] == 2.0


def test_scores(spark):
    summary = spark.createDataFrame([("d", "a", 2.0, "9M"), ("d", "b", 3.0, "21M"), ("d", "c", 1.0, None)], "dataset string, model_id string, rmse double, parameters string")
    assert score.best_model(summary).first()["model_id"] == "c"
    rises = {r["model_id"]: r["rises"] for r in score.size_vs_error(summary).collect()}
    assert rises == {"c": None, "a": True, "b": True}
    assert [r["model_id"] for r in score.order_by_list(summary, ["b", "a"]).collect()] == ["b", "a", "c"]


def test_jobs_in_one(spark):
    instant = jobs.instant_from_slots(series.assign_slots(history(spark, 2, 5)), seed=1)
    assert jobs.compare_with_history(series.assign_slots(history(spark, 2, 5)), instant).count() == 10
