"""Queries of what is drawn at random, which DuckDB draws again from the same names."""

from __future__ import annotations

from pyspark.sql import functions as F

from cellwave.functions import draws
from cellwave.operators import forecast, generate, score, sequence, tokens
from cellwave.plans import views
from cellwave.plans.registry import CANON, CONTEXT, FIT, ISO, LOW_STATS, PARAMS, SCALED, SQL_ISO, TARGETS, context, digits, ordered, query, r6, slot_params


def bits(name: str, half: int = 0) -> str:
    return f"(('0x' || substr({name}, {1 + 13 * half}, 13))::BIGINT + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE"


def polynomial(factors: tuple[float, ...], x: str) -> str:
    total = f"({factors[0]!r}::DOUBLE)"
    for f in factors[1:]:
        total = f"({total} * {x} + {f!r}::DOUBLE)"
    return total


def normal(u: str) -> str:
    q, t = f"(({u}) - 0.5)", f"sqrt(-2 * ln(least({u}, 1 - ({u}))))"
    tail = f"{polynomial(draws.TAIL_OVER, t)} / {polynomial(draws.TAIL_UNDER, t)}"
    middle = f"{polynomial(draws.MIDDLE_OVER, f'({q} * {q})')} * {q} / {polynomial(draws.MIDDLE_UNDER, f'({q} * {q})')}"
    return f"CASE WHEN {u} < {draws.TAIL} THEN {tail} WHEN {u} > {1 - draws.TAIL} THEN -({tail}) ELSE {middle} END"


IPP = (
    "slots AS (SELECT secteur, tstamp, CASE WHEN day(tstamp) % 5 = 0 THEN 0.0 ELSE m::DOUBLE END AS slot_mu, tau, zeta, lam, e_psi FROM full_params)",
    "seconds AS (SELECT *, '7|' || secteur || '|' || epoch_us(tstamp)::VARCHAR || '|' || second::VARCHAR AS name FROM slots, range(301) r(second))",
    f"moves AS (SELECT *, md5(name) AS digits, {bits('md5(name)')} AS u FROM seconds)",
    "kinds AS (SELECT *, CASE WHEN second > 0 AND u < tau AND u < zeta THEN 1 ELSE 0 END AS turn, CASE WHEN second = 0 THEN (u < 0.5)::INT WHEN (u < tau) <> (u < zeta) THEN (u < zeta)::INT END AS sets FROM moves)",
    # the last second that set the state, and the turns after it
    "states AS (SELECT *, last_value(CASE WHEN sets IS NOT NULL THEN second END IGNORE NULLS) OVER w AS since, last_value(sets IGNORE NULLS) OVER w AS base FROM kinds WINDOW w AS (PARTITION BY secteur, tstamp ORDER BY second))",
    "turned AS (SELECT *, sum(turn) OVER (PARTITION BY secteur, tstamp, since ORDER BY second) AS turns FROM states)",
    f"active AS (SELECT *, {bits('digits', 1)} AS v FROM turned WHERE second > 0 AND (base + turns) % 2 = 1 AND slot_mu > 0)",
    f"""laws AS (SELECT lam, j, sum(p) OVER (PARTITION BY lam ORDER BY j) AS upto
      FROM (SELECT lam, j, exp(-lam + j * ln(lam) - lgamma(j + 1)) AS p FROM (SELECT DISTINCT lam FROM slots WHERE lam <= {draws.POISSON_SUMMED}), range({draws.POISSON_TERMS + 1}) r(j)))""",
    "small AS (SELECT a.secteur, a.tstamp, a.second, count(*) FILTER (l.upto <= a.v) AS k FROM active a JOIN laws l ON l.lam = a.lam GROUP BY ALL)",
    f"""large AS (SELECT secteur, tstamp, second, greatest(0, floor(lam + sqrt(lam) * w + (w * w / 6 + 1.0::DOUBLE / 3) - (w * w * w / 72 + w / 36) / sqrt(lam)))::BIGINT AS k
      FROM (SELECT *, {normal('v')} AS w FROM active WHERE lam > {draws.POISSON_SUMMED}))""",
    "counts AS (SELECT * FROM small UNION ALL SELECT * FROM large)",
    f"""summed AS (SELECT a.*, k, {bits("md5(name || '|0')")} AS one FROM active a JOIN counts c ON a.secteur = c.secteur AND a.tstamp = c.tstamp AND a.second = c.second WHERE k > 0)""",
    f"""demands AS (SELECT *, CASE WHEN k <= {draws.GAMMA_SUMMED} THEN -list_sum(list_transform(range(1, k + 1), lambda i: ln({bits("md5(name || '|' || i::VARCHAR)")})))
      ELSE k * power(1 - 1.0::DOUBLE / (9 * k) + ({normal('one')}) / (3 * sqrt(k)), 3) END * e_psi AS psi FROM summed)""",
)


@query(
    views.LOW_VARIANCE, LOW_STATS, FIT, PARAMS, *IPP,
    f"""SELECT s.secteur, strftime(s.tstamp + to_seconds(s.second - 1), {SQL_ISO}) AS timestamp, coalesce(k, 0) AS arrivals, printf('%.5e', coalesce(psi, 0)) AS psi_instant
        FROM seconds s LEFT JOIN demands q ON q.secteur = s.secteur AND q.tstamp = s.tstamp AND q.second = s.second WHERE s.second > 0""",
)
def generate_seconds(spark, d):
    idle = F.dayofmonth("tstamp") % 5 == 0
    slots = slot_params(spark, d).withColumn("slot_mu", F.when(idle, 0.0).otherwise(F.col("slot_mu").cast("double")))
    g = generate.generate_seconds(slots, seed=7, start="tstamp")
    return g.select("secteur", F.date_format("timestamp", ISO).alias("timestamp"), "arrivals", F.when(F.col("psi_instant") == 0, "0.00000e+00").otherwise(digits("psi_instant", "psi_instant")).alias("psi_instant"))


# ---- sampled forecasts

#: Bins of the model's tokens, paths and steps; the last step is what is scored.
BINS, SAMPLES, STEPS, SEED = 256, 32, 2, 5
SEQUENCE = (
    f"coarse_bins AS (SELECT *, least({BINS}, greatest(1, floor((scaled + 15.0::DOUBLE) / (30.0::DOUBLE / {BINS - 1}) + 0.5::DOUBLE) + 1))::BIGINT AS bin FROM scaled)",
    "grams AS (SELECT *, lag(bin) OVER w AS one, lag(bin, 2) OVER w AS two FROM coarse_bins WINDOW w AS (PARTITION BY sector ORDER BY first_seq, row_seq))",
    """laws AS (SELECT length, context, bin, sum(n) OVER (PARTITION BY length, context ORDER BY bin) AS upto, sum(n) OVER (PARTITION BY length, context) AS total FROM (
      SELECT length, context, bin, count(*) AS n FROM (SELECT 0 AS length, 0 AS context, bin FROM grams UNION ALL SELECT 1, one, bin FROM grams WHERE one IS NOT NULL
        UNION ALL SELECT 2, two * 8192 + one, bin FROM grams WHERE two IS NOT NULL) GROUP BY ALL))""",
    "contexts AS (SELECT DISTINCT length, context, total FROM laws)",
    f"path0 AS (SELECT sector, k, scale, bin AS one, one AS two FROM grams, range({SAMPLES}) r(k) WHERE back = 2)",
    *[
        f"""drawn{s} AS (SELECT p.*, {bits('name')} AS which, {bits('name', 1)} AS place FROM (SELECT *, md5('{SEED}|' || sector || '|' || k::VARCHAR || '|{s}') AS name FROM path{s - 1}) p),
    chosen{s} AS (SELECT d.*, CASE WHEN which < 0.6 AND b.total IS NOT NULL THEN 2 WHEN which < 0.6::DOUBLE + 0.3::DOUBLE AND a.total IS NOT NULL THEN 1 ELSE 0 END AS length
      FROM drawn{s} d LEFT JOIN contexts a ON a.length = 1 AND a.context = d.one LEFT JOIN contexts b ON b.length = 2 AND b.context = d.two * 8192 + d.one),
    path{s} AS (SELECT c.sector, c.k, c.scale, min(l.bin) AS one, c.one AS two FROM chosen{s} c
      JOIN laws l ON l.length = c.length AND l.context = CASE c.length WHEN 2 THEN c.two * 8192 + c.one WHEN 1 THEN c.one ELSE 0 END AND l.upto > floor(c.place * l.total) GROUP BY c.sector, c.k, c.scale, c.one)"""
        for s in range(1, STEPS + 1)
    ],
    "sampled AS ("
    + " UNION ALL ".join(f"SELECT sector, k, {s} AS step, (-15.0::DOUBLE + (one - 1) * (30.0::DOUBLE / {BINS - 1})) * scale AS value FROM path{s}" for s in range(1, STEPS + 1))
    + ")",
)
MODEL = (views.HISTORY, CANON, CONTEXT, SCALED, *SEQUENCE)


def sampled(spark, d):
    return sequence.sequence_forecasts(context(spark, d), SAMPLES, STEPS, SEED, bins=BINS)


@query(*MODEL, "SELECT 'sequence' AS model_id, sector, k::INTEGER AS k, step, round(value, 6) AS value FROM sampled")
def forecast_sequence(spark, d):
    return sampled(spark, d).select("model_id", "sector", "k", "step", r6("value", "value"))


@query(*MODEL, "SELECT length, context, bin, upto::BIGINT AS upto, total::BIGINT AS total FROM laws")
def sequence_laws(spark, d):
    binned = tokens.quantize(tokens.mean_scale(context(spark, d)), BINS)
    made = sequence.laws(sequence.count_grams(sequence.with_previous(binned)))
    return made.select("length", "context", "total", F.explode("upto").alias("x")).select("length", "context", F.col("x.bin").cast("long").alias("bin"), F.col("x.upto").alias("upto"), "total")


@query(
    *MODEL,
    TARGETS,
    f"SELECT sector, site, target, round(p, 6) AS prediction, round((p - target) * (p - target), 6) AS squared_error FROM targets JOIN (SELECT sector, avg(value) AS p FROM sampled WHERE step = {STEPS} GROUP BY sector) USING (sector)",
)
def score_sequence(spark, d):
    made = forecast.point_from_samples(sampled(spark, d))
    return score.score_series(made.drop("model_id"), score_targets(spark, d)).select("sector", "site", "target", r6("prediction", "prediction"), r6("squared_error", "squared_error"))


@query(
    *MODEL,
    f"""SELECT 'sequence' AS model_id, sector, round(value, 6) AS prediction FROM (SELECT *, row_number() OVER (PARTITION BY sector ORDER BY abs((r - 0.5::DOUBLE) / n - 0.5::DOUBLE), r) AS place FROM (
      SELECT *, row_number() OVER (PARTITION BY sector ORDER BY value, k) AS r, count(*) OVER (PARTITION BY sector) AS n FROM sampled WHERE step = {STEPS})) WHERE place = 1""",
)
def sequence_medians(spark, d):
    made = forecast.point_from_quantiles(sequence.levels_of_samples(sampled(spark, d)))
    return made.select("model_id", "sector", r6("prediction", "prediction"))


def score_targets(spark, d):
    """Site and last value of each series."""
    last = ordered(spark, d).groupBy("sector").agg(F.max_by(F.struct("site", "trafic_mbps"), F.struct("first_seq", "row_seq")).alias("t"))
    return last.select("sector", "t.site", F.col("t.trafic_mbps").alias("target"))
