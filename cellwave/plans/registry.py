"""The registered queries of the traffic operators, each with the SQL of its result."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellwave.functions import dates, numbers
from cellwave.operators import clean, compare, forecast, generate, score, sectors, series, tokens, traffic
from cellwave.plans import views
from cellwave.sources import examples, reports, shared, traffic as files

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

ISO = "yyyy-MM-dd HH:mm:ss"
SQL_ISO = "'%Y-%m-%d %H:%M:%S'"


def query(*parts: str):
    """Registers a query under its function's name; ``parts`` are the WITH clauses and the SELECT of its SQL."""

    def register(f):
        QUERIES[f.__name__] = f
        if parts:
            SQL[f.__name__] = ("WITH " + ",\n".join(parts[:-1]) + "\n" if len(parts) > 1 else "") + parts[-1]
        return f

    return register


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    from cellwave.plans import drawn, long_series, stored_series  # noqa: F401  their queries register with this module

    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    queries()
    return dict(SQL)


def r6(c, name: str):
    return F.round(c, 6).alias(name)


def digits(c, name: str):
    """Six significant digits, as text: numbers of any size alike."""
    return F.format_string("%.5e", F.col(c)).alias(name)


# ---- cleaning


@query(views.HISTORY, views.RAW, "SELECT secteur AS sector, site, tstamp AS \"timestamp\", trafic_mbps AS value, row_seq FROM raw")
def standardize(spark, d):
    return clean.standardize_columns(views.raw(spark, d).drop("week")).select("sector", "site", "timestamp", "value", "row_seq")


@query(views.HISTORY, "SELECT row_seq, CASE WHEN week % 5 <> 0 THEN secteur END AS secteur, CASE WHEN week % 3 <> 0 THEN trafic_mbps END AS trafic_mbps FROM history WHERE NOT (week % 5 = 0 AND week % 3 = 0)")
def drop_blank(spark, d):
    h = views.history(spark, d).select("row_seq", F.when(F.col("week") % 5 != 0, F.col("secteur")).alias("secteur"), F.when(F.col("week") % 3 != 0, F.col("trafic_mbps")).alias("trafic_mbps"))
    return clean.drop_blank_rows(h, ["secteur", "trafic_mbps"])


#: Blanks, the no-break ones included.
BLANKS_SQL = r"[\s\x{00A0}\x{202F}]+"

FRENCH_SQL = f"""french AS (
  SELECT row_seq, tstamp, len(w) AS n, w, try_cast(w[-3] AS INTEGER) AS d, try_cast(w[-1] AS INTEGER) AS y,
         nullif(list_position({views.MONTHS_SQL.translate(str.maketrans("éû", "eu"))}, translate(lower(w[-2]), 'éèêëàâäîïôöûüùç', 'eeeeaaaiioouuuc')), 0) AS m
  FROM (SELECT row_seq, tstamp, string_split(trim(regexp_replace(tstamp, '{BLANKS_SQL}', ' ', 'g')), ' ') AS w FROM raw))"""
ISO_DATE = "CASE WHEN n >= 4 AND d IS NOT NULL AND m IS NOT NULL AND y IS NOT NULL THEN printf('%04d-%02d-%02d', y, m::INTEGER, d) ELSE {} END"


@query(views.HISTORY, views.RAW, FRENCH_SQL, f"SELECT row_seq, {ISO_DATE.format('tstamp')} AS iso FROM french")
def french_date_iso(spark, d):
    return views.raw(spark, d).select("row_seq", dates.french_date_to_iso(F.col("tstamp")).alias("iso"))


ACCENTED_SQL = f"""accented AS (
  SELECT row_seq, tstamp, w, nullif(list_position({views.MONTHS_SQL}, lower(w[3])), 0) AS m
  FROM (SELECT row_seq, tstamp, string_split(trim(regexp_replace(tstamp, '{BLANKS_SQL}', ' ', 'g')), ' ') AS w FROM raw))"""


@query(
    views.HISTORY,
    views.RAW,
    ACCENTED_SQL,
    f"""SELECT row_seq, strftime(CASE WHEN len(w) = 4 AND m IS NOT NULL THEN try_strptime(lpad(w[2], 2, '0') || '/' || lpad(m::VARCHAR, 2, '0') || '/' || w[4], '%d/%m/%Y')
           ELSE coalesce(try_strptime(tstamp, '%d/%m/%Y %H:%M'), try_strptime(tstamp, '%Y-%m-%d %H:%M:%S')) END, {SQL_ISO}) AS parsed FROM accented""",
)
def french_date_parse(spark, d):
    return views.raw(spark, d).select("row_seq", F.date_format(dates.parse_french_date(F.col("tstamp")), ISO).alias("parsed"))


@query(
    views.HISTORY,
    views.RAW,
    FRENCH_SQL,
    f"""SELECT row_seq, CASE WHEN regexp_matches(tstamp, '\\p{{L}}') THEN {ISO_DATE.format('trim(tstamp)')}
           ELSE coalesce(strftime(coalesce(try_strptime(tstamp, '%Y-%m-%d %H:%M:%S'), try_strptime(tstamp, '%m/%d/%Y %H:%M'), try_strptime(tstamp, '%d/%m/%Y %H:%M')), '%Y-%m-%dT%H:%M:%S'), tstamp) END AS timestamp_iso
        FROM french""",
)
def timestamp_iso(spark, d):
    return views.raw(spark, d).select("row_seq", dates.normalize_timestamp(F.col("tstamp")).alias("timestamp_iso"))


NUMBER_SQL = r"'^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$'"


@query(
    views.HISTORY,
    views.RAW,
    f"""SELECT row_seq, CASE WHEN regexp_matches(v, {NUMBER_SQL}) THEN try_cast(v AS DOUBLE) END AS number
        FROM (SELECT row_seq, regexp_replace(replace(trafic_mbps, ',', '.'), '[^0-9.\\-eE]', '', 'g') AS v FROM raw)""",
)
def clean_decimal(spark, d):
    return views.raw(spark, d).select("row_seq", numbers.clean_decimal(F.col("trafic_mbps")).alias("number"))


@query(views.HISTORY, views.RAW, f"SELECT row_seq, secteur AS sector, trim(tstamp) AS \"timestamp\", try_cast(trim(trafic_mbps) AS DOUBLE) AS value FROM raw WHERE regexp_matches(trafic_mbps, {NUMBER_SQL})")
def coerce_required(spark, d):
    return clean.coerce_required(clean.standardize_columns(views.raw(spark, d))).select("row_seq", "sector", "timestamp", "value")


# ---- order, slots, examples

SLOTS = """slots AS (
  SELECT secteur, site, tstamp, trafic_mbps, row_seq,
         TIMESTAMP '2025-01-01' + to_minutes(5 * (row_number() OVER (PARTITION BY secteur ORDER BY tstamp, row_seq) - 1)) AS dates_5min FROM history)"""


def slots(spark, d):
    return series.assign_slots(views.history(spark, d))


@query(views.HISTORY, SLOTS, f"SELECT secteur, row_seq, strftime(dates_5min, {SQL_ISO}) AS slot FROM slots")
def assign_slots(spark, d):
    return slots(spark, d).select("secteur", "row_seq", F.date_format("dates_5min", ISO).alias("slot"))


@query(views.HISTORY, SLOTS, "SELECT secteur, site, strftime(tstamp, '%d/%m/%Y') AS tstamp, trafic_mbps, strftime(dates_5min, '%d/%m/%Y %H:%M') AS dates_5min FROM slots")
def slots_export(spark, d):
    return files.format_slots(slots(spark, d))


@query(views.HISTORY, SLOTS, f"SELECT secteur, row_seq, strftime(dates_5min, {SQL_ISO}) AS slot FROM slots")
def slot_timestamp(spark, d):
    out = slots(spark, d)
    return out.select("secteur", "row_seq", F.date_format(dates.parse_slot_timestamp(F.date_format("dates_5min", "dd/MM/yyyy HH:mm")), ISO).alias("slot"))


@query(views.HISTORY, f"SELECT secteur, strftime(tstamp, {SQL_ISO}) AS tstamp, row_seq, trafic_mbps, strftime(lag(tstamp) OVER (PARTITION BY secteur ORDER BY tstamp, row_seq), {SQL_ISO}) AS previous FROM history")
def sort_series(spark, d):
    """The order is seen by what stands before each row: a window over partitions that are sorted already."""
    from pyspark.sql import Window as W

    done = series.sort_series(views.history(spark, d))
    before = F.lag("tstamp").over(W.partitionBy("secteur").orderBy("tstamp", "row_seq"))
    return done.select("secteur", F.date_format("tstamp", ISO).alias("tstamp"), "row_seq", "trafic_mbps", F.date_format(before, ISO).alias("previous"))


CANON = """canon AS (
  SELECT secteur AS sector, site, strftime(tstamp, '%Y-%m-%d') AS timestamp_iso, trafic_mbps, row_seq,
         min(row_seq) OVER (PARTITION BY tstamp) AS first_seq FROM history)"""


def canon(spark, d):
    h = views.history(spark, d)
    return h.select(F.col("secteur").alias("sector"), "site", F.date_format("tstamp", "yyyy-MM-dd").alias("timestamp_iso"), "trafic_mbps", "row_seq")


def ordered(spark, d):
    return series.first_appearance_order(canon(spark, d))


@query(views.HISTORY, CANON, "SELECT sector, timestamp_iso, row_seq, first_seq FROM canon")
def first_appearance_order(spark, d):
    return ordered(spark, d).select("sector", "timestamp_iso", "row_seq", "first_seq")


@query(
    views.HISTORY,
    CANON,
    """SELECT sector, list(site ORDER BY first_seq, row_seq)[1] AS site, string_agg(timestamp_iso, ',' ORDER BY first_seq, row_seq) AS stamps,
       array_to_string(list_transform(list(trafic_mbps ORDER BY first_seq, row_seq)[:-2], lambda x: x::BIGINT::VARCHAR), ',') AS context,
       arg_max(trafic_mbps, first_seq) AS target, count(*)::INTEGER - 1 AS context_length FROM canon GROUP BY sector HAVING count(*) >= 2""",
)
def build_examples(spark, d):
    return example_rows(series.build_examples(canon(spark, d)))


def example_rows(e):
    return e.select("sector", "site", F.array_join("timestamps", ",").alias("stamps"), F.array_join(F.transform("context", lambda x: x.cast("long").cast("string")), ",").alias("context"), "target", "context_length")


@query(views.HISTORY, CANON, "SELECT sector, arg_max(trafic_mbps, first_seq) AS target FROM canon GROUP BY sector")
def last_value_target(spark, d):
    return series.last_values(ordered(spark, d))


@query("counts AS (SELECT user_id AS sector, count(*) AS n FROM events GROUP BY user_id)", "SELECT event_id, user_id AS sector FROM events JOIN counts ON sector = user_id WHERE n >= 66")
def min_length(spark, d):
    t = views.table(spark, d, "events").select("event_id", F.col("user_id").alias("sector"))
    return series.min_length(t, 66)


@query(
    views.HISTORY,
    CANON,
    """SELECT count(*) FILTER (n >= 2) AS examples, count(*) AS sectors, sum(n)::BIGINT AS points, min(n - 1) FILTER (n >= 2) AS min_context, max(n - 1) FILTER (n >= 2) AS max_context,
       round(avg(n - 1) FILTER (n >= 2), 6) AS mean_context, min(a) AS first_stamp, max(b) AS last_stamp
       FROM (SELECT count(*) AS n, min(timestamp_iso) AS a, max(timestamp_iso) AS b FROM canon GROUP BY sector)""",
)
def context_profile(spark, d):
    p = series.profile_contexts(canon(spark, d))
    return p.withColumn("mean_context", F.round("mean_context", 6))


# ---- statistics

STATS = "stats AS (SELECT secteur, avg(trafic_mbps) AS mu, var_samp(trafic_mbps) AS var, count(trafic_mbps) AS n FROM history GROUP BY secteur)"
LOW_STATS = "stats AS (SELECT secteur, avg(trafic_mbps) AS mu, var_samp(trafic_mbps) AS var FROM low_variance GROUP BY secteur)"
CV2 = "cv AS (SELECT *, CASE WHEN mu > 0 THEN var / (mu * mu) ELSE 0.1 END AS cv2 FROM stats)"


def stats(spark, d):
    return sectors.sector_stats(views.history(spark, d))


def low_stats(spark, d):
    return sectors.sector_stats(views.low_variance(spark, d))


@query(views.HISTORY, STATS, "SELECT secteur, round(mu, 6) AS mu, round(var, 6) AS var, n FROM stats")
def sector_stats(spark, d):
    return stats(spark, d).select("secteur", r6("mu", "mu"), r6("var", "var"), "n")


@query(views.HISTORY, STATS, CV2, "SELECT secteur, round(cv2, 6) AS cv2 FROM cv")
def sector_cv2(spark, d):
    return sectors.sector_cv2(stats(spark, d)).select("secteur", r6("cv2", "cv2"))


@query(views.HISTORY, "SELECT secteur, round(var_samp(trafic_mbps), 6) AS var FROM history GROUP BY secteur ORDER BY var_samp(trafic_mbps) DESC, secteur")
def variance_ranking(spark, d):
    return sectors.rank_by_variance(views.history(spark, d)).select("secteur", r6("var", "var"))


@query(views.HISTORY, "SELECT secteur, round(var_samp(trafic_mbps), 6) AS var FROM history GROUP BY secteur ORDER BY var_samp(trafic_mbps) DESC, secteur LIMIT 5")
def top_variable(spark, d):
    return sectors.top_variable_sectors(views.history(spark, d)).select("secteur", r6("var", "var"))


@query(views.HISTORY, "SELECT secteur, row_seq, trafic_mbps FROM history WHERE secteur IN (SELECT secteur FROM history GROUP BY secteur ORDER BY var_samp(trafic_mbps) DESC, secteur LIMIT 5)")
def subset_top5(spark, d):
    h = views.history(spark, d)
    return sectors.subset_sectors(h, sectors.top_variable_sectors(h)).select("secteur", "row_seq", "trafic_mbps")


@query(views.HISTORY, "SELECT secteur, min(row_seq) AS first_seq FROM history GROUP BY secteur ORDER BY first_seq LIMIT 10")
def first_sectors(spark, d):
    return sectors.first_sectors(views.history(spark, d))


@query(views.INSTANT, f"SELECT secteur, strftime(min(timestamp), {SQL_ISO}) AS t_min, strftime(max(timestamp), {SQL_ISO}) AS t_max, max(psi_instant) AS v_max FROM instant GROUP BY secteur")
def sector_max(spark, d):
    m = sectors.sector_max(views.instant(spark, d), "secteur", "timestamp", "psi_instant")
    return m.select("secteur", F.date_format("t_min", ISO).alias("t_min"), F.date_format("t_max", ISO).alias("t_max"), "v_max")


# ---- arrival model

FIT = """ax AS (SELECT i, CASE WHEN i = 39 THEN 1.0::DOUBLE ELSE i * (0.95::DOUBLE / 39) + 0.05::DOUBLE END AS v FROM range(40) t(i)),
cells AS (SELECT a.i * 40 + b.i AS idx, a.v AS tau, b.v AS zeta, (2 * b.v) / (a.v * 300 * (a.v + b.v)) AS least FROM ax a, ax b),
tried AS (SELECT secteur, tau, zeta, row_number() OVER (PARTITION BY secteur ORDER BY abs(var / (mu * mu) - least), idx) AS k FROM stats, cells WHERE mu > 0 AND var > 0),
fitted AS (SELECT s.*, coalesce(t.tau, 0.1::DOUBLE) AS tau, coalesce(t.zeta, 0.5::DOUBLE) AS zeta,
  CASE WHEN mu > 0 AND var > 0 THEN var / (mu * mu) WHEN var IS NULL THEN NULL ELSE 0.1::DOUBLE END AS ratio FROM stats s LEFT JOIN tried t ON s.secteur = t.secteur AND k = 1)"""
FIT_OUT = "SELECT secteur, round(tau, 6) AS tau, round(zeta, 6) AS zeta, round(ratio, 6) AS ratio FROM fitted"


@query(views.LOW_VARIANCE, LOW_STATS, FIT, FIT_OUT)
def fit_tau_zeta(spark, d):
    return traffic.fit_tau_zeta(low_stats(spark, d)).select("secteur", r6("tau", "tau"), r6("zeta", "zeta"), r6("ratio", "ratio"))


@query(views.HISTORY, STATS, FIT, FIT_OUT)
def fit_tau_zeta_suppliers(spark, d):
    return traffic.fit_tau_zeta(stats(spark, d)).select("secteur", r6("tau", "tau"), r6("zeta", "zeta"), r6("ratio", "ratio"))


@query(views.LOW_VARIANCE, LOW_STATS, FIT, "SELECT secteur, round(tau, 6) AS tau, round(zeta, 6) AS zeta FROM fitted WHERE mu > 0 AND var > 0")
def fit_tau_zeta_plain(spark, d):
    return traffic.fit_tau_zeta_sql(low_stats(spark, d), ["secteur"]).select("secteur", r6("tau", "tau"), r6("zeta", "zeta"))


PARAMS = """slotted AS (SELECT f.secteur, h.tstamp, h.trafic_mbps AS m, (CASE WHEN mu > 0 THEN var / (mu * mu) ELSE 0.1 END) * h.trafic_mbps * h.trafic_mbps AS v, tau, zeta FROM low_variance h JOIN fitted f USING (secteur)),
ratios AS (SELECT *, (2 * zeta) / (tau * 300 * (tau + zeta)) AS least, v / (m * m) AS q FROM slotted),
spans AS (SELECT *, tau * 300 * ((CASE WHEN q <= least THEN least + 1e-6 ELSE q END) - least) AS span FROM ratios),
params AS (SELECT *, CASE WHEN m <= 0 THEN 1e-6::DOUBLE ELSE (tau + zeta) / CASE WHEN span > 0 THEN span ELSE 1e-6::DOUBLE END END AS lam FROM spans),
full_params AS (SELECT *, CASE WHEN m <= 0 THEN 1e-6::DOUBLE ELSE (tau + zeta) * m / (tau * lam * 300) END AS e_psi FROM params)"""


def slot_params(spark, d):
    fitted = traffic.fit_tau_zeta(sectors.sector_cv2(low_stats(spark, d)))
    slots_ = traffic.slot_variance(views.low_variance(spark, d), fitted)
    return traffic.arrival_params(slots_)


@query(views.LOW_VARIANCE, LOW_STATS, FIT, PARAMS, f"SELECT secteur, strftime(tstamp, {SQL_ISO}) AS tstamp, m AS slot_mu, round(v, 3) AS slot_var FROM slotted")
def slot_variance(spark, d):
    return slot_params(spark, d).select("secteur", F.date_format("tstamp", ISO).alias("tstamp"), "slot_mu", F.round("slot_var", 3).alias("slot_var"))


@query(views.LOW_VARIANCE, LOW_STATS, FIT, PARAMS, f"SELECT secteur, strftime(tstamp, {SQL_ISO}) AS tstamp, printf('%.5e', lam) AS lambda, printf('%.5e', e_psi) AS e_psi FROM full_params")
def arrival_params(spark, d):
    return slot_params(spark, d).select("secteur", F.date_format("tstamp", ISO).alias("tstamp"), digits("lambda", "lambda"), digits("e_psi", "e_psi"))


@query(
    views.LOW_VARIANCE,
    LOW_STATS,
    FIT,
    PARAMS,
    "counted AS (SELECT *, lam * (tau / (tau + zeta)) * 300 AS e_u FROM full_params)",
    "spread AS (SELECT *, e_u * (1 + 2 * lam * zeta / ((tau + zeta) * (tau + zeta))) AS var_u FROM counted)",
    f"""SELECT secteur, strftime(tstamp, {SQL_ISO}) AS tstamp, printf('%.5e', e_u) AS e_u, printf('%.5e', var_u) AS var_u, printf('%.5e', e_u * e_psi) AS e_total,
        printf('%.5e', e_u * e_psi * e_psi + var_u * e_psi * e_psi) AS var_total FROM spread""",
)
def model_moments(spark, d):
    m = traffic.model_moments(slot_params(spark, d))
    return m.select("secteur", F.date_format("tstamp", ISO).alias("tstamp"), *[digits(c, c) for c in ("e_u", "var_u", "e_total", "var_total")])


def generated(spark, d):
    """Per-slot traffic of the sectors of low variance; the slots are dealt by sector and time before they grow."""
    p = slot_params(spark, d).withColumnRenamed("tstamp", "dates_5min").withColumn("slot_mu", F.when(F.dayofmonth("dates_5min") % 5 == 0, 0.0).otherwise(F.col("slot_mu")))
    return generate.generate_ipp(p.repartition("secteur", "dates_5min"), seed=7)


@query(views.LOW_VARIANCE, "SELECT secteur, count(*) AS n_slots, count(*) * 300 AS n_seconds, count(*) FILTER (day(tstamp) % 5 = 0) AS empty_slots FROM low_variance GROUP BY secteur")
def generate_ipp_shape(spark, d):
    g = generated(spark, d)
    idle = F.aggregate("psi", F.lit(0.0), lambda a, x: a + x) == 0
    off = (F.dayofmonth("dates_5min") % 5 == 0) & idle
    return g.groupBy("secteur").agg(F.count("*").alias("n_slots"), F.sum(F.size("psi")).alias("n_seconds"), F.count(F.when(off, 1)).alias("empty_slots"))


@query(views.LOW_VARIANCE, f"SELECT secteur, strftime(tstamp + to_seconds(s), {SQL_ISO}) AS timestamp, trafic_mbps + s AS psi_instant FROM low_variance, range(300) r(s)")
def expand_seconds(spark, d):
    s = views.low_variance(spark, d).withColumn("psi", F.transform(F.sequence(F.lit(0), F.lit(299)), lambda i: F.col("trafic_mbps") + i))
    return generate.expand_seconds(s, start="tstamp").select("secteur", F.date_format("timestamp", ISO).alias("timestamp"), "psi_instant")


# ---- comparison

COARSE = "coarse AS (SELECT user_id::VARCHAR AS secteur, date_trunc('day', ts) AS dates_5min, max(value) AS trafic_mbps FROM events GROUP BY ALL)"


def coarse(spark, d):
    t = views.table(spark, d, "events")
    return t.groupBy(F.col("user_id").cast("string").alias("secteur"), F.date_trunc("day", F.col("ts").cast("timestamp")).alias("dates_5min")).agg(F.max("value").alias("trafic_mbps"))


@query(views.INSTANT, COARSE, "SELECT i.secteur, row_seq, psi_instant FROM instant i JOIN (SELECT secteur, min(dates_5min) AS a, max(dates_5min) AS b FROM coarse GROUP BY secteur) c ON i.secteur = c.secteur AND timestamp BETWEEN a AND b")
def clip_to_range(spark, d):
    return compare.clip_to_range(views.instant(spark, d), coarse(spark, d)).select("secteur", "row_seq", "psi_instant")


@query(views.INSTANT, "SELECT secteur, row_seq, round(CASE WHEN m > 0 THEN psi_instant / m ELSE psi_instant END, 6) AS normalized FROM (SELECT *, max(psi_instant) OVER (PARTITION BY secteur) AS m FROM instant)")
def normalize_by_max(spark, d):
    return compare.normalize_by_max(views.instant(spark, d), "psi_instant").select("secteur", "row_seq", r6("normalized", "normalized"))


DAILY = "daily AS (SELECT secteur, date_trunc('day', timestamp) AS timestamp, coalesce(sum(psi_instant), 0) AS psi_instant FROM instant GROUP BY ALL)"


@query(views.INSTANT, f"SELECT secteur, strftime(time_bucket(INTERVAL 5 MINUTES, timestamp), {SQL_ISO}) AS bin, round(coalesce(sum(psi_instant), 0), 6) AS total FROM instant GROUP BY ALL")
def resample_sum(spark, d):
    r = compare.resample_sum(views.instant(spark, d))
    return r.select("secteur", F.date_format("timestamp", ISO).alias("bin"), r6("psi_instant", "total"))


@query(
    views.INSTANT,
    DAILY,
    f"""SELECT b.secteur, strftime(b.t, {SQL_ISO}) AS bin, round(coalesce(psi_instant, 0), 6) AS total
        FROM (SELECT secteur, unnest(generate_series(min(timestamp), max(timestamp), INTERVAL 1 DAY)) AS t FROM daily GROUP BY secteur) b LEFT JOIN daily d ON d.secteur = b.secteur AND d.timestamp = b.t""",
)
def resample_sum_filled(spark, d):
    r = compare.resample_sum(views.instant(spark, d), "1 day", fill=True)
    return r.select("secteur", F.date_format("timestamp", ISO).alias("bin"), r6("psi_instant", "total"))


ALIGNED = "aligned AS (SELECT c.secteur, c.dates_5min, c.trafic_mbps, f.psi_instant FROM coarse c JOIN daily f ON c.secteur = f.secteur AND c.dates_5min = f.timestamp)"


def aligned(spark, d):
    return compare.align_slots(coarse(spark, d), compare.resample_sum(views.instant(spark, d), "1 day"))


@query(views.INSTANT, COARSE, DAILY, ALIGNED, f"SELECT secteur, strftime(dates_5min, {SQL_ISO}) AS slot, trafic_mbps, round(psi_instant, 6) AS psi_instant FROM aligned")
def align_slots(spark, d):
    return aligned(spark, d).select("secteur", F.date_format("dates_5min", ISO).alias("slot"), "trafic_mbps", r6("psi_instant", "psi_instant"))


@query(views.INSTANT, COARSE, DAILY, ALIGNED, "SELECT DISTINCT secteur FROM coarse WHERE secteur NOT IN (SELECT secteur FROM aligned)")
def unaligned_sectors(spark, d):
    return compare.unaligned_sectors(coarse(spark, d), compare.resample_sum(views.instant(spark, d), "1 day"))


@query(
    views.INSTANT,
    COARSE,
    DAILY,
    ALIGNED,
    f"""SELECT secteur, strftime(dates_5min, {SQL_ISO}) AS slot, round(trafic_mbps / nullif(max(trafic_mbps) OVER w, 0), 6) AS y_real, round(psi_instant / nullif(max(psi_instant) OVER w, 0), 6) AS y_gen
        FROM aligned WINDOW w AS (PARTITION BY secteur)""",
)
def normalize_aligned(spark, d):
    return compare.normalize_aligned(aligned(spark, d)).select("secteur", F.date_format("dates_5min", ISO).alias("slot"), r6("y_real", "y_real"), r6("y_gen", "y_gen"))


# ---- tokens

BACK = "backwards AS (SELECT *, row_number() OVER (PARTITION BY sector ORDER BY first_seq DESC, row_seq DESC) AS back FROM canon)"
CONTEXT = BACK + ",\ncontext AS (SELECT * FROM backwards WHERE back >= 2)"

#: Points that ``last_context`` keeps; every other query takes all points before the last.
SIZE = 64


def context(spark, d):
    """All points of each series before its last one."""
    return series.all_but_last(ordered(spark, d))


@query(views.HISTORY, CANON, BACK, f"SELECT sector, timestamp_iso, trafic_mbps, ({SIZE} + 2 - back)::INTEGER AS pos FROM backwards WHERE back BETWEEN 2 AND {SIZE} + 1")
def last_context(spark, d):
    return tokens.last_context(ordered(spark, d), SIZE).select("sector", "timestamp_iso", "trafic_mbps", F.col("pos").cast("int").alias("pos"))


SCALED = """scaled AS (SELECT *, trafic_mbps / scale AS scaled FROM (
  SELECT *, CASE WHEN avg(abs(trafic_mbps)) OVER (PARTITION BY sector) > 0 THEN avg(abs(trafic_mbps)) OVER (PARTITION BY sector) ELSE 1 END AS scale FROM context))"""
BINNED = "binned AS (SELECT *, least(4094, greatest(1, floor((scaled + 15.0::DOUBLE) / (30.0::DOUBLE / 4093) + 0.5::DOUBLE) + 1))::INTEGER AS bin FROM scaled)"


@query(views.HISTORY, CANON, CONTEXT, SCALED, "SELECT sector, row_seq, round(scale, 6) AS scale, round(scaled, 6) AS scaled FROM scaled")
def mean_scale(spark, d):
    return tokens.mean_scale(context(spark, d)).select("sector", "row_seq", r6("scale", "scale"), r6("scaled", "scaled"))


@query(views.HISTORY, CANON, CONTEXT, SCALED, BINNED, "SELECT sector, row_seq, bin FROM binned")
def quantize(spark, d):
    return tokens.quantize(tokens.mean_scale(context(spark, d))).select("sector", "row_seq", "bin")


@query(views.HISTORY, CANON, CONTEXT, SCALED, BINNED, "SELECT sector, row_seq, round((-15.0::DOUBLE + (bin - 1) * (30.0::DOUBLE / 4093)) * scale, 6) AS restored FROM binned")
def dequantize(spark, d):
    return tokens.dequantize(tokens.quantize(tokens.mean_scale(context(spark, d)))).select("sector", "row_seq", r6("restored", "restored"))


@query(
    views.HISTORY,
    CANON,
    CONTEXT,
    SCALED,
    BINNED,
    "probs AS (SELECT sector, bin, count(*)::DOUBLE / sum(count(*)) OVER (PARTITION BY sector) AS p FROM binned GROUP BY sector, bin)",
    "upto AS (SELECT *, sum(p) OVER (PARTITION BY sector ORDER BY bin ROWS UNBOUNDED PRECEDING) AS c FROM probs)",
    "SELECT sector, 1 AS step, level, min(bin) AS bin FROM upto, (VALUES (0.1::DOUBLE), (0.5::DOUBLE), (0.9::DOUBLE)) l(level) WHERE c >= level - 1e-12 GROUP BY sector, level",
)
def bin_quantiles(spark, d):
    b = tokens.quantize(tokens.mean_scale(context(spark, d)))
    counts = b.groupBy("sector", "bin").agg(F.count("*").alias("n"))
    total = b.groupBy("sector").agg(F.count("*").alias("all"))
    probs = counts.join(total, "sector").select("sector", F.lit(1).alias("step"), "bin", (F.col("n").cast("double") / F.col("all")).alias("p"))
    return tokens.quantiles_from_bins(probs, (0.1, 0.5, 0.9)).select("sector", "step", "level", "bin")


# ---- forecasts

SAMPLES = "samples AS (SELECT 'm' || (event_id % 2)::VARCHAR AS model_id, user_id AS sector, (event_id % 32)::INTEGER AS k, (event_id % 9 + 1) / 10.0::DOUBLE AS level, ((event_id // 7) % 3)::INTEGER AS step, value FROM events)"


def samples(spark, d):
    t = views.table(spark, d, "events")
    e = F.col("event_id")
    return t.select(F.concat(F.lit("m"), (e % 2).cast("string")).alias("model_id"), F.col("user_id").alias("sector"), (e % 32).cast("int").alias("k"), ((e % 9 + 1) / F.lit(10.0)).alias("level"), (F.floor(e / 7) % 3).cast("int").alias("step"), "value")


LAST_STEP = "last_step AS (SELECT * FROM (SELECT *, max(step) OVER (PARTITION BY model_id, sector) AS top FROM samples) WHERE step = top)"


@query(SAMPLES, LAST_STEP, "SELECT model_id, sector, round(avg(value), 6) AS prediction FROM last_step GROUP BY ALL")
def point_from_samples(spark, d):
    return forecast.point_from_samples(samples(spark, d)).select("model_id", "sector", r6("prediction", "prediction"))


FAR = "far AS (SELECT model_id, sector, step, k, level, min(value) AS value FROM samples GROUP BY ALL)"


@query(SAMPLES, FAR, "SELECT model_id, sector, value AS prediction FROM (SELECT *, row_number() OVER (PARTITION BY model_id, sector ORDER BY step DESC, abs(level - 0.5::DOUBLE), k, level) AS r FROM far) WHERE r = 1")
def point_from_quantiles(spark, d):
    once = samples(spark, d).groupBy("model_id", "sector", "step", "k", "level").agg(F.min("value").alias("value"))
    return forecast.point_from_quantiles(once)


@query(SAMPLES, LAST_STEP, "SELECT model_id, sector, round(avg(value), 6) AS prediction FROM last_step GROUP BY ALL")
def point_mean_outputs(spark, d):
    outputs = samples(spark, d).select("model_id", "sector", F.col("k").alias("i0"), F.col("step").alias("i1"), F.lit(None).cast("int").alias("i2"), "value")
    return forecast.point_from_outputs(outputs).select("model_id", "sector", r6("prediction", "prediction"))


def _forecast(how: str, sql: str):
    def run(spark, d):
        return forecast.forecast_native(context(spark, d), how).select("sector", r6("prediction", "prediction"))

    run.__name__ = f"forecast_{how}"
    query(views.HISTORY, CANON, CONTEXT, f"SELECT sector, round({sql}, 6) AS prediction FROM context GROUP BY sector")(run)


for _how, _sql in (("last", "arg_max(trafic_mbps, first_seq)"), ("mean", "avg(trafic_mbps)"), ("median", "median(trafic_mbps)")):
    _forecast(_how, _sql)


@query(
    views.HISTORY,
    CANON,
    CONTEXT,
    "SELECT 'median' AS model_id, sector, 0 AS k, 1 AS step, round(median(trafic_mbps), 6) AS value FROM context GROUP BY sector",
)
def batch_forecast(spark, d):
    e = series.build_examples(canon(spark, d), stamps=False)
    return forecast.batch_forecast(e, "median", "median").select("model_id", "sector", "k", "step", r6("value", "value"))


@query(
    views.HISTORY,
    CANON,
    CONTEXT,
    SCALED,
    BINNED,
    "probs AS (SELECT sector, any_value(scale) AS scale, bin, count(*)::DOUBLE / sum(count(*)) OVER (PARTITION BY sector) AS p FROM binned GROUP BY sector, bin)",
    "upto AS (SELECT *, sum(p) OVER (PARTITION BY sector ORDER BY bin ROWS UNBOUNDED PRECEDING) AS c FROM probs)",
    "SELECT 'binned' AS model_id, sector, round((-15.0::DOUBLE + (min(bin) - 1) * (30.0::DOUBLE / 4093)) * any_value(scale), 6) AS value FROM upto WHERE c >= 0.5 - 1e-12 GROUP BY sector",
)
def batch_forecast_binned(spark, d):
    e = series.build_examples(canon(spark, d), stamps=False)
    return forecast.batch_forecast(e, "binned", "binned").select("model_id", "sector", r6("value", "value"))


# ---- scores

TARGETS = "targets AS (SELECT sector, arg_max(site, first_seq) AS site, arg_max(trafic_mbps, first_seq) AS target FROM canon GROUP BY sector)"
SCORED = """scored AS (SELECT CASE WHEN right(site, 1) IN ('0', '1', '2', '3') THEN 'instant_short' ELSE 'original' END AS dataset, model_id, sector, site, target, prediction, (prediction - target) * (prediction - target) AS squared_error FROM (
  SELECT sector, 'last' AS model_id, arg_max(trafic_mbps, first_seq) AS prediction FROM context GROUP BY sector UNION ALL
  SELECT sector, 'mean', avg(trafic_mbps) FROM context GROUP BY sector UNION ALL SELECT sector, 'median', median(trafic_mbps) FROM context GROUP BY sector) JOIN targets USING (sector))"""
SUMMARY = "summary AS (SELECT dataset, model_id, sqrt(avg(squared_error)) AS rmse, count(*) AS num_series FROM scored GROUP BY ALL)"
BASE = (views.HISTORY, CANON, CONTEXT, TARGETS, SCORED)


def scored(spark, d):
    """Every built-in forecaster on every series; two data sets by site, from one ordering of the history."""
    short = F.substring("site", -1, 1).isin("0", "1", "2", "3")
    return score.evaluate_models(ordered(spark, d), None).withColumn("dataset", F.when(short, "instant_short").otherwise("original"))


@query(*BASE, "SELECT sector, site, target, round(prediction, 6) AS prediction, round(squared_error, 6) AS squared_error FROM scored WHERE model_id = 'mean'")
def score_series(spark, d):
    rows = ordered(spark, d)
    targets = rows.groupBy("sector").agg(F.max_by(F.struct("site", "trafic_mbps"), F.struct("first_seq", "row_seq")).alias("t")).select("sector", "t.site", F.col("t.trafic_mbps").alias("target"))
    made = forecast.forecast_native(series.all_but_last(rows), "mean")
    return score.score_series(made, targets).select("sector", "site", "target", r6("prediction", "prediction"), r6("squared_error", "squared_error"))


@query(*BASE, SUMMARY, "SELECT dataset, model_id, round(rmse, 6) AS rmse, num_series FROM summary")
def rmse(spark, d):
    return score.rmse(scored(spark, d)).withColumn("rmse", F.round("rmse", 6))


@query(*BASE, "SELECT model_id, sector, site, target, round(prediction, 6) AS prediction, round(squared_error, 6) AS squared_error FROM scored")
def evaluate_models(spark, d):
    return scored(spark, d).select("model_id", "sector", "site", "target", r6("prediction", "prediction"), r6("squared_error", "squared_error"))


def drift():
    """A forecaster of one's own: the last value and the mean step of the context."""
    return lambda contexts, samples, seed: np.array([c[-1] + (c[-1] - c[0]) / max(1, len(c) - 1) for c in contexts])


@query(
    views.HISTORY,
    CANON,
    CONTEXT,
    TARGETS,
    "ends AS (SELECT sector, arg_min(trafic_mbps, first_seq) AS a, arg_max(trafic_mbps, first_seq) AS b, count(*) AS n FROM context GROUP BY sector)",
    "SELECT 'drift' AS model_id, sector, target, round(b + (b - a) / greatest(1, n - 1), 6) AS prediction FROM ends JOIN targets USING (sector) UNION ALL SELECT 'last', sector, target, round(b, 6) FROM ends JOIN targets USING (sector)",
)
def evaluate_forecasters(spark, d):
    e = series.build_examples(canon(spark, d), stamps=False)
    return score.evaluate_forecasters(e, {"drift": drift, "last": "last"}).select("model_id", "sector", "target", r6("prediction", "prediction"))


@query(*BASE, SUMMARY, "SELECT dataset, model_id, round(rmse, 6) AS rmse, num_series, 32 AS num_samples FROM summary")
def summary_table(spark, d):
    return score.summary_table(scored(spark, d)).withColumn("rmse", F.round("rmse", 6))


LOOKUP_ROWS = [("last", "1K"), ("median", "2K"), ("other", "9M")]
LOOKUP = "lookup AS (SELECT * FROM (VALUES ('last', '1K'), ('median', '2K'), ('other', '9M')) l(model_id, parameters))"


def with_parameters(spark, d):
    lookup = spark.createDataFrame(LOOKUP_ROWS, "model_id string, parameters string")
    return score.attach_parameters(score.summary_table(scored(spark, d)), lookup)


@query(*BASE, SUMMARY, LOOKUP, "SELECT dataset, model_id, round(rmse, 6) AS rmse, num_series, 32 AS num_samples, parameters FROM summary LEFT JOIN lookup USING (model_id)")
def summary_parameters(spark, d):
    return with_parameters(spark, d).withColumn("rmse", F.round("rmse", 6))


@query(*BASE, SUMMARY, LOOKUP, "SELECT model_id, round(rmse, 6) AS rmse, parameters FROM summary LEFT JOIN lookup USING (model_id) WHERE dataset = 'original' ORDER BY list_position(['median', 'last', 'mean'], model_id)")
def summary_ranked(spark, d):
    return score.order_by_list(with_parameters(spark, d).filter("dataset = 'original'"), ["median", "last", "mean"]).withColumn("rmse", F.round("rmse", 6))


@query(*BASE, SUMMARY, "SELECT dataset, model_id, round(rmse, 6) AS rmse FROM (SELECT *, row_number() OVER (PARTITION BY dataset ORDER BY rmse, model_id) AS r FROM summary) WHERE r = 1")
def best_model(spark, d):
    return score.best_model(score.rmse(scored(spark, d))).withColumn("rmse", F.round("rmse", 6))


@query(
    *BASE,
    SUMMARY,
    LOOKUP,
    "sized AS (SELECT dataset, model_id, rmse, CASE WHEN parameters LIKE '%K' THEN regexp_replace(parameters, 'K', '')::DOUBLE * 1e3 WHEN parameters LIKE '%M' THEN regexp_replace(parameters, 'M', '')::DOUBLE * 1e6 END AS n_parameters FROM summary LEFT JOIN lookup USING (model_id))",
    """SELECT dataset, model_id, n_parameters, round(rmse, 6) AS rmse, round(lag(rmse) OVER w, 6) AS previous_rmse, coalesce((rmse > lag(rmse) OVER w)::INTEGER, -1) AS rises
       FROM sized WINDOW w AS (PARTITION BY dataset ORDER BY n_parameters NULLS FIRST, model_id)""",
)
def size_vs_error(spark, d):
    return score.size_vs_error(with_parameters(spark, d)).select("dataset", "model_id", "n_parameters", r6("rmse", "rmse"), r6("previous_rmse", "previous_rmse"), F.coalesce(F.col("rises").cast("int"), F.lit(-1)).alias("rises"))


@query(
    *BASE,
    "zeroed AS (SELECT dataset, model_id, prediction, CASE WHEN target < 60 THEN 0 ELSE target END AS z FROM scored)",
    """SELECT dataset, model_id, round(avg((z = 0)::INTEGER), 6) AS zero_share, round(sqrt(avg(CASE WHEN z = 0 THEN (prediction - z) * (prediction - z) END)), 6) AS rmse_zero,
       round(sqrt(avg(CASE WHEN z <> 0 THEN (prediction - z) * (prediction - z) END)), 6) AS rmse_other FROM zeroed GROUP BY ALL""",
)
def zero_target_share(spark, d):
    s = scored(spark, d).withColumn("target", F.when(F.col("target") < 60, 0.0).otherwise(F.col("target")))
    s = s.withColumn("squared_error", (F.col("prediction") - F.col("target")) * (F.col("prediction") - F.col("target")))
    z = score.zero_target_share(s)
    return z.select("dataset", "model_id", r6("zero_share", "zero_share"), r6("rmse_zero", "rmse_zero"), r6("rmse_other", "rmse_other"))


@query(
    *BASE,
    SUMMARY,
    "means AS (SELECT avg(rmse) FILTER (dataset = 'original') AS a, avg(rmse) FILTER (dataset = 'instant_short') AS b FROM summary)",
    "SELECT round(a, 6) AS mean_a, round(b, 6) AS mean_b, round(a / nullif(b, 0), 6) AS ratio FROM means",
)
def rmse_ratio(spark, d):
    return score.rmse_ratio(score.rmse(scored(spark, d)), "original", "instant_short").select(r6("mean_a", "mean_a"), r6("mean_b", "mean_b"), r6("ratio", "ratio"))


REPORT = "SELECT s.dataset, s.model_id, num_series::INTEGER AS num_series, 32 AS num_samples, round(rmse, 6) AS rmse, sector, site, target, round(prediction, 6) AS prediction, round(squared_error, 6) AS squared_error FROM scored s JOIN summary USING (dataset, model_id)"
STAMP = "2025-01-01T00:00:00"


def report_rows(rows):
    return rows.select("dataset", "model_id", "num_series", "num_samples", r6("rmse", "rmse"), "sector", "site", "target", r6("prediction", "prediction"), r6("squared_error", "squared_error"))


@query(*BASE, SUMMARY, REPORT)
def eval_report(spark, d):
    r = reports.build_reports(scored(spark, d), stamp=STAMP)
    return report_rows(r.select("dataset", "model_id", "num_series", "num_samples", "rmse", F.explode("per_series").alias("s")).select("dataset", "model_id", "num_series", "num_samples", "rmse", "s.*"))


# ---- written and read back


@query(views.HISTORY, views.RAW, "SELECT secteur, site, tstamp, trafic_mbps, row_seq::VARCHAR AS line FROM raw")
def read_csv_history(spark, d):
    """The export as a latin-1 CSV file, its separator found out by the reader."""
    path = shared.new_folder(spark, "history-csv")
    files.write_traffic_csv(views.raw(spark, d).select("secteur", "site", "tstamp", "trafic_mbps", F.col("row_seq").cast("string").alias("line")), path)
    return files.read_traffic_csv(spark, path).select("secteur", "site", "tstamp", "trafic_mbps", "line")


@query(views.INSTANT, f"SELECT secteur, strftime(timestamp, {SQL_ISO}) AS timestamp, psi_instant, row_seq FROM instant")
def read_instant(spark, d):
    path = shared.new_folder(spark, "instant")
    files.write_instant(views.instant(spark, d), path)
    return spark.read.parquet(path).select("secteur", F.date_format("timestamp", ISO).alias("timestamp"), "psi_instant", "row_seq")


@query(
    views.HISTORY,
    CANON,
    """SELECT sector, list(site ORDER BY first_seq, row_seq)[1] AS site, string_agg(timestamp_iso, ',' ORDER BY first_seq, row_seq) AS stamps,
       array_to_string(list_transform(list(trafic_mbps ORDER BY first_seq, row_seq)[:-2], lambda x: x::BIGINT::VARCHAR), ',') AS context,
       arg_max(trafic_mbps, first_seq) AS target, count(*)::INTEGER - 1 AS context_length FROM canon GROUP BY sector HAVING count(*) >= 2""",
)
def read_examples(spark, d):
    path = shared.new_folder(spark, "examples")
    examples.write_examples(series.build_examples(canon(spark, d)), path)
    return example_rows(examples.read_examples(spark, path))


@query(*BASE, SUMMARY, REPORT)
def read_reports(spark, d):
    path = shared.new_folder(spark, "reports")
    reports.write_reports(reports.build_reports(scored(spark, d), stamp=STAMP), path)
    return report_rows(reports.read_reports(spark, path))


@query(*BASE, SUMMARY, LOOKUP, "SELECT model_id, round(rmse, 6) AS rmse, parameters FROM summary LEFT JOIN lookup USING (model_id) WHERE dataset = 'original'")
def read_summary(spark, d):
    path = shared.new_folder(spark, "summary")
    reports.write_summary(score.order_by_list(with_parameters(spark, d).filter("dataset = 'original'"), ["median", "last", "mean"]), path)
    return reports.read_summary(spark, path).withColumn("rmse", F.round("rmse", 6))
