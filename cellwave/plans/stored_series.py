"""Queries of free-form dates, of files of several dialects, of tables written to be read in part or joined in place, and of shaped outputs."""

from __future__ import annotations

from pyspark.sql import functions as F

from cellwave.functions.freedates import parse_free_date
from cellwave.operators import compare, forecast
from cellwave.plans import views
from cellwave.plans.registry import ALIGNED, COARSE, DAILY, ISO, SQL_ISO, coarse, query, r6
from cellwave.sources import shared, traffic as files

#: How a free-form date is written, by week number modulo their count: Spark's pattern, and DuckDB's to write and to read it.
SPELT = (
    ("d MMMM yyyy", "%-d %B %Y", "%d %B %Y"),
    ("MMMM d, yyyy", "%B %-d, %Y", "%B %d, %Y"),
    ("EEE d MMM yyyy", "%a %-d %b %Y", "%a %d %b %Y"),
    ("EEEE, MMMM d yyyy 'at' h:mm", "%A, %B %-d %Y at %-I:%M", "%A, %B %d %Y at %I:%M"),
    ("dd-MMM-yyyy hh:mm:ss", "%d-%b-%Y %I:%M:%S", "%d-%b-%Y %I:%M:%S"),
    ("d MMM yy", "%-d %b %y", "%d %b %y"),
    ("d/M/yyyy HH:mm", "%-d/%-m/%Y %H:%M", "%d/%m/%Y %H:%M"),
    ("dd.MM.yyyy", "%d.%m.%Y", "%d.%m.%Y"),
    ("yyyy MMMM d", "%Y %B %-d", "%Y %B %d"),
    ("'the' d MMMM yyyy", "the %-d %B %Y", None),
    ("'99' MMMM yyyy", "99 %B %Y", None),
    ("MMMM yyyy", "%B %Y", None),
)


def _cases(parts: list[str]) -> str:
    return "CASE week % " + str(len(parts)) + " " + " ".join(f"WHEN {i} THEN {p}" for i, p in enumerate(parts)) + " END"


WRITTEN = f"written AS (SELECT row_seq, week, {_cases([f'strftime(tstamp, {chr(39)}{w}{chr(39)})' for _, w, _ in SPELT])} AS spelt FROM history)"
READ = _cases([f"try_strptime(spelt, '{r}')" if r else "NULL" for _, _, r in SPELT])


@query(views.HISTORY, WRITTEN, f"SELECT row_seq, spelt, strftime({READ}, {SQL_ISO}) AS parsed FROM written")
def free_dates(spark, d):
    """The weeks of the history in twelve free spellings, three of which are no dates, and what the grammar reads."""
    h = views.history(spark, d)
    # the hour is midnight: 12-hour patterns show it as 12, read as noon, in both engines
    kind, spelt = F.col("week") % len(SPELT), F.lit(None).cast("string")
    for i, (pattern, _, _) in enumerate(SPELT):
        spelt = F.when(kind == i, F.date_format("tstamp", pattern)).otherwise(spelt)
    return h.select("row_seq", spelt.alias("spelt")).withColumn("parsed", F.date_format(parse_free_date(F.col("spelt")), ISO))


@query(
    views.HISTORY,
    views.RAW,
    "kinds AS (SELECT *, week % 3 AS kind FROM raw)",
    """SELECT secteur, CASE WHEN kind <> 2 THEN site END AS site, CASE WHEN kind = 1 THEN tstamp || ', "vu"; ' || site ELSE tstamp END AS tstamp, trafic_mbps, row_seq::VARCHAR AS line,
         row_number() OVER (ORDER BY kind, row_seq) + kind AS place FROM kinds""",
)
def read_mixed_csv(spark, d):
    """The export as three latin-1 files, each in parts: of semicolons; of commas, with quoted fields that hold separators and quotes; of tabs, without the site. ``place`` is the row's line number."""
    path = shared.keep(spark, "mixed-csv")
    raw = views.raw(spark, d).withColumn("kind", F.col("week") % 3).withColumn("line", F.col("row_seq").cast("string"))
    raw = shared.stored(raw, "mixed-raw")  # read twice for each file: for the ranges of its parts and for its rows
    noted = F.concat(F.col("tstamp"), F.lit(', "vu"; '), F.col("site"))
    for kind, sep in enumerate((";", ",", "\t")):
        rows = raw.filter(F.col("kind") == kind).withColumn("tstamp", noted if kind == 1 else F.col("tstamp"))
        columns = [c for c in ("secteur", "site", "tstamp", "trafic_mbps", "line") if kind != 2 or c != "site"]
        files.write_file_in_parts(rows.select(*columns, "row_seq"), f"{path}/{kind}", "row_seq", sep)
    return files.read_traffic_csv(spark, f"{path}/*", parts=True).select("secteur", "site", "tstamp", "trafic_mbps", "line", F.col("row_seq").alias("place"))


#: The last days of each sector's coarse series: a range that few files of a long history meet.
RECENT = "recent AS (SELECT secteur, max(dates_5min) - INTERVAL 2 DAYS AS a, max(dates_5min) AS b FROM coarse GROUP BY secteur)"


@query(views.INSTANT, COARSE, RECENT, "SELECT i.secteur, row_seq, psi_instant FROM instant i JOIN recent c ON i.secteur = c.secteur AND timestamp BETWEEN a AND b")
def clip_to_range_indexed(spark, d):
    """Per-second rows within the last two days of their sector's coarse series, from the files that the index names."""
    path, index = shared.keep(spark, "instant"), shared.keep(spark, "instant-index")
    files.write_instant(views.instant(spark, d), path)
    files.write_range_index(spark.read.parquet(path), index)
    recent = coarse(spark, d).groupBy("secteur").agg((F.max("dates_5min") - F.expr("INTERVAL 2 DAYS")).alias("from"), F.max("dates_5min").alias("to"))
    ends = recent.select("secteur", F.explode(F.array("from", "to")).alias("dates_5min"))
    return compare.clip_to_range(files.read_instant_range(spark, path, index, recent), ends).select("secteur", "row_seq", "psi_instant")


def co_located(spark, d):
    """Coarse and fine series in bucketed tables, aligned and scaled where they lie."""
    buckets = max(8, spark.sparkContext.defaultParallelism)
    left = files.write_co_located(coarse(spark, d), "coarse", buckets, time="dates_5min")
    right = files.write_co_located(compare.resample_sum(views.instant(spark, d), "1 day"), "fine", buckets)
    return compare.normalize_aligned(compare.align_slots(*files.read_co_located(spark, left, right)))


@query(
    views.INSTANT,
    COARSE,
    DAILY,
    ALIGNED,
    f"""SELECT secteur, strftime(dates_5min, {SQL_ISO}) AS slot, round(trafic_mbps / nullif(max(trafic_mbps) OVER w, 0), 6) AS y_real, round(psi_instant / nullif(max(psi_instant) OVER w, 0), 6) AS y_gen
        FROM aligned WINDOW w AS (PARTITION BY secteur)""",
)
def align_co_located(spark, d):
    return co_located(spark, d).select("secteur", F.date_format("dates_5min", ISO).alias("slot"), r6("y_real", "y_real"), r6("y_gen", "y_gen"))


@query(
    "samples AS (SELECT 'm' || (event_id % 2)::VARCHAR AS model_id, user_id AS sector, (user_id + 3) % 4 AS depth, (event_id // 3) % 2 AS series, (event_id // 7) % 3 AS step, value FROM events)",
    "taken AS (SELECT *, CASE WHEN depth = 0 THEN 0 ELSE step END AS spot FROM samples WHERE depth < 3 OR series = 0)",
    "SELECT model_id, sector, round(avg(value), 6) AS prediction FROM (SELECT *, max(spot) OVER (PARTITION BY model_id, sector) AS top FROM taken) WHERE spot = top GROUP BY ALL",
)
def point_shaped_outputs(spark, d):
    """Outputs whose arrays have no dimension, one, two or three, by sector: scalars, steps, samples by steps, series by samples by steps."""
    depth, none = (F.col("sector") + 3) % 4, F.lit(None).cast("long")
    t = views.table(spark, d, "events").select(F.concat(F.lit("m"), (F.col("event_id") % 2).cast("string")).alias("model_id"), F.col("user_id").alias("sector"), "event_id", "value")
    series, sample, step = F.floor(F.col("event_id") / 3) % 2, F.col("event_id") % 32, F.floor(F.col("event_id") / 7) % 3
    shaped = t.select(
        "model_id",
        "sector",
        F.when(depth == 1, step).when(depth == 2, sample).when(depth == 3, series).otherwise(none).alias("i0"),
        F.when(depth == 2, step).when(depth == 3, sample).otherwise(none).alias("i1"),
        F.when(depth == 3, step).otherwise(none).alias("i2"),
        "value",
    )
    return forecast.point_from_outputs(shaped).select("model_id", "sector", r6("prediction", "prediction"))
