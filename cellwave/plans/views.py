"""The driver's tables in the shape of traffic data, for Spark and, as SQL text, for DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellwave.functions.dates import MONTHS


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weekly quantity of each supplier: secteur, site, tstamp, trafic_mbps, week, row_seq (no chronological order)."""
    t = table(spark, sf_dir, "lineitem").select("l_suppkey", F.date_trunc("week", "l_shipdate").alias("tstamp"), "l_quantity")
    g = t.groupBy("l_suppkey", "tstamp").agg(F.sum("l_quantity").alias("trafic_mbps"))
    week = (F.datediff("tstamp", F.lit("1990-01-01").cast("date")) / 7).cast("long")
    site = F.concat(F.lit("T"), F.lpad(F.col("l_suppkey").cast("string"), 5, "0"))
    g = g.withColumn("week", week).withColumn("site", site)
    return g.select(F.concat("site", F.lit("A")).alias("secteur"), "site", "tstamp", "trafic_mbps", "week", (F.pmod(F.col("week") * 7919, F.lit(10007)) * 1_000_000 + F.col("l_suppkey")).cast("long").alias("row_seq"))


HISTORY = """history AS (
  SELECT site || 'A' AS secteur, site, tstamp, trafic_mbps, week, ((week * 7919) % 10007) * 1000000 + l_suppkey AS row_seq
  FROM (SELECT l_suppkey, 'T' || lpad(l_suppkey::VARCHAR, 5, '0') AS site, date_trunc('week', l_shipdate)::TIMESTAMP AS tstamp,
               sum(l_quantity) AS trafic_mbps, (date_diff('day', DATE '1990-01-01', date_trunc('week', min(l_shipdate))::DATE) // 7)::BIGINT AS week
        FROM lineitem GROUP BY l_suppkey, date_trunc('week', l_shipdate)))"""


#: Suppliers whose quantities make one series of low variance.
GROUP = 20


def low_variance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weekly quantity of each 20 suppliers: series whose variance is low against their mean, as many as the suppliers make."""
    name = F.concat(F.lit("G"), F.lpad(F.floor(F.col("l_suppkey") / GROUP).cast("string"), 5, "0"))
    t = table(spark, sf_dir, "lineitem").select(name.alias("secteur"), F.date_trunc("week", "l_shipdate").alias("tstamp"), "l_quantity")
    return t.groupBy("secteur", "tstamp").agg(F.sum("l_quantity").alias("trafic_mbps"))


LOW_VARIANCE = f"""low_variance AS (
  SELECT 'G' || lpad((l_suppkey // {GROUP})::VARCHAR, 5, '0') AS secteur, date_trunc('week', l_shipdate)::TIMESTAMP AS tstamp, sum(l_quantity) AS trafic_mbps
  FROM lineitem GROUP BY ALL)"""


def raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The history as an export spells it: secteur, site, tstamp, trafic_mbps as texts in several spellings, by week number."""
    h = history(spark, sf_dir)
    month = F.element_at(F.array(*[F.lit(m) for m in MONTHS]), F.month("tstamp"))
    plain = F.translate(month, "éû", "eu")
    kind = F.col("week") % 8
    day, year = F.dayofmonth("tstamp").cast("string"), F.year("tstamp").cast("string")
    spelt = (
        F.when(kind == 0, F.concat(F.lit("lundi "), day, F.lit(" "), month, F.lit(" "), year))
        .when(kind == 1, F.concat(F.lit("  lundi  "), day, F.lit(" "), F.upper(month), F.lit(" "), year))
        .when(kind == 2, F.concat(F.lit("lundi\u00a0"), day, F.lit("\u00a0"), plain, F.lit(" "), year))
        .when(kind == 3, F.concat(day, F.lit(" "), month, F.lit(" "), year))
        .when(kind == 4, F.concat(F.lit("lundi "), day, F.lit(" brumaire "), year))
        .when(kind == 5, F.date_format("tstamp", "yyyy-MM-dd HH:mm:ss"))
        .when(kind == 6, F.date_format("tstamp", "dd/MM/yyyy HH:mm"))
        .otherwise(F.lit("lundi 45 juin 2018"))
    )
    number = F.format_string("%.2f", F.col("trafic_mbps") / 4)
    value = (
        F.when(kind == 1, F.concat(F.replace(number, F.lit("."), F.lit(",")), F.lit(" Mbps")))
        .when(kind == 3, F.concat(F.lit(" "), number, F.lit(" ")))
        .when(kind == 5, F.replace(number, F.lit("."), F.lit(",")))
        .when(kind == 6, F.lit("abc"))
        .when(kind == 7, F.concat(F.lit("1."), F.replace(number, F.lit("."), F.lit(","))))
        .otherwise(number)
    )
    return h.select("secteur", "site", spelt.alias("tstamp"), value.alias("trafic_mbps"), "week", "row_seq")


MONTHS_SQL = "[" + ", ".join(f"'{m}'" for m in MONTHS) + "]"
RAW = f"""raw AS (
  SELECT secteur, site, week, row_seq,
    CASE week % 8 WHEN 0 THEN 'lundi ' || d || ' ' || m || ' ' || y WHEN 1 THEN '  lundi  ' || d || ' ' || upper(m) || ' ' || y
      WHEN 2 THEN 'lundi\u00a0' || d || '\u00a0' || translate(m, 'éû', 'eu') || ' ' || y WHEN 3 THEN d || ' ' || m || ' ' || y
      WHEN 4 THEN 'lundi ' || d || ' brumaire ' || y WHEN 5 THEN strftime(t, '%Y-%m-%d %H:%M:%S') WHEN 6 THEN strftime(t, '%d/%m/%Y %H:%M')
      ELSE 'lundi 45 juin 2018' END AS tstamp,
    CASE week % 8 WHEN 1 THEN replace(n, '.', ',') || ' Mbps' WHEN 3 THEN ' ' || n || ' ' WHEN 5 THEN replace(n, '.', ',') WHEN 6 THEN 'abc'
      WHEN 7 THEN '1.' || replace(n, '.', ',') ELSE n END AS trafic_mbps
  FROM (SELECT *, tstamp AS t, day(tstamp)::VARCHAR AS d, year(tstamp)::VARCHAR AS y, ({MONTHS_SQL})[month(tstamp)] AS m, printf('%.2f', trafic_mbps / 4) AS n FROM history))"""


def instant(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as instant traffic: secteur (user), timestamp, psi_instant, row_seq."""
    t = table(spark, sf_dir, "events")
    return t.select(F.col("user_id").cast("string").alias("secteur"), F.col("ts").cast("timestamp").alias("timestamp"), F.col("value").alias("psi_instant"), F.col("event_id").alias("row_seq"))


INSTANT = "instant AS (SELECT user_id::VARCHAR AS secteur, ts AS timestamp, value AS psi_instant, event_id AS row_seq FROM events)"
