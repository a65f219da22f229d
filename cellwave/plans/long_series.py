"""Queries of operators for series of any length."""

from __future__ import annotations

from pyspark.sql import functions as F

from cellwave.operators import chunks, rank, score, selection
from cellwave.plans import views
from cellwave.plans.drawn import score_targets
from cellwave.plans.registry import BINNED, CANON, CONTEXT, SCALED, TARGETS, context, ordered, query, r6


@query(views.INSTANT, "SELECT secteur, row_seq, row_number() OVER (PARTITION BY secteur ORDER BY timestamp, row_seq) AS rank, count(*) OVER (PARTITION BY secteur) AS size FROM instant")
def ranked(spark, d):
    made = rank.ranked(views.instant(spark, d), "secteur", [F.col("timestamp"), F.col("row_seq")], "rank", "size")
    return made.select("secteur", "row_seq", "rank", "size")


@query(
    views.INSTANT,
    "SELECT secteur, level, round(q, 6) AS quantile FROM (SELECT secteur, unnest([0.1::DOUBLE, 0.5::DOUBLE, 0.9::DOUBLE]) AS level, unnest(quantile_cont(psi_instant, [0.1, 0.5, 0.9])) AS q FROM instant GROUP BY secteur)",
)
def exact_quantiles(spark, d):
    made = selection.exact_quantiles(views.instant(spark, d), "secteur", "psi_instant", (0.1, 0.5, 0.9), few=64)
    return made.select("secteur", "level", r6("quantile", "quantile"))


@query(views.HISTORY, CANON, CONTEXT, "SELECT sector, round(median(trafic_mbps), 6) AS prediction FROM context GROUP BY sector")
def median_selection(spark, d):
    made = selection.exact_quantiles(context(spark, d), "sector", "trafic_mbps", few=64)
    return made.select("sector", r6("quantile", "prediction"))


@query(
    views.HISTORY,
    CANON,
    CONTEXT,
    SCALED,
    BINNED,
    TARGETS,
    "probs AS (SELECT sector, any_value(scale) AS scale, bin, count(*)::DOUBLE / sum(count(*)) OVER (PARTITION BY sector) AS p FROM binned GROUP BY sector, bin)",
    "upto AS (SELECT *, sum(p) OVER (PARTITION BY sector ORDER BY bin ROWS UNBOUNDED PRECEDING) AS c FROM probs)",
    """made AS (SELECT 'last' AS model_id, sector, arg_max(trafic_mbps, first_seq) AS prediction FROM context GROUP BY sector UNION ALL SELECT 'mean', sector, avg(trafic_mbps) FROM context GROUP BY sector
      UNION ALL SELECT 'binned', sector, (-15.0::DOUBLE + (min(bin) - 1) * (30.0::DOUBLE / 4093)) * any_value(scale) FROM upto WHERE c >= 0.5 - 1e-12 GROUP BY sector)""",
    "SELECT model_id, round(sqrt(avg((prediction - target) * (prediction - target))), 6) AS rmse, count(*) AS num_series FROM made JOIN targets USING (sector) GROUP BY model_id",
)
def rmse_chunked(spark, d):
    made = chunks.fold_forecasts(chunks.chunk_series(ordered(spark, d), 16), chunks.FOLDS)
    scored = score.score_series(made, score_targets(spark, d)).withColumn("dataset", F.lit("original"))
    return score.rmse(scored).select("model_id", F.round("rmse", 6).alias("rmse"), "num_series")
