"""Errors of forecasts, and tables that rank forecasters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cellwave.operators.forecast import Forecaster, batch_forecasts, point_from_samples


def score_series(predictions: DataFrame, targets: DataFrame, sector: str = "sector") -> DataFrame:
    """Predictions with their targets (sector, site, target) and squared_error."""
    error = F.col("prediction") - F.col("target")
    return predictions.join(targets, sector).withColumn("squared_error", error * error)


def rmse(scored: DataFrame, keys: tuple[str, ...] = ("dataset", "model_id")) -> DataFrame:
    """keys, rmse, num_series."""
    return scored.groupBy(*keys).agg(F.sqrt(F.avg("squared_error")).alias("rmse"), F.count("*").alias("num_series"))


def evaluate_models(rows: DataFrame, size: int | None, models: tuple[str, ...] = ("last", "mean", "median"), sector: str = "sector", value: str = "trafic_mbps", order: tuple[str, ...] = ("first_seq", "row_seq")) -> DataFrame:
    """model_id, sector, site, target, prediction, squared_error: every built-in model on every series of two points and more.

    The last point of a series is the target, the ``size`` points before it are
    the context, or all points without a ``size``. One exchange by sector serves
    the cut, all models and the target; of a long series only ``size`` + 1 points
    go through it per task.
    """
    back = F.row_number().over(W.partitionBy(sector).orderBy(*[F.col(c).desc() for c in order]))
    recent = rows.select(sector, "site", value, back.alias("_back"), *order)
    recent = recent if size is None else recent.filter(F.col("_back") <= size + 1)
    seen = F.when(F.col("_back") > 1, F.col(value))
    made = {"last": F.max(F.when(F.col("_back") == 2, F.col(value))), "mean": F.avg(seen), "median": F.median(seen)}
    last = F.col("_back") == 1
    wide = recent.groupBy(sector).agg(
        F.max(F.when(last, F.col("site"))).alias("site"), F.max(F.when(last, F.col(value))).alias("target"), F.count(seen).alias("_n"), *[made[m].cast("double").alias(f"_{m}") for m in models]
    )
    each = F.explode(F.array(*[F.struct(F.lit(m).alias("model_id"), F.col(f"_{m}").alias("prediction")) for m in models])).alias("m")
    out = wide.filter(F.col("_n") > 0).select(sector, "site", "target", each).select("m.model_id", sector, "site", "target", "m.prediction")
    return out.withColumn("squared_error", (F.col("prediction") - F.col("target")) * (F.col("prediction") - F.col("target")))


def evaluate_forecasters(examples: DataFrame, forecasters: dict[str, str | Callable[[], Forecaster]], samples: int = 32, seed: int = 0, max_context: int | None = None) -> DataFrame:
    """model_id, sector, site, target, prediction, squared_error: forecasters of one's own, by name, on every example; a mean is taken over the samples they give."""
    points = point_from_samples(batch_forecasts(examples, forecasters, samples, seed, max_context))
    return score_series(points, examples.select("sector", "site", "target")).select("model_id", "sector", "site", "target", "prediction", "squared_error")


def summary_table(scored: DataFrame, num_samples: int = 32, keys: tuple[str, ...] = ("dataset", "model_id")) -> DataFrame:
    """keys, rmse, num_series, num_samples."""
    return rmse(scored, keys).withColumn("num_samples", F.lit(num_samples))


def attach_parameters(summary: DataFrame, lookup: DataFrame) -> DataFrame:
    """parameters (and what else ``lookup`` has) by model_id; null for unknown models. The lookup is a list of models, which Spark broadcasts."""
    return summary.join(lookup, "model_id", "left")


def order_by_list(summary: DataFrame, order: list[str]) -> DataFrame:
    """model_id, rmse, parameters in the order of the list; models that are not in it come last, by name."""
    place = F.array_position(F.array(*[F.lit(m) for m in order]), F.col("model_id"))
    return summary.orderBy(F.when(place > 0, place).asc_nulls_last(), "model_id").select("model_id", "rmse", "parameters")


def best_model(summary: DataFrame) -> DataFrame:
    """dataset, model_id, rmse: the lowest RMSE of each dataset, ties by name."""
    best = F.min(F.struct("rmse", "model_id")).alias("b")
    return summary.groupBy("dataset").agg(best).select("dataset", "b.model_id", "b.rmse")


def parameter_count(label: Column) -> Column:
    """9M as 9e6; also K and B; null for other texts."""
    number = F.regexp_extract(label, r"^(\d+(?:\.\d+)?)([KMB]?)$", 1)
    unit = F.regexp_extract(label, r"^(\d+(?:\.\d+)?)([KMB]?)$", 2)
    factor = F.when(unit == "K", 1e3).when(unit == "M", 1e6).when(unit == "B", 1e9).otherwise(1.0)
    return F.when(number != "", number).try_cast("double") * factor


def size_vs_error(summary: DataFrame) -> DataFrame:
    """Summary with n_parameters, previous_rmse (of the next smaller model of the dataset) and rises: whether the larger model does worse. Unknown sizes come first."""
    sized = summary.withColumn("n_parameters", parameter_count(F.col("parameters")))
    before = F.lag("rmse").over(W.partitionBy("dataset").orderBy(F.col("n_parameters").asc_nulls_first(), "model_id"))
    return sized.withColumn("previous_rmse", before).withColumn("rises", F.col("rmse") > F.col("previous_rmse"))


def zero_target_share(scored: DataFrame, keys: tuple[str, ...] = ("dataset", "model_id")) -> DataFrame:
    """keys, zero_share (of targets that are 0), rmse_zero and rmse_other: the RMSE over either kind, null where there is none."""
    zero = F.col("target") == 0
    return scored.groupBy(*keys).agg(
        F.avg(zero.cast("double")).alias("zero_share"),
        F.sqrt(F.avg(F.when(zero, F.col("squared_error")))).alias("rmse_zero"),
        F.sqrt(F.avg(F.when(~zero, F.col("squared_error")))).alias("rmse_other"),
    )


def rmse_ratio(summary: DataFrame, a: str, b: str) -> DataFrame:
    """One row: the mean RMSE of datasets a and b, and their ratio (null where that of b is 0)."""
    means = summary.agg(F.avg(F.when(F.col("dataset") == a, F.col("rmse"))).alias("mean_a"), F.avg(F.when(F.col("dataset") == b, F.col("rmse"))).alias("mean_b"))
    return means.withColumn("ratio", F.col("mean_a") / F.nullif("mean_b", F.lit(0.0)))
