"""Forecasters over many series and the point forecasts of their outputs.

Forecasts are long: model_id, sector, k (sample or level number), level, step,
value.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

KEYS = ("model_id", "sector")


def last_step(forecasts: DataFrame, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """The rows of each forecast's last step."""
    top = forecasts.groupBy(*keys).agg(F.max("step").alias("step"))
    return forecasts.join(top, [*keys, "step"], "left_semi")


def point_from_samples(forecasts: DataFrame, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """keys, prediction: the mean over the samples of the last step."""
    best = forecasts.groupBy(*keys, "step").agg(F.avg("value").alias("m"))
    return best.groupBy(*keys).agg(F.max_by("m", "step").alias("prediction"))


def point_from_quantiles(forecasts: DataFrame, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """keys, prediction: the level nearest to 0.5 (the first of equals) at the last step; without levels the middle one, n // 2."""
    rows = forecasts.withColumn("_n", F.count("*").over(W.partitionBy(*keys, "step")))
    far = F.when(F.col("level").isNotNull(), F.abs(F.col("level") - 0.5)).otherwise(F.abs(F.col("k") - F.floor(F.col("_n") / 2)).cast("double"))
    return rows.groupBy(*keys).agg(F.min_by("value", F.struct(-F.col("step"), far, "k", "level")).alias("prediction"))


def point_from_outputs(outputs: DataFrame, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """keys, prediction: one number from whatever array a model returns for a series.

    ``outputs`` has one row an element: its places i0, i1, i2 (from 0; null for
    dimensions that the array has not) and its value. No dimension: the value;
    one: the last step's; two (samples or levels, steps): the mean over the
    first at the last step; three (series, samples, steps): the same of series
    0. The shape is that of the element with most dimensions, so one of a
    series' outputs may not be ragged in depth: rows of lower depth are left out.
    """
    depth = F.when(F.col("i2").isNotNull(), 3).when(F.col("i1").isNotNull(), 2).when(F.col("i0").isNotNull(), 1).otherwise(0)
    step = F.when(depth == 3, F.col("i2")).when(depth == 2, F.col("i1")).when(depth == 1, F.col("i0")).otherwise(0)
    kept = outputs.filter((depth < 3) | (F.col("i0") == 0)).select(*keys, depth.alias("_depth"), step.cast("long").alias("_step"), "value")
    # added up by step before anything is shuffled; then the deepest array's last step
    means = kept.groupBy(*keys, "_depth", "_step").agg(F.avg("value").alias("_mean"))
    return means.groupBy(*keys).agg(F.max_by("_mean", F.struct("_depth", "_step")).alias("prediction"))


#: A forecaster takes contexts (a list of arrays) and gives an array of predictions (or of samples, one row a series).
Forecaster = Callable[[list[np.ndarray], int, int], np.ndarray]


def last_value(contexts: list[np.ndarray], samples: int, seed: int) -> np.ndarray:
    return np.array([c[-1] for c in contexts])


def mean_value(contexts: list[np.ndarray], samples: int, seed: int) -> np.ndarray:
    return np.array([c.mean() for c in contexts])


def median_value(contexts: list[np.ndarray], samples: int, seed: int) -> np.ndarray:
    return np.array([np.median(c) for c in contexts])


def binned_median(contexts: list[np.ndarray], samples: int, seed: int, bins: int = 4094, low: float = -15.0, high: float = 15.0) -> np.ndarray:
    """The median bin of the scaled context, as a value again."""
    step, out = (high - low) / (bins - 1), []
    for c in contexts:
        scale = np.abs(c).mean() or 1.0
        counts = Counter(np.clip(np.floor((c / scale - low) / step + 0.5), 0, bins - 1).astype(int).tolist())
        upto, found = 0, 0
        for b in sorted(counts):
            upto, found = upto + counts[b], b
            if upto / len(c) >= 0.5 - 1e-12:
                break
        out.append((low + found * step) * scale)
    return np.array(out)


FORECASTERS: dict[str, Forecaster] = {"last": last_value, "mean": mean_value, "median": median_value, "binned": binned_median}


def batch_forecasts(examples: DataFrame, forecasters: dict[str, str | Callable[[], Forecaster]], samples: int = 32, seed: int = 0, max_context: int | None = None) -> DataFrame:
    """model_id, sector, k, level, step, value: a one-step forecast of every row of ``examples`` (sector, context) by every model, in one pass.

    A forecaster is a name in FORECASTERS or a function without arguments that
    loads one; it is called once a task. Batches of contexts go to it.
    """
    picked = examples.select("sector", "context")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        models = {name: FORECASTERS[f] if isinstance(f, str) else f() for name, f in forecasters.items()}
        for batch in batches:
            if not len(batch):
                continue
            contexts = [np.asarray(c, float)[-max_context:] if max_context else np.asarray(c, float) for c in batch["context"]]
            for name, model in models.items():
                made = np.asarray(model(contexts, samples, seed), float)
                made = made[:, None] if made.ndim == 1 else made
                n, width = made.shape
                yield pd.DataFrame({"model_id": name, "sector": np.repeat(batch["sector"].to_numpy(), width), "k": np.tile(np.arange(width, dtype=np.int32), n), "level": None, "step": np.int32(1), "value": made.ravel()})

    return picked.mapInPandas(run, f"model_id string, sector {picked.schema['sector'].dataType.simpleString()}, k int, level double, step int, value double")


def batch_forecast(examples: DataFrame, forecaster: str | Callable[[], Forecaster], model_id: str, samples: int = 32, seed: int = 0, max_context: int | None = None) -> DataFrame:
    """``batch_forecasts`` of one model."""
    return batch_forecasts(examples, {model_id: forecaster}, samples, seed, max_context)


def forecast_native(context: DataFrame, how: str, sector: str = "sector", value: str = "trafic_mbps", order: tuple[str, ...] = ("first_seq", "row_seq")) -> DataFrame:
    """sector, prediction: the built-in ``last``, ``mean`` or ``median`` forecaster as an aggregation of the context's points."""
    made = {"last": F.max_by(value, F.struct(*order)), "mean": F.avg(value), "median": F.median(value)}[how]
    return context.groupBy(sector).agg(made.alias("prediction"))
