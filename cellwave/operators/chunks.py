"""Series as chunks of bounded size, and forecasters that fold over them.

A fold makes a state of a chunk, merges the states of neighbouring chunks, and
makes a forecast of the last state. So a series of any length is never a row,
and its chunks are folded by as many tasks as hold them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellwave.operators.rank import ranked


def chunk_series(df: DataFrame, size: int = 4096, keep_last: bool = False, sector: str = "sector", value: str = "trafic_mbps", order: tuple[str, ...] = ("first_seq", "row_seq")) -> DataFrame:
    """sector, chunk (from 0), scale and values (``size`` of them at most) of every series, without its last point unless ``keep_last``.

    scale is the mean of the series' absolute values, 1 where that is 0. Null
    sectors are left out.
    """
    rows = ranked(df.filter(F.col(sector).isNotNull()).select(sector, *order, value), sector, [F.col(c) for c in order], "_rank", "_size")
    if not keep_last:
        rows = rows.filter(F.col("_rank") < F.col("_size"))
    place = F.floor((F.col("_rank") - 1) / size)
    made = rows.groupBy(F.col(sector).alias("sector"), place.alias("chunk")).agg(F.sort_array(F.collect_list(F.struct(F.col("_rank").alias("i"), F.col(value).cast("double").alias("v")))).alias("p"), F.sum(F.abs(value)).alias("a"), F.count(value).alias("n"))
    sums = made.groupBy("sector").agg((F.sum("a") / F.sum("n")).alias("scale"))
    return made.join(sums, "sector").select("sector", "chunk", F.when(F.col("scale") > 0, F.col("scale")).otherwise(1.0).alias("scale"), F.transform("p", lambda x: x["v"]).alias("values"))


@dataclass(frozen=True)
class Fold:
    """A forecaster by parts: ``start`` (values, scale) and ``merge`` (earlier, later) give arrays of numbers, ``finish`` (state, scale) the forecast."""

    start: Callable[[np.ndarray, float], np.ndarray]
    merge: Callable[[np.ndarray, np.ndarray], np.ndarray]
    finish: Callable[[np.ndarray, float], float]


def binned_fold(bins: int = 4094, low: float = -15.0, high: float = 15.0) -> Fold:
    """The median bin of the scaled values; a state is pairs of bin and count, as many as there are bins at most."""
    step = (high - low) / (bins - 1)

    def count(at: np.ndarray, n: np.ndarray) -> np.ndarray:
        found, group = np.unique(at, return_inverse=True)
        return np.stack((found, np.bincount(group, n)), 1).ravel()

    def start(values: np.ndarray, scale: float) -> np.ndarray:
        at = np.clip(np.floor((values / scale - low) / step + 0.5), 0, bins - 1)
        return count(at, np.ones(len(at)))

    def merge(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        both = np.concatenate((a, b)).reshape(-1, 2)
        return count(both[:, 0], both[:, 1])

    def finish(state: np.ndarray, scale: float) -> float:
        at, n = state.reshape(-1, 2).T
        upto = np.cumsum(n) / n.sum()
        return float((low + at[np.argmax(upto >= 0.5 - 1e-12)] * step) * scale)

    return Fold(start, merge, finish)


FOLDS: dict[str, Fold] = {
    "last": Fold(lambda v, s: v[-1:], lambda a, b: b, lambda x, s: float(x[0])),
    "mean": Fold(lambda v, s: np.array([v.sum(), len(v)]), lambda a, b: a + b, lambda x, s: float(x[0] / x[1])),
    "binned": binned_fold(),
}


def fold_forecasts(chunks: DataFrame, folds: dict[str, Fold]) -> DataFrame:
    """model_id, sector, prediction of every series of ``chunk_series`` by every fold.

    Chunks are dealt by ranges of sector and chunk, so that a long series spans
    many tasks; each folds what it has of a sector into one state, and these,
    as many for a sector as there are tasks at most, are folded in their order.
    """
    kind = chunks.schema["sector"].dataType.simpleString()

    def folded(states: Iterator[tuple]) -> Iterator[tuple]:
        """(sector, model, chunk, scale, state) of neighbours with one sector and model as one."""
        held: dict[str, tuple] = {}
        for row in states:
            sector, model = row[0], row[1]
            if held and next(iter(held.values()))[0] != sector:
                yield from held.values()
                held = {}
            before = held.get(model)
            held[model] = row if before is None else (*before[:4], folds[model].merge(before[4], row[4]))
        yield from held.values()

    def table(rows: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame({"sector": [r[0] for r in rows], "model_id": [r[1] for r in rows], "chunk": [r[2] for r in rows], "scale": [r[3] for r in rows], "state": [r[4] for r in rows]})

    def some(rows: Iterator[tuple]) -> Iterator[pd.DataFrame]:
        out: list[tuple] = []
        for row in folded(rows):
            out.append(row)
            if len(out) >= 256:
                yield table(out)
                out = []
        if out:
            yield table(out)

    def start(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = ((s, m, c, x, f.start(np.asarray(v, float), x)) for b in batches for s, c, x, v in zip(b["sector"], b["chunk"], b["scale"], b["values"]) for m, f in folds.items())
        yield from some(rows)

    def end(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = ((s, m, c, x, np.asarray(v, float)) for b in batches for s, m, c, x, v in zip(b["sector"], b["model_id"], b["chunk"], b["scale"], b["state"]))
        for made in some(rows):
            yield pd.DataFrame({"model_id": made["model_id"], "sector": made["sector"], "prediction": [folds[m].finish(v, x) for m, v, x in zip(made["model_id"], made["state"], made["scale"])]})

    dealt = chunks.repartitionByRange("sector", "chunk").sortWithinPartitions("sector", "chunk")
    states = dealt.mapInPandas(start, f"sector {kind}, model_id string, chunk long, scale double, state array<double>")
    return states.repartition("sector").sortWithinPartitions("sector", "chunk").mapInPandas(end, f"model_id string, sector {kind}, prediction double")
