"""Small helpers for functions that map Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Text bytes that one step of a mapping handles at a time, so that memory stays bounded for any batch.
STEP_BYTES = 1 << 20


def small_batches(spark: SparkSession, most: int = 8 << 20) -> None:
    """Arrow batches of at most about ``most`` bytes from now on, in a session that has not set them itself."""
    key, default = "spark.sql.execution.arrow.maxBytesPerBatch", "67108864b"
    if spark.conf.get(key) == default:
        spark.conf.set(key, str(most))


def utf8(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets (one more than texts) and bytes of a string array; null texts are empty."""
    if texts.null_count:
        texts = pc.fill_null(texts, "")
    wide = texts.cast(pa.large_string())
    offsets = np.frombuffer(wide.buffers()[1], dtype=np.int64)[wide.offset : wide.offset + len(wide) + 1]
    data = wide.buffers()[2]
    whole = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return offsets - offsets[0], whole[offsets[0] : offsets[-1]]


def steps(batches: Iterator[pa.RecordBatch], text: str = "text", most: int = STEP_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches cut into runs of rows of about ``most`` bytes of text, one row at least."""
    for batch in batches:
        if not batch.num_rows:
            continue
        lengths = pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(text))), 0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(lengths.astype(np.int64))
        start = 0
        while start < batch.num_rows:
            base = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, base + most, side="right")))
            yield batch.slice(start, stop - start)
            start = stop


def runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """The rows of each key, from a partition whose rows of a key follow each other. One key's rows are held at a time."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(batch.schema.get_field_index(k)) for k in keys]
        change = np.zeros(batch.num_rows, bool)
        for c in columns:
            change[1:] |= pc.not_equal(c.slice(1), c.slice(0, batch.num_rows - 1)).to_numpy(zero_copy_only=False)
        starts = [0, *np.flatnonzero(change).tolist(), batch.num_rows]
        for a, b in zip(starts[:-1], starts[1:]):
            key = tuple(c[a].as_py() for c in columns)
            if held and key != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
            last = key
    if held:
        yield pa.Table.from_batches(held)


def map_column(df: DataFrame, keep: list[str], column: Column, fields: list[tuple[str, str]], make: Callable[[pa.Array], list], most: int = STEP_BYTES) -> DataFrame:
    """The columns ``keep``, whatever their names, and ``fields`` (name, type), which ``make`` makes from each step of ``column``.

    ``column`` is text or binary. ``keep`` must not hold the names of the fields.
    """
    n, kept = len(keep), [f"_{i}" for i in range(len(keep))]
    rows = df.select(*[F.col(f"`{c}`").alias(k) for c, k in zip(keep, kept)], column.alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches, most=most):
            yield pa.RecordBatch.from_arrays([*batch.columns[:n], *make(batch.column(n))], names=[*kept, *[name for name, _ in fields]])

    schema = ", ".join([f"`{k}` {rows.schema[k].dataType.simpleString()}" for k in kept] + [f"{name} {kind}" for name, kind in fields])
    return rows.mapInArrow(run, schema).select(*[F.col(k).alias(c) for c, k in zip(keep, kept)], *[name for name, _ in fields])
