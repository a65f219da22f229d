"""A bounded map of ids, which spares a join the shuffle of rows that surely have no partner."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A map has at most 2 ** MAP_BITS bits (8 MB), and 2 ** ROW_BITS of them in a row.
MAP_BITS, ROW_BITS = 26, 15


def part_by_map(rows: DataFrame, ids: DataFrame, id_col: str = "doc_id", most_bits: int = MAP_BITS) -> tuple[DataFrame, DataFrame]:
    """The ``rows`` whose id may be among ``ids``, and those whose id surely isn't.

    The map has about 32 bits for each of the ids, 2 ** ``most_bits`` at most;
    beyond that more rows pass by chance. So it only spares work, and rows that
    may have a partner must be joined all the same. ``ids`` is read twice.
    """
    bits = min(most_bits, max(ROW_BITS, (32 * ids.count()).bit_length()))
    place = F.shiftrightunsigned(F.xxhash64(id_col), 64 - bits)
    made = ids.select(place.alias("at")).groupBy(F.shiftright("at", ROW_BITS).alias("part")).agg(F.bitmap_construct_agg(F.col("at").bitwiseAND((1 << ROW_BITS) - 1)).alias("held")).toArrow()
    held = np.zeros((1 << (bits - ROW_BITS), 1 << (ROW_BITS - 3)), np.uint8)
    for part, row in zip(made.column("part").to_pylist(), made.column("held").to_pylist()):
        held[part] = np.frombuffer(row, np.uint8)
    shared = ids.sparkSession.sparkContext.broadcast(held.reshape(-1))

    def passed(wanted: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                at = batch.column(batch.num_columns - 1).to_numpy()
                found = (shared.value[at >> 3] >> (at & 7).astype(np.uint8)) & 1 > 0
                yield batch.select(range(batch.num_columns - 1)).filter(pa.array(found == wanted))

        return run

    placed = rows.select("*", place.alias("_at" + "_" * max(map(len, rows.columns))))  # no column's name
    return placed.mapInArrow(passed(True), rows.schema), placed.mapInArrow(passed(False), rows.schema)
