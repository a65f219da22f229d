"""Language identification by hyperdimensional profiles.

Every letter (code point) has a random vector of +1 and -1 of its own. A letter trigram is the product
of its letters' vectors, the first rotated twice and the second once (binding
permuted vectors); a text is the sum of its trigrams (bundling); a language's
prototype is the sum of its texts. A text gets the language with the highest
cosine, after the part that all prototypes share is taken off both.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellwave.llm.arrow import steps

#: Prototypes are sums of unit vectors in steps of 1 / UNIT, whole numbers, so that the order of adding does not matter.
UNIT = 1 << 20


def letter_vector(point: int, dims: int, seed: int) -> np.ndarray:
    """The vector of a code point; 0 stands for whatever is no letter."""
    return np.random.default_rng([seed, point]).choice(np.array([-1, 1], np.int8), size=dims)


class Letters:
    """Vectors of code points, drawn when a task first meets them; a vector follows from its code point and the seed, so all tasks have the same.

    A byte a dimension: 70 MB for texts that hold every letter there is, some KB for most.
    """

    def __init__(self, dims: int, seed: int):
        self.dims, self.seed = dims, seed
        self.slot = np.fromiter((-1 if chr(i).isalpha() else 0 for i in range(0x110000)), np.int32, 0x110000)
        self.vectors = letter_vector(0, dims, seed)[None, :]

    def slots(self, points: np.ndarray) -> np.ndarray:
        """The rows of ``vectors`` that hold these code points; row 0 for all that are no letters."""
        found = self.slot[points]
        if (found < 0).any():
            fresh = np.unique(points[found < 0])
            self.slot[fresh] = len(self.vectors) + np.arange(len(fresh))
            self.vectors = np.concatenate([self.vectors, [letter_vector(int(p), self.dims, self.seed) for p in fresh]])
            found = self.slot[points]
        return found

    def bound(self, first: np.ndarray, second: np.ndarray, third: np.ndarray) -> np.ndarray:
        """The vectors of trigrams of rows: the first rotated twice, the second once, multiplied."""
        return np.roll(self.vectors[first], 2, axis=1) * np.roll(self.vectors[second], 1, axis=1) * self.vectors[third]


@cache
def letters(dims: int, seed: int) -> Letters:
    return Letters(dims, seed)


def text_vector(text: str, dims: int, seed: int) -> np.ndarray | None:
    """The bundled trigrams of a text, a unit vector; None if it has no letter."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    known = letters(dims, seed)
    codes = np.zeros(len(points) + 2, np.int64)
    codes[1:-1] = known.slots(points)
    middle = codes[1:-1] > 0
    if not middle.any():
        return None
    n = len(known.vectors)
    grams, counts = np.unique(((codes[:-2] * n + codes[1:-1]) * n + codes[2:])[middle], return_counts=True)
    pairs, third = np.divmod(grams, n)
    first, second = np.divmod(pairs, n)
    # whole numbers, so that the order of the rows, which follows the texts met before, does not matter
    total = np.zeros(dims, np.int64)
    for i in range(0, len(grams), 2048):
        part = slice(i, i + 2048)
        total += np.rint(counts[part].astype(np.float64) @ known.bound(first[part], second[part], third[part])).astype(np.int64)
    total = total.astype(np.float64)
    norm = np.sqrt(total @ total)
    return total / norm if norm else total


def fit(docs: DataFrame, text: str, lang: str, order, sample_rows: int, dims: int, seed: int, most_langs: int) -> tuple[list[str], np.ndarray]:
    """Prototypes (unit vectors) of the ``most_langs`` languages with most rows, from at most about ``sample_rows`` rows of each, the first by ``order``."""
    known = docs.filter(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(lang).alias("lang"), F.col(text).alias("text"), F.pmod(order, F.lit(1 << 30)).alias("place"))
    share = known.groupBy("lang").agg((F.lit(float(sample_rows << 30)) / F.count("*")).alias("upto"))
    share = share.orderBy("upto", "lang").limit(most_langs)
    # at most most_langs rows: less than the model itself
    sample = known.join(F.broadcast(share), "lang").filter(F.col("place") < F.col("upto")).select("lang", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in steps(batches):
            for name, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                v = text_vector(t, dims, seed)
                if v is not None:
                    sums[name] = sums.get(name, np.zeros(dims, np.int64)) + np.rint(v * UNIT).astype(np.int64)
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(list(sums)), pa.array([x.tolist() for x in sums.values()], pa.list_(pa.int64()))], names=["lang", "total"])

    parts = sample.mapInArrow(run, "lang string, total array<long>").select("lang", F.posexplode("total").alias("dim", "x"))
    found = parts.groupBy("lang", "dim").agg(F.sum("x").alias("x")).orderBy("lang", "dim").collect()
    names = sorted({r["lang"] for r in found})
    proto = np.array([r["x"] for r in found], np.float64).reshape(len(names), dims) if names else np.zeros((0, dims))
    proto /= np.maximum(1e-12, np.sqrt((proto**2).sum(1, keepdims=True)))
    return names, proto


def identify(docs: DataFrame, learn_from, id_col: str = "doc_id", text: str = "text", lang: str = "lang", sample_rows: int = 5_000, dims: int = 512, seed: int = 11, most_langs: int = 1_000) -> DataFrame:
    """Returns doc_id, lang_pred and score (0 to 1: the cosine, halved and shifted).

    Prototypes are fitted on at most about ``sample_rows`` rows of each
    language, of those that ``learn_from`` allows, picked by a hash of the id,
    so that a rare language is learned like any other; all rows are predicted,
    from their whole texts alone. Of more than ``most_langs`` values of ``lang``
    those with most rows (the first by name of equals) are learned. A null text, a
    text without letters, and any text where no language could be learned get
    ``und`` and score 0. Equal cosines go to the first language by name. The
    model sent to the tasks is ``dims`` numbers per language. Repeated rows are
    rows like others, and an empty table gives no rows.
    """
    picked = docs.select(F.col(id_col).alias("_key"), text, lang, learn_from.alias("_learn"))
    names, proto = fit(picked.filter("_learn"), text, lang, F.xxhash64(F.lit(seed), "_key"), sample_rows, dims, seed, most_langs)
    common = proto.mean(0) if len(names) > 1 else np.zeros(dims)
    axes = proto - common
    axes /= np.maximum(1e-12, np.sqrt((axes**2).sum(1, keepdims=True)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches):
            said, scores = [], []
            for t in batch.column(1).to_pylist():
                v = text_vector(t, dims, seed) if t is not None and names else None
                if v is None:
                    said.append("und")
                    scores.append(0.0)
                    continue
                v = v - common * (v @ common) / max(1e-12, common @ common)
                cosines = axes @ v / max(1e-12, np.sqrt(v @ v))
                best = int(np.argmax(cosines))
                said.append(names[best])
                scores.append(float(np.clip((1 + cosines[best]) / 2, 0.0, 1.0)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(said, pa.string()), pa.array(scores, pa.float64())], names=["doc_id", "lang_pred", "score"])

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, lang_pred string, score double")


def fold_of(id_col, n: int):
    return F.pmod(F.crc32(id_col.cast("string").cast("binary")), F.lit(n))


def op9_language_id(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    held_out = F.coalesce(fold_of(F.col("doc_id"), 5) == 0, F.lit(False))
    return identify(docs, ~held_out).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")
