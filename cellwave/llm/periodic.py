"""Runs of words that repeat with a period, found by suffix trees.

A run is a stretch of consecutive words with smallest period q that no
neighbouring word extends, of ``exponent`` periods at least. Trees are built of
the stretches of a document in which a run can be: each three words of a run of
four periods and more occur three times in it, a period apart, so stretches
whose word triples do not are left out beforehand (``stretches``), which loses
no run. In what is left Ukkonen's trees of the stretches and of their reversal,
with lowest common ancestors over an Euler tour, give common extensions in
constant time; candidates are the longest Lyndon words under both orders.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellwave.llm.arrow import map_column
from cellwave.llm.suffixtree import runs_of

#: Words, about, whose trees are built at a time; a longer stretch has trees of its own.
TREE_WORDS = 1 << 14


def stretches(ids: np.ndarray, upto: np.ndarray, exponent: int, least: int) -> tuple[np.ndarray, np.ndarray]:
    """First word and end of each stretch that may hold runs; text k has the words upto[k]:upto[k + 1], numbered below 2 ** 21.

    A gram of a run occurs ``often`` times in it, and next to each a period
    away, which is one part in ``exponent`` of the stretch at most. Grams of
    which that is not so are no part of a run, and stretches without them are
    looked at again, until nothing changes.
    """
    gram, often = (3, 3) if exponent >= 4 and least >= 6 else (1, exponent)
    text = np.repeat(np.arange(len(upto) - 1), np.diff(upto))
    at = np.arange(max(0, len(ids) - gram + 1))
    at = at[text[at] == text[at + gram - 1]]
    names = ids[at].astype(np.int64)
    for k in range(1, gram):
        names = (names << 21) | ids[at + k]
    while True:
        new = np.ones(len(at), bool)
        new[1:] = (np.diff(at) != 1) | (text[at[1:]] != text[at[:-1]])
        head = np.flatnonzero(new)
        grams = np.diff(np.append(head, len(at)))
        stretch = np.cumsum(new) - 1
        order = np.lexsort((names, stretch))
        same = np.zeros(len(at) + 1, bool)
        same[1:-1] = (names[order[1:]] == names[order[:-1]]) & (stretch[order[1:]] == stretch[order[:-1]])
        far = np.zeros(len(at) + 1, np.int64)
        far[1:-1] = np.diff(at[order])
        far[~same] = len(ids)
        starts = np.flatnonzero(~same[:-1])
        counts = np.repeat(np.diff(np.append(starts, len(at))), np.diff(np.append(starts, len(at))))
        most = (grams[stretch[order]] + gram - 1) // exponent
        keep = np.zeros(len(at), bool)
        keep[order] = (counts >= often) & (np.minimum(far[:-1], far[1:]) <= most) & (grams[stretch[order]] + gram - 1 >= least)
        if keep.all():
            return at[head], at[head] + grams + gram - 1
        at, names = at[keep], names[keep]


def find(ids: np.ndarray, upto: np.ndarray, exponent: int = 4, least: int = 6) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First word (of all texts' words), length and period of every run, by first word and period."""
    first, end = stretches(ids, upto, exponent, least)
    out = [np.zeros((0, 3), np.int64)]
    k = 0
    while k < len(first):
        stop = k + 1
        while stop < len(first) and end[k : stop + 1].sum() - first[k : stop + 1].sum() <= TREE_WORDS:
            stop += 1
        marks, sizes = stop - k, end[k:stop] - first[k:stop]
        place = np.concatenate([np.append(np.arange(a, b), -1) for a, b in zip(first[k:stop], end[k:stop])])
        _, numbers = np.unique(np.append(ids[place[place >= 0]], 0), return_inverse=True)
        s = np.zeros(len(place), np.int64)
        s[place >= 0] = numbers[:-1] + marks
        s[np.cumsum(sizes + 1) - 1] = np.arange(marks)
        start, length, period = runs_of(s.tolist(), marks, least, exponent)
        out.append(np.stack((place[start], length, period), 1))
        k = stop
    found = np.concatenate(out)
    found = found[np.lexsort((found[:, 2], found[:, 0]))]
    return found[:, 0], found[:, 1], found[:, 2]


def numbered(texts: list[bytes]) -> tuple[list[list[bytes]], np.ndarray, np.ndarray]:
    """The words of each text (runs of bytes but blank, tab, line feed to return), a number for each word, and where texts begin."""
    words = [t.split() for t in texts]
    names: dict[bytes, int] = {}
    ids = np.fromiter((names.setdefault(w, len(names)) for ws in words for w in ws), np.int64)
    return words, ids, np.concatenate(([0], np.cumsum([len(ws) for ws in words], dtype=np.int64)))


def periodic_runs(docs: DataFrame, keep: list[str], text: Column | str = "text", exponent: int = 4, least: int = 6) -> DataFrame:
    """The columns ``keep`` and n_words, runs (array of start, length, period; by start, then period) and collapsed of every row.

    ``collapsed`` are the words, joined by one blank, without those that a run
    holds after its first period. Words are numbered from 0. A null or empty
    text has no words and no runs; repeated rows are rows like others, an empty
    table gives no rows. Texts are taken whole, and a text's words and, of its
    stretches that may hold runs, the trees are in memory, some hundred bytes a
    word. ``keep`` must not hold the names of the new columns.
    """
    if exponent < 2:
        raise ValueError("a run has two periods at least")
    kind = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])

    def make(texts: pa.Array) -> list:
        words, ids, upto = numbered(texts.cast(pa.binary()).to_pylist())
        start, length, period = find(ids, upto, exponent, least)
        owner = np.searchsorted(upto, start, side="right") - 1
        dropped = np.zeros(len(ids) + 1, np.int64)
        np.add.at(dropped, start + period, 1)
        np.add.at(dropped, start + length, -1)
        kept = np.cumsum(dropped)[:-1] == 0
        ends = np.searchsorted(owner, np.arange(len(words) + 1))
        collapsed = [
            b" ".join(ws) if a == b else b" ".join([w for w, stays in zip(ws, kept[upto[i] : upto[i + 1]].tolist()) if stays])
            for i, (ws, a, b) in enumerate(zip(words, ends[:-1].tolist(), ends[1:].tolist()))
        ]
        found = pa.StructArray.from_arrays([pa.array(start - upto[owner]), pa.array(length), pa.array(period)], fields=list(kind))
        return [pa.array(np.diff(upto)), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), found), pa.array(collapsed, pa.binary()).cast(pa.string())]

    column = F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))
    return map_column(docs, keep, column, [("n_words", "long"), ("runs", "array<struct<start: long, length: long, period: long>>"), ("collapsed", "string")], make)


def planted(docs: DataFrame) -> DataFrame:
    """doc_id and text; of every tenth document, by a hash h of its id, the words from some place on repeat one stretch of words.

    With n words and g = h // 10, word i >= a becomes word a + (i - a) % p,
    where a = g % n and p = 1 + (n - a) // (3 + g % 8). Texts without words and
    those of null ids stay as they are.
    """
    words = F.array_remove(F.split(F.coalesce("text", F.lit("")), "[\\x20\\x09-\\x0D]+"), "")
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    some = F.coalesce(h % 10 == 0, F.lit(False))
    rows = docs.select("doc_id", "text", F.floor(h / 10).alias("_g"), F.when(some, words).alias("_words"))
    n = F.size("_words")
    rows = rows.withColumn("_a", F.when(n > 0, F.col("_g") % n).cast("int")).withColumn("_p", (1 + F.floor((n - F.col("_a")) / (3 + F.col("_g") % 8))).cast("int"))
    left = n - F.col("_a")
    root = F.slice("_words", F.col("_a") + 1, F.col("_p"))
    repeated = F.slice(F.flatten(F.array_repeat(root, F.ceil(left / F.col("_p")).cast("int"))), F.lit(1), left)
    text = F.concat_ws(" ", F.concat(F.slice("_words", F.lit(1), F.col("_a")), repeated))
    return rows.select("doc_id", F.when(F.col("_a").isNotNull(), text).otherwise(F.col("text")).alias("text"))


def op11_periodic_runs(spark, sf_dir: str) -> DataFrame:
    found = periodic_runs(planted(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")), ["doc_id"])
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", *[r[c].cast("string") for c in ("start", "length", "period")]), F.lit("\n"))), "")
    rows = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("best"), F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"), "n_words")
    length, period = F.col("best.length"), -F.col("best.period")
    return rows.select("doc_id", "n_runs", (-F.col("best.start")).alias("start"), length.alias("length"), period.alias("period"), F.expr("(1000 * best.length) div (-best.period)").alias("exponent_milli"), "runs_sha256", "collapsed_sha256", "n_words")
