"""Quality of documents: boosted trees over statistics of their texts.

The statistics of many texts are taken at once from arrays of code points:
shares of kinds of characters, lengths, repeats of words, word pairs and lines,
how sentences and lines end, function words, the spread of characters. Trees
are fitted on a bounded sample of labelled rows; every text is scored whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellwave.llm import boosting
from cellwave.llm.arrow import map_column, steps
from cellwave.llm.langid import fold_of
from cellwave.llm.shingles import BASE, INVERSE, U64, mix, powers

#: Kinds of characters: letters of either case and of none, digits, blanks, line ends, ends of sentences, commas and the like, quotes and brackets, all else.
LOWER, UPPER, LETTER, DIGIT, BLANK, LINE, STOP, COMMA, QUOTE, OTHER = range(10)

#: Frequent function words of English, French, German and Spanish.
FUNCTION_WORDS = (
    "a", "and", "are", "as", "at", "be", "by", "for", "from", "had", "have", "he", "in", "is", "it", "not", "of", "on", "that", "the", "this", "to", "was", "were", "which", "with",
    "au", "aux", "ce", "dans", "de", "des", "du", "elle", "et", "est", "il", "la", "le", "les", "par", "pas", "pour", "que", "qui", "sur", "un", "une",
    "auf", "das", "dem", "den", "der", "die", "ein", "eine", "es", "ist", "mit", "nicht", "sich", "sie", "und", "von", "werden", "zu",
    "al", "como", "con", "del", "el", "en", "las", "los", "no", "para", "por", "se", "su", "una", "y",
)

NAMES = (
    "log_characters", "log_words", "word_length", "word_length_spread", "lower", "upper", "letter", "digit", "blank", "line", "stop", "comma", "quote", "other",
    "no_letter_words", "upper_words", "odd_words", "function_words", "same_word_again", "distinct_words", "top_word", "distinct_pairs", "top_pair",
    "log_lines", "words_a_line", "distinct_lines", "stopped_lines", "words_a_sentence", "spread", "longest_word",
)


@cache
def kinds() -> np.ndarray:
    """The kind of each code point."""
    table = np.full(0x110000, OTHER, np.uint8)
    for i in range(0x110000):
        c = chr(i)
        if c.isalpha():
            table[i] = LOWER if c.islower() else UPPER if c.isupper() else LETTER
        elif c.isnumeric():
            table[i] = DIGIT
        elif c.isspace():
            table[i] = BLANK
    for kind, chars in ((LINE, "\n\r\v\f"), (STOP, ".!?…。"), (COMMA, ",;:"), (QUOTE, "'\"()-«»“”’–—")):
        table[[ord(c) for c in chars]] = kind
    return table


def points_of(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def span_names(points: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of runs of code points."""
    sums = np.zeros(len(points) + 1, U64)
    np.cumsum(mix(points) * powers(BASE, len(points)), out=sums[1:])
    return mix((sums[end] - sums[begin]) * powers(INVERSE, len(sums))[begin] + (end - begin).astype(U64))


@cache
def function_names() -> np.ndarray:
    return np.sort(np.concatenate([span_names(points_of(w), np.array([0]), np.array([len(w)])) for w in FUNCTION_WORDS]))


def repeats(owner: np.ndarray, names: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Number of distinct names of each owner, below ``n``, and the count of its most frequent one."""
    order = np.lexsort((names, owner))
    o, x = owner[order], names[order]
    new = np.ones(len(o), bool)
    new[1:] = (o[1:] != o[:-1]) | (x[1:] != x[:-1])
    first = np.flatnonzero(new)
    most = np.zeros(n, np.int64)
    np.maximum.at(most, o[first], np.diff(np.append(first, len(o))))
    return np.bincount(o[first], minlength=n), most


def statistics(texts: list[str]) -> np.ndarray:
    """One row of NAMES for each text; an empty one has zeros."""
    n = len(texts)
    points = points_of("".join(t + "\n" for t in texts))
    size = np.array([len(t) for t in texts], np.int64)
    kind = kinds()[points]
    text = np.repeat(np.arange(n), size + 1)
    per = lambda owner, weights=None: np.bincount(owner, weights, n).astype(np.float64)
    share = lambda a, b: a / np.maximum(b, 1)
    counts = np.bincount(text * 10 + kind, minlength=10 * n).reshape(n, 10).astype(np.float64)
    counts[:, LINE] -= 1  # the line end that parts the texts
    inside = np.zeros(len(points) + 2, bool)
    inside[1:-1] = (kind != BLANK) & (kind != LINE)
    begin, end = np.flatnonzero(inside[1:-1] & ~inside[:-2]), np.flatnonzero(inside[1:-1] & ~inside[2:]) + 1
    owner, length = text[begin], (end - begin).astype(np.float64)
    upto = {k: np.concatenate(([0], np.cumsum(kind == k))) for k in (LOWER, UPPER, LETTER, OTHER)}
    held = {k: v[end] - v[begin] for k, v in upto.items()}
    letters = held[LOWER] + held[UPPER] + held[LETTER]
    names = span_names(points, begin, end)
    words = per(owner)
    mean = share(per(owner, length), words)
    spread = np.sqrt(np.maximum(0, share(per(owner, length**2), words) - mean**2))
    longest = np.zeros(n)
    np.maximum.at(longest, owner, length)
    known = function_names()
    function = known[np.minimum(np.searchsorted(known, names), len(known) - 1)] == names
    pair = np.flatnonzero(owner[1:] == owner[:-1])
    pair_owner, pair_names = owner[pair], mix(names[pair] * U64(3) + names[pair + 1])
    again = per(pair_owner, (names[pair] == names[pair + 1]).astype(np.float64))
    distinct, top = repeats(owner, names, n)
    distinct_pairs, top_pair = repeats(pair_owner, pair_names, n)
    pairs = per(pair_owner)
    # lines by their words: begin with a word after a line end, or a text's first
    ends = np.cumsum(kind == LINE)[begin] if len(begin) else begin
    first = np.flatnonzero(np.append(True, ends[1:] != ends[:-1])) if len(begin) else begin
    last = np.append(first[1:], len(begin))[: len(first)] - 1
    line_owner = owner[first]
    lines = per(line_owner)
    distinct_lines, _ = repeats(line_owner, span_names(points, begin[first], end[last]), n)
    stopped = per(line_owner, (kind[end[last] - 1] == STOP).astype(np.float64)) if len(begin) else np.zeros(n)
    buckets = np.bincount(text * 64 + (points & 63).astype(np.int64), minlength=64 * n).reshape(n, 64).astype(np.float64)
    buckets[:, 10] -= 1
    p = share(buckets, size[:, None])
    entropy = -(p * np.log2(np.where(p > 0, p, 1))).sum(1)
    return np.stack([
        np.log1p(size), np.log1p(words), mean, spread, *share(counts, size[:, None]).T,
        share(per(owner, (letters == 0) * 1.0), words), share(per(owner, ((letters > 1) & (held[UPPER] == letters)) * 1.0), words), share(per(owner, (held[OTHER] > 0) * 1.0), words), share(per(owner, function * 1.0), words),
        share(again, pairs), share(distinct, words), share(top, words), share(distinct_pairs, pairs), share(top_pair, pairs),
        np.log1p(lines), share(words, lines), share(distinct_lines, lines), share(stopped, lines), words / (counts[:, STOP] + 1), entropy, longest,
    ], 1)


def learn(docs: DataFrame, labels: DataFrame, sample_rows: int = 10_000, seed: int = 13, **shape) -> boosting.Trees:
    """Trees fitted on labelled rows: about ``sample_rows`` ids of either class, the first by a hash of the id, and at most twice as many rows.

    ``docs`` has doc_id and text; ``labels`` doc_id and quality, 0 or 1. An id
    labelled both ways counts as 0; null labels and null ids are left out.
    Rows weigh what their class has in ids, so that the sample stands for all
    labels. Without labels of one of the classes, or without their documents,
    the model is a constant: the label there is, 0 if there is none. ``shape``
    goes to ``boosting.fit``.
    """
    known = labels.filter(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1)).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    totals = {r["quality"]: r["n"] for r in known.groupBy("quality").agg(F.count("*").alias("n")).collect()}
    constant = lambda label: boosting.Trees(np.zeros((0, 0), np.int64), np.zeros((0, 0)), np.zeros((0, 1)), 30.0 if label else -30.0)
    if len(totals) < 2:
        return constant(1 in totals)
    order = F.xxhash64(F.lit(seed), "doc_id")
    # ids of the sample: 2 * sample_rows at most
    picked = [known.filter(F.col("quality") == y).orderBy(order, "doc_id").limit(sample_rows) for y in (0, 1)]
    sample = docs.join(F.broadcast(picked[0].unionByName(picked[1])), "doc_id").select("doc_id", "quality", F.coalesce("text", F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches):
            found = statistics(batch.column(2).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1).cast(pa.int32()), pa.array(found.tolist(), pa.list_(pa.float64()))], names=["doc_id", "quality", "x"])

    made = sample.mapInArrow(run, "doc_id long, quality int, x array<double>")
    rows = made.orderBy(F.xxhash64(F.lit(seed), "doc_id", "x"), "doc_id", "x").limit(2 * sample_rows).select("quality", "x").toArrow()
    y = rows.column("quality").to_numpy().astype(np.float64)
    if not len(y) or y.min() == y.max():
        return constant(len(y) and y[0])
    x = np.array(rows.column("x").combine_chunks().flatten()).reshape(len(y), len(NAMES))
    seen = {k: min(sample_rows, totals[k]) for k in (0, 1)}
    weights = np.where(y == 1, totals[1] / seen[1], totals[0] / seen[0])
    return boosting.fit(x, y, weights, **shape)


def score(docs: DataFrame, model: boosting.Trees, keep: list[str], text: str = "text") -> DataFrame:
    """The columns ``keep`` and score (0 to 1, higher: quality 1 likelier) of every row; a null text counts as empty. ``keep`` must not hold score.

    Repeated rows get the same score, an empty table gives no rows, and other
    columns are not read. The model sent to the tasks is some ten numbers for
    each node of its trees.
    """

    def scored(texts: pa.Array) -> list:
        return [pa.array(model.score(statistics(texts.to_pylist())))]

    return map_column(docs, keep, F.coalesce(F.col(text), F.lit("")), [("score", "double")], scored)


def held_out(id_col):
    return F.coalesce(fold_of(id_col, 3) == 1, F.lit(False))


def op13_quality_trees(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality").filter(~held_out(F.col("doc_id")))
    scored = score(docs, learn(docs.select("doc_id", "text"), labels), ["doc_id"])
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
