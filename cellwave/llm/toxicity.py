"""Toxicity by a classifier whose score must not turn on identity terms.

A logistic model on the words of a text and the beginnings of its words. Next
to the loss on the labels it pays for every sentence of a labelled text whose
score changes when the identity terms in it are swapped for their counterparts
(counterfactual regularisation), so that a neutral mention of a group is no
reason for a high score. Labels are learned from a bounded sample; every text
is scored whole.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellwave.llm.arrow import map_column, steps
from cellwave.llm.langid import fold_of
from cellwave.llm.store import cut

WORD = re.compile(r"[^\W\d_]+")

#: Identity terms and their counterparts, in English, French, German and Spanish; a swap goes both ways.
IDENTITY_PAIRS = (
    ("women", "men"), ("woman", "man"), ("girls", "boys"), ("female", "male"), ("she", "he"), ("gay", "straight"), ("lesbian", "heterosexual"), ("transgender", "cisgender"),
    ("muslim", "christian"), ("muslims", "christians"), ("jewish", "catholic"), ("jews", "catholics"), ("black", "white"), ("african", "european"), ("asian", "american"),
    ("mexican", "canadian"), ("immigrant", "native"), ("immigrants", "natives"), ("disabled", "able"), ("old", "young"),
    ("femmes", "hommes"), ("femme", "homme"), ("filles", "garçons"), ("elle", "il"), ("elles", "ils"), ("musulman", "chrétien"), ("musulmans", "chrétiens"), ("juif", "catholique"), ("juifs", "catholiques"),
    ("noir", "blanc"), ("noirs", "blancs"), ("africain", "européen"), ("africains", "européens"), ("immigrés", "natifs"), ("vieux", "jeune"), ("lesbienne", "hétérosexuelle"), ("handicapé", "valide"),
    ("frauen", "männer"), ("frau", "mann"), ("mädchen", "jungen"), ("sie", "er"), ("weiblich", "männlich"), ("muslime", "christen"), ("juden", "katholiken"), ("schwarze", "weiße"), ("schwarzer", "weißer"),
    ("afrikaner", "europäer"), ("einwanderer", "einheimische"), ("behinderte", "gesunde"), ("alte", "junge"), ("lesbisch", "heterosexuell"),
    ("mujeres", "hombres"), ("mujer", "hombre"), ("niñas", "niños"), ("ella", "él"), ("ellas", "ellos"), ("musulmanes", "cristianos"), ("musulmán", "cristiano"), ("judíos", "católicos"), ("judío", "católico"),
    ("negros", "blancos"), ("negro", "blanco"), ("africanos", "europeos"), ("inmigrantes", "nativos"), ("viejos", "jóvenes"), ("lesbiana", "heterosexuales"), ("discapacitados", "sanos"),
)

#: Where a sentence ends.
SENTENCE = re.compile(r"[.!?\n]+")


def swaps(pairs: tuple[tuple[str, str], ...]) -> dict[str, str]:
    out = {a: b for x, y in pairs for a, b in ((x, y), (y, x))}
    if len(out) != 2 * len(pairs):
        raise ValueError("a term has two counterparts")
    return out


@dataclass(frozen=True)
class Model:
    """Weights of features and a constant; a text's score is the logistic of the sum over the features it has."""

    weights: dict[str, float]
    constant: float

    def score(self, text: str | None) -> float:
        weights = self.weights
        total = self.constant + sum(weights[f] for f in features(text or "") if f in weights)
        return float(1 / (1 + np.exp(-np.clip(total, -30, 30))))


#: Lengths of the word beginnings that are features, besides whole words.
STEMS = (4, 5, 6)


def features(text: str) -> list[str]:
    """The distinct words of a text, lower-cased, and the beginnings of longer ones (marked by *), sorted."""
    words = set(WORD.findall(text.lower()))
    return sorted(words.union(*({w[:n] + "*" for w in words if len(w) > n} for n in STEMS)))


def swapped(text: str, swap: dict[str, str]) -> Counter:
    """What swapping does to the sentences of a text: how often (features lost, features gained) occurs; sentences without identity terms have none."""
    out: Counter = Counter()
    for sentence in SENTENCE.split(text.lower()):
        if any(w in swap for w in WORD.findall(sentence)):
            own = set(features(sentence))
            other = set(features(WORD.sub(lambda m: swap.get(m[0], m[0]), sentence)))
            out[tuple(sorted(own - other)), tuple(sorted(other - own))] += 1
    return out


def train(rows: list[tuple[list[int], list[tuple[list[int], list[int], int]], int, float]], n_features: int, ridge: float = 1.0, fairness: float = 1.0, rounds: int = 400) -> tuple[np.ndarray, float]:
    """Weights and constant by accelerated gradient steps, from rows of (features, swaps, label, weight).

    ``swaps`` are (features lost, features gained, how often) by the sentences
    of the row. The loss is the weighted mean of the logistic losses, half the
    ridge times the squared weights over the rows, and ``fairness`` times the
    weighted mean of the squared changes of score.
    """
    y = np.array([r[2] for r in rows], np.float64)
    wt = np.array([r[3] for r in rows], np.float64)
    wt /= wt.sum()

    def sparse(lists: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
        return np.fromiter((i for x in lists for i in x), np.int64), np.repeat(np.arange(len(lists)), [len(x) for x in lists])

    cols, owner = sparse([r[0] for r in rows])
    pairs = [(lost, gained, wt[i] * n) for i, r in enumerate(rows) for lost, gained, n in r[1]]
    a_cols, a_owner = sparse([x[0] for x in pairs])
    b_cols, b_owner = sparse([x[1] for x in pairs])
    m, pw = len(pairs), np.array([x[2] for x in pairs], np.float64)
    pw /= pw.sum() if m else 1.0
    base = float(np.clip(wt @ y, 1e-6, 1 - 1e-6))
    w, c = np.zeros(n_features), np.log(base / (1 - base))
    step_w, step_c = np.zeros(n_features), 0.0
    second, second_c = np.zeros(n_features), 0.0
    rate = 0.1
    for t in range(1, rounds + 1):
        z = c + np.bincount(owner, w[cols], len(rows))
        error = wt * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y)
        g = np.bincount(cols, error[owner], n_features) + ridge * w / max(1, len(rows))
        if m:
            gap = np.bincount(a_owner, w[a_cols], m) - np.bincount(b_owner, w[b_cols], m)
            pull = 2 * fairness * pw * gap
            g += np.bincount(a_cols, pull[a_owner], n_features) - np.bincount(b_cols, pull[b_owner], n_features)
        gc = error.sum()
        step_w, step_c = 0.9 * step_w + 0.1 * g, 0.9 * step_c + 0.1 * gc
        second, second_c = 0.999 * second + 0.001 * g**2, 0.999 * second_c + 0.001 * gc**2
        up, down = 1 - 0.9**t, 1 - 0.999**t
        w = w - rate * (step_w / up) / (np.sqrt(second / down) + 1e-8)
        c = c - rate * (step_c / up) / (np.sqrt(second_c / down) + 1e-8)
    return w, float(c)


def learn(docs: DataFrame, labels: DataFrame, sample_rows: int = 6_000, n_features: int = 2_048, least: int = 5, pairs: tuple[tuple[str, str], ...] = IDENTITY_PAIRS, fairness: float = 1.0, seed: int = 5, most_swaps: int = 256) -> Model:
    """Fits on the rows of at most ``sample_rows`` labelled ids of either class, the first by a hash of their ids, and on 2 * ``sample_rows`` rows at most.

    ``docs`` has doc_id and text; ``labels`` doc_id and toxic, 0 or 1. An id
    labelled both ways counts as toxic; null labels are left out. Without
    labels of one of the classes, or without their documents, the model is a
    constant: 0 where nothing is labelled toxic, 1 where all is. Of a row's
    swaps the ``most_swaps`` most frequent kinds count. The ids of
    the sample are the only thing that is broadcast, the sample's features of
    the ``n_features`` most telling ones the only thing that reaches the driver.
    """
    known = labels.filter(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1)).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    totals = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if len(totals) < 2:
        return Model({}, -30.0 if 1 not in totals else 30.0)
    order = F.xxhash64(F.lit(seed), "doc_id")
    parts = [known.filter(F.col("toxic") == y).orderBy(order, "doc_id").limit(sample_rows) for y in (0, 1)]
    sample = docs.join(F.broadcast(parts[0].unionByName(parts[1])), "doc_id").select("toxic", "text")
    swap = swaps(pairs)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: tuple[Counter, Counter] = (Counter(), Counter())
        for batch in steps(batches):
            for y, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                counts[y].update(features(t or ""))
                counts[y][""] += 1
        names = sorted(set(counts[0]) | set(counts[1]))
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([counts[0][x] for x in names], pa.int64()), pa.array([counts[1][x] for x in names], pa.int64())], names=["feature", "clean", "toxic"])

    counted = sample.mapInArrow(count, "feature string, clean long, toxic long").groupBy("feature").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    seen = {y: min(sample_rows, totals[y]) for y in (0, 1)}
    a, b = F.col("toxic") / F.lit(seen[1]), F.col("clean") / F.lit(seen[0])
    both = (F.col("toxic") + F.col("clean")) / F.lit(seen[0] + seen[1])
    telling = F.abs(a - b) / F.sqrt(F.greatest(both * (1 - both), F.lit(1e-9)))
    top = counted.filter((F.col("feature") != "") & (F.col("toxic") + F.col("clean") >= least)).orderBy(telling.desc(), "feature").limit(n_features)
    # written first, so that the best of each partition meet in a task and not in the driver
    chosen = {r["feature"] for r in cut(top.select("feature"), "features").collect()}
    index = {f: i for i, f in enumerate(sorted(chosen | set(swap)))}

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers = lambda found: [index[f] for f in found if f in index]
        change = pa.struct([("lost", pa.list_(pa.int32())), ("gained", pa.list_(pa.int32())), ("n", pa.int64())])
        for batch in steps(batches):
            texts = [t or "" for t in batch.column(1).to_pylist()]
            changed = [[{"lost": numbers(lost), "gained": numbers(gained), "n": n} for (lost, gained), n in sorted(swapped(t, swap).items(), key=lambda x: (-x[1], x[0]))[:most_swaps]] for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int32()), pa.array([numbers(features(t)) for t in texts], pa.list_(pa.int32())), pa.array(changed, pa.list_(change))], names=["toxic", "own", "swaps"])

    found = sample.mapInArrow(extract, "toxic int, own array<int>, swaps array<struct<lost: array<int>, gained: array<int>, n: long>>")
    # rows of a labelled id may be many: their number is bounded as well
    rows = found.orderBy(F.xxhash64(F.lit(seed), "toxic", "own", "swaps"), "toxic", "own").limit(2 * sample_rows).collect()
    share = {y: totals[y] / seen[y] for y in (0, 1)}
    rows = sorted(((list(r["own"]), [(list(x["lost"]), list(x["gained"]), x["n"]) for x in r["swaps"]], r["toxic"], share[r["toxic"]]) for r in rows), key=repr)
    if not rows:
        return Model({}, -30.0)
    w, c = train(rows, len(index), fairness=fairness)
    return Model({f: float(w[i]) for f, i in index.items() if w[i]}, c)


def score(docs: DataFrame, model: Model, keep: list[str], text: str = "text") -> DataFrame:
    """The columns ``keep`` and score (0 to 1) of every row; a null text counts as empty. ``keep`` must not hold score."""
    def scored(texts: pa.Array) -> list:
        return [pa.array([model.score(t) for t in texts.to_pylist()], pa.float64())]

    return map_column(docs, keep, F.coalesce(F.col(text), F.lit("")), [("score", "double")], scored)


def held_out(id_col: Column) -> Column:
    return F.coalesce(fold_of(id_col, 4) == 2, F.lit(False))


def learn_from_tables(spark, docs: DataFrame, sf_dir: str) -> Model:
    """The model from the labels of the rows that are not held out."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic").filter(~held_out(F.col("doc_id")))
    return learn(docs.select("doc_id", "text"), labels)


def op6_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    scored = score(docs, learn_from_tables(spark, docs, sf_dir), ["doc_id"])
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
