import numpy as np
from pyspark.sql import functions as F

from cellwave.llm import boosting, quality


def walk(model, row):
    """The margin of one row, tree by tree and node by node."""
    total, nodes = model.constant, model.feature.shape[1]
    for f, b, v in zip(model.feature, model.bound, model.value):
        at = 0
        while at < nodes:
            at = 2 * at + (2 if row[f[at]] > b[at] else 1)
        total += v[at - nodes]
    return total


def toy(rows=400, seed=2):
    rng = np.random.default_rng(seed)
    x = np.round(rng.normal(size=(rows, 5)), 1)
    y = (((x[:, 0] > 0.3) & (x[:, 1] > -0.5)) | (x[:, 2] > 1)).astype(float)
    return x, y


def test_flat_trees_are_plain_trees():
    x, y = toy()
    model = boosting.fit(x, y, np.ones(len(y)), trees=25, depth=3, bins=16)
    assert np.allclose(model.margin(x), [walk(model, r) for r in x])
    loss = lambda p: -np.mean(y * np.log(p) + (1 - y) * np.log(1 - p))
    assert loss(model.score(x)) < 0.5 * loss(np.full(len(y), y.mean()))
    few = boosting.fit(x, y, np.ones(len(y)), trees=5, depth=3, bins=16)
    assert np.array_equal(few.feature, model.feature[:5]) and np.array_equal(few.value, model.value[:5])


def test_a_split_is_the_best_of_all():
    x, y = toy(200)
    w = np.random.default_rng(1).integers(1, 4, len(y)).astype(float)
    model = boosting.fit(x, y, w, trees=1, depth=1, bins=500, rate=1.0, ridge=2.0)
    w = w / w.mean()
    p = 1 / (1 + np.exp(-model.constant))
    g, h = w * (p - y), w * p * (1 - p)
    gain = lambda s: g[s].sum() ** 2 / (h[s].sum() + 2)
    tries = [(gain(x[:, f] <= v) + gain(x[:, f] > v), f, v) for f in range(5) for v in np.unique(x[:, f])[:-1] if min(h[x[:, f] <= v].sum(), h[x[:, f] > v].sum()) >= 1]
    best, f, v = max(tries)
    left = x[:, model.feature[0, 0]] <= model.bound[0, 0]
    assert np.isclose(gain(left) + gain(~left), best)
    assert np.allclose(model.value[0], [-g[s].sum() / (h[s].sum() + 2) for s in (left, ~left)])


def test_weights_are_repeated_rows():
    x, y = toy(150)
    w = np.random.default_rng(3).integers(1, 4, len(y))
    a = boosting.fit(x, y, w.astype(float), trees=4, depth=2, bins=300, ridge=0.0, least=0.0)
    many = np.repeat(np.arange(len(y)), w)
    b = boosting.fit(x[many], y[many], np.ones(len(many)), trees=4, depth=2, bins=300, ridge=0.0, least=0.0)
    assert np.allclose(a.margin(x), b.margin(x))


def test_statistics_of_known_texts():
    texts = ["", "The cat. The cat.\nTHE END\n\nTHE END", "ab ab ab", "### 12 é É", "\U0001f600"]
    rows = [dict(zip(quality.NAMES, r)) for r in quality.statistics(texts)]
    assert not any(v for k, v in rows[0].items())
    a = rows[1]
    assert np.isclose(a["log_words"], np.log1p(8)) and a["log_lines"] == np.log1p(3) and np.isclose(a["distinct_lines"], 2 / 3) and np.isclose(a["stopped_lines"], 1 / 3)
    assert a["upper_words"] == 0.5 and a["distinct_words"] == 0.5 and np.isclose(a["top_word"], 0.25) and np.isclose(a["words_a_sentence"], 8 / 3)
    assert rows[2]["same_word_again"] == 1 and rows[2]["distinct_pairs"] == 0.5 and rows[2]["top_pair"] == 1
    assert rows[3]["no_letter_words"] == 0.5 and rows[3]["odd_words"] == 0.25 and rows[3]["digit"] == 0.2 and rows[3]["upper"] == 0.1 and rows[3]["longest_word"] == 3
    assert rows[4]["other"] == 1 and rows[4]["spread"] == 0
    assert np.allclose(quality.statistics(texts), np.concatenate([quality.statistics([t]) for t in texts]))


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    got = quality.op13_quality_trees(spark, sf)
    rows = got.join(labels, "doc_id").filter("held_out").select("quality", "predicted", "score").collect()
    assert len(rows) > 50 and sum(r["quality"] == r["predicted"] for r in rows) >= 0.97 * len(rows)
    assert all(0 <= r["score"] <= 1 for r in rows)
    assert got.count() == spark.read.parquet(f"{sf}/documents.parquet").count()


def test_quality_edge_cases(spark, docs_frame):
    good, bad = "the cat sat on the mat and it was good. ", "### *** $$$ ### "
    rows = [(i, (good if i % 2 else bad) * (1 + i % 7)) for i in range(60)] + [(None, good), (1, good), (70, None), (71, ""), (72, bad * 50_000)]
    docs = docs_frame(rows)
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)] + [(3, 0), (None, 1), (5, None)], "doc_id long, quality int")
    model = quality.learn(docs, labels, sample_rows=40, trees=10)
    got = quality.score(docs, model, ["doc_id", "lang", "cell"]).collect()
    assert len(got) == len(rows)
    by = {r["doc_id"]: r["score"] for r in got}
    assert by[41] > 0.5 > by[40] and by[72] < 0.5 and by[None] > 0.5 and by[70] == by[71]
    again = quality.learn(docs.repartition(5), labels.repartition(2), sample_rows=40, trees=10)
    assert np.array_equal(model.value, again.value) and np.array_equal(model.bound, again.bound)
    assert quality.score(docs_frame([]), model, ["doc_id"]).count() == 0
    one = quality.learn(docs, labels.filter("quality = 1"))
    assert {r["score"] > 0.99 for r in quality.score(docs, one, ["doc_id"]).collect()} == {True}
    none = quality.learn(docs, labels.filter(F.lit(False)))
    assert {r["score"] < 0.01 for r in quality.score(docs, none, ["doc_id"]).collect()} == {True}
    nowhere = quality.learn(docs_frame([]), labels)
    assert nowhere.score(quality.statistics(["a"]))[0] < 0.01


def test_rows_of_one_labelled_id_are_bounded(spark, docs_frame):
    docs = docs_frame([(1, f"the cat {i}") for i in range(300)] + [(2, "### $$$")])
    labels = spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, quality int")
    sizes = []
    real = boosting.fit
    try:
        boosting.fit = lambda x, y, w, **k: sizes.append(len(y)) or real(x, y, w, **k)
        quality.learn(docs, labels, sample_rows=50, trees=2)
    finally:
        boosting.fit = real
    assert not sizes or sizes[0] <= 100
