import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as pipeline
from cellwave.llm import idmap, ngramjoin


def shuffled(spark):
    """Bytes that all stages so far have written to shuffles."""
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    gateway = spark.sparkContext._gateway
    stages = spark.sparkContext._jsc.sc().statusStore().stageList(None, False, False, gateway.new_array(gateway.jvm.double, 0), gateway.jvm.java.util.ArrayList())
    return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size()))


def test_join_shuffles_little(spark, docs_frame, tmp_path):
    rng = random.Random(5)
    texts = [" ".join(f"w{rng.randrange(10**5)}" for _ in range(300)) for _ in range(1500)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(5000 + i, texts[i] + " more") for i in range(30)]
    docs = docs_frame(rows).select("doc_id", "text", "lang", "source", F.length("text").cast("long").alias("n_chars"))
    docs.write.parquet(str(tmp_path / "docs"))
    docs = spark.read.parquet(str(tmp_path / "docs"))
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as where ids are too many to be broadcast
    try:
        before = shuffled(spark)
        kept = {r["doc_id"] for r in pipeline.drop_near_copies(spark, docs, "").collect()}
        sent = shuffled(spark) - before
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    assert kept == set(range(1500))
    assert sent < 3 * sum(len(t) for _, t in rows), sent / sum(len(t) for _, t in rows)


@pytest.mark.parametrize("top", [0, 1, 255, 256, 2**42 - 1, 2**64 - 1])
def test_numbers_are_packed(top):
    numbers = np.array([0, top // 3, top, 1 % (top + 1)], np.uint64)
    packed = ngramjoin.narrow(numbers)
    assert len(packed) == 4 * max(1, -(-top.bit_length() // 8))
    assert ngramjoin.widen(packed, 4).tolist() == numbers.tolist()


@pytest.mark.parametrize("held", [1, 1 << 18])
def test_candidates_share_a_signature(spark, docs_frame, monkeypatch, held):
    real = ngramjoin.packed_signatures
    monkeypatch.setattr(ngramjoin, "packed_signatures", lambda *a: real(*a, held=held))
    same = "one two three four five six"
    rows = [(-(2**63), same), (2**63 - 1, same), (0, same + " x"), (-7, "a b c d e f"), (12, "a b c d e f"), (3, "alone is this"), (4, ""), (5, None)]
    shared = spark.sparkContext.broadcast(ngramjoin.PartEnum(80))
    edges = ngramjoin.candidate_edges(docs_frame(rows), 5, shared, 1).collect()
    parent = {}
    for a, b in sorted((max(r), min(r)) for r in edges):
        parent.setdefault(a, b)
    assert parent[12] == -7 and 2**63 - 1 in parent and not {3, 4, 5} & {x for r in edges for x in r}
    assert ngramjoin.candidate_edges(docs_frame(rows).limit(0), 5, shared, 0).count() == 0


def test_id_map_loses_no_id(spark):
    ids = spark.range(0, 30_000, 3).select(F.col("id").alias("doc_id"))
    rows = spark.range(-10_000, 40_000).select(F.col("id").alias("doc_id"), F.lit("x").alias("_at"))
    passed, not_in = ({r["doc_id"] for r in x.collect()} for x in idmap.part_by_map(rows, ids))
    assert passed >= set(range(0, 30_000, 3)) and len(passed) < 10_000 + 0.1 * 40_000
    assert passed | not_in == set(range(-10_000, 40_000)) and not passed & not_in
    assert {r["doc_id"] for r in idmap.part_by_map(rows, ids, most_bits=15)[0].collect()} >= passed
    assert idmap.part_by_map(rows, ids.limit(0))[0].isEmpty()
    nulls = spark.createDataFrame([(None, "a"), (3, None)], "doc_id long, text string")
    assert sum(x.count() for x in idmap.part_by_map(nulls, ids)) == 2


@pytest.mark.parametrize("percent", [50, 80, 90])
def test_sketches_lose_no_link(percent):
    rng = np.random.default_rng(percent)
    base = rng.integers(0, 2**63, 3000).astype(np.uint64)
    sets = []
    for size in (1, 2, 5, 31, 33, 64, 300, 3000):
        for _ in range(12):
            kept = base[:size][rng.random(size) >= rng.choice([0, 0.02, 0.1, 0.3])]
            sets.append(np.unique(np.concatenate((kept, rng.integers(0, 2**63, int(rng.integers(0, size // 8 + 2))).astype(np.uint64)))))
    sets += [np.unique(rng.integers(0, 2**63, 300).astype(np.uint64)) for _ in range(40)] + [base[:0]]
    found = [(min(i, int(j)), max(i, int(j))) for i, js in ngramjoin.near_by_sketch(np.array([len(x) for x in sets]), [ngramjoin.sketch(x) for x in sets], percent) for j in js]
    both = {(i, j): len(np.intersect1d(sets[i], sets[j])) for j in range(len(sets)) for i in range(j)}
    links = {p for p, k in both.items() if k and 100 * k >= percent * (len(sets[p[0]]) + len(sets[p[1]]) - k)}
    assert len(found) == len(set(found)) and links and links <= set(found)
    strange = range(96, 136)  # random sets of one size
    assert not [p for p in found if p[0] in strange and p[1] in strange]


def test_texts_that_meet_by_chance_are_not_sent(docs_frame, monkeypatch):
    real, sent = ngramjoin.cell_links, []

    def counted(cells, n, percent):
        sent.append(cells.count())
        return real(cells, n, percent)

    monkeypatch.setattr(ngramjoin, "cell_links", counted)
    rng = random.Random(7)
    # each line in two texts, so that none is common
    lines = 2 * [" ".join(f"l{rng.randrange(10**6)}" for _ in range(8)) for _ in range(300)]
    rng.shuffle(lines)
    texts = ["\n".join(lines[i : i + 3]) for i in range(0, 600, 3)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(5000 + i, texts[i] + " more") for i in range(10)]
    got = {r["doc_id"]: r["component_id"] for r in ngramjoin.near_groups(docs_frame(rows), 5, 80, cell=16, hubs=3).collect()}
    assert got == {i: i % 5000 for i, _ in rows}
    assert 20 <= sum(sent) <= 60, sent
