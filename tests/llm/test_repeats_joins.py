import hashlib
import os
import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from cellwave.llm import graph, ngramjoin, repeats, shingles, store, suffixes
from cellwave.llm.arrow import utf8
from cellwave.llm.shingles import prefix_hashes
from tests.llm.conftest import words


def brute_repeats(rows, length=100):
    seen, out = set(), {}
    for i, t in sorted(rows, key=lambda x: x[0]):
        data = (t or "").encode()
        mark = bytearray(len(data))
        for s in range(len(data) - length + 1):
            window = data[s : s + length]
            if window in seen:
                mark[s : s + length] = b"\1" * length
            seen.add(window)
        kept = bytes(x for x, m in zip(data, mark) if not m)
        out[i] = (len(data), sum(mark), sum(m and not (k and mark[k - 1]) for k, m in enumerate(mark)), hashlib.sha256(kept).hexdigest())
    return out


def repeat_rows():
    rng = random.Random(1)
    rt = lambda n, a="abcdefghij ": "".join(rng.choice(a) for _ in range(n))
    line, passage, rows = rt(70), rt(300), []
    for i in range(90):
        t = rt(rng.randrange(0, 400))
        for _ in range(rng.randrange(0, 4)):
            t += rng.choice([line, passage, passage[: rng.randrange(90, 200)], rt(50)]) + rt(rng.randrange(0, 9))
        if i % 7 == 0:
            t = "a" * rng.randrange(0, 500)
        if i % 11 == 0 and rows:
            t = rows[rng.randrange(len(rows))][1][5:]
        rows.append((i, t))
    return rows + [(500, None), (501, ""), (502, "é" * 120), (503, "x" + "é" * 90), (504, passage * 40)]


def told(df):
    spans = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["begin"])
    return [(r["doc_id"], (r["n_bytes"], r["n"], r["k"], r["h"])) for r in df.select("doc_id", "n_bytes", spans.alias("n"), F.size("spans").alias("k"), F.sha2("kept", 256).alias("h")).collect()]


@pytest.mark.parametrize("anchor_runs,sample_docs", [(2_000, 8_192), (3, 0), (3, 8_192)])
def test_repeats_are_brute_force(docs_frame, monkeypatch, anchor_runs, sample_docs):
    monkeypatch.setattr(repeats.usual_anchors, "__defaults__", (4, 1 << 14))  # an anchor is usual from four runs on
    rows = repeat_rows()
    assert dict(told(repeats.remove_repeats(docs_frame(rows), anchor_runs=anchor_runs, sample_docs=sample_docs))) == brute_repeats(rows)


def test_hashes_do_not_decide_what_goes(docs_frame, monkeypatch):
    def same(offsets, data, length, gram):  # all runs look alike
        found = real(offsets, data, length, gram)
        return found | {"cls": found["cls"] * 0, "key": found["key"] * 0}

    real = suffixes.anchors
    monkeypatch.setattr(repeats, "anchors", same)
    rows = repeat_rows()[::2]
    assert dict(told(repeats.remove_repeats(docs_frame(rows), sample_docs=0))) == brute_repeats(rows)


@pytest.mark.parametrize("held", [False, True])
def test_a_part_is_sorted_by_its_bytes(monkeypatch, held):
    rng = random.Random(4)
    line = "".join(rng.choice("abcdef") for _ in range(400)).encode()
    spans = sorted((rng.randrange(3), doc, at, line[at + k : at + k + 100 + n]) for doc, (at, k, n) in enumerate((rng.randrange(9), rng.choice((0, 0, 40)), rng.randrange(9)) for _ in range(60)))
    # runs of documents 0 to 59 that begin at 10 with their anchor 0 bytes on, so that they meet by their own places
    spans = sorted((key, doc, 10, body) for key, doc, _, body in spans)
    key, doc, first = (np.array([x[i] for x in spans], np.int64) for i in range(3))
    sizes = np.array([len(x[3]) for x in spans])
    run = repeats.pack(first, first + sizes - 100, np.zeros(len(first), np.int64), 0)
    args = (key, doc, run, np.append(0, np.cumsum(sizes)), np.frombuffer(b"".join(x[3] for x in spans), np.uint8), np.full(len(key), held), 100)

    def gone(d, r):
        return {(i, k) for i, (a, b, _, g) in zip(d.tolist(), zip(*(x.tolist() for x in repeats.unpack(r)))) if g for k in range(a, b + 1)}

    wanted, seen = set(), set()
    for k, i, at, body in spans:
        for j in range(len(body) - 99):
            if (k, j, body[j : j + 100]) in seen:
                wanted.add((i, at + j))
            seen.add((k, j, body[j : j + 100]))
    whole, seen = set(), set()
    for k, i, at, body in spans:
        whole |= {(i, at + j) for j in range(len(body) - 99)} if (k, body) in seen else set()
        seen.add((k, body))
    assert gone(*repeats.sort_part(*args)) == (whole if held else wanted) and wanted > whole
    monkeypatch.setattr(repeats, "span_hashes", lambda sums, a, b: np.zeros(len(a), np.uint64))
    monkeypatch.setattr(suffixes, "extension", lambda sums, a, b, most: np.full(len(a), most))
    got = gone(*repeats.sort_part(*args))
    assert got <= wanted if held else got == wanted


def test_texts_longer_than_a_block(monkeypatch):
    rng = np.random.default_rng(9)
    data = np.concatenate((rng.integers(0, 256, 6000), np.zeros(2500, int), rng.integers(0, 256, 500))).astype(np.uint8)
    offsets = np.array([0, 30, 5000, 9000])
    windows = lambda r: [(t, s, a + f - s) for t, f, l, a in zip(*(r[k].tolist() for k in ("text", "first", "last", "at"))) for s in range(f, l + 1)]
    whole = suffixes.anchors(offsets, data, 100, 32)
    monkeypatch.setattr(suffixes, "BLOCK", 512)
    cut_up = suffixes.anchors(offsets, data, 100, 32)
    assert len(cut_up["text"]) > len(whole["text"]) and (cut_up["at"] >= 0).all()
    assert sorted(windows(cut_up)) == sorted(windows(whole)) and len(windows(whole)) == 4970 - 99 + 4000 - 99


def test_long_texts_repeat_each_other(docs_frame):
    rng = np.random.default_rng(10)
    text = rng.integers(97, 123, (3 << 20) // 2).astype(np.uint8).tobytes().decode()  # above a step of 1 MB
    rows = [(1, text), (2, text[1000:] + "x"), (3, "y" + text[5000:5200]), (4, text[7000:7050])]
    got = {i: x[1] for i, x in told(repeats.remove_repeats(docs_frame(rows)))}
    assert got == {1: 0, 2: len(text) - 1000, 3: 200, 4: 0}


def test_repeated_and_null_ids(docs_frame):
    rng = random.Random(3)
    text = "".join(rng.choice("abcdef") for _ in range(400))
    rows = [(7, text), (7, text), (None, text[:150]), (9, text[100:])]
    got = told(repeats.remove_repeats(docs_frame(rows)))
    assert sorted((str(i), x[1]) for i, x in got) == [("7", 150), ("7", 400), ("9", 300), ("None", 0)]
    assert repeats.remove_repeats(docs_frame(rows).limit(0)).count() == 0


def test_suffix_order_is_a_sort():
    rng = np.random.default_rng(2)
    data = rng.integers(97, 99, 4000).astype(np.uint8)
    starts = rng.choice(3800, 900)
    group = np.sort(rng.integers(0, 9, 900))
    order = suffixes.suffix_order(data, prefix_hashes(data), starts, group, 100)
    key = lambda i: (group[i], data[starts[i] : starts[i] + 100].tobytes(), i)
    assert order.tolist() == sorted(range(900), key=key)


def test_hash_collisions_are_found(monkeypatch):
    data = np.frombuffer(b"abcdefgh" * 20 + b"ijklmnop" * 20 + b"abcdefgh" * 20, np.uint8)
    monkeypatch.setattr(suffixes, "extension", lambda sums, a, b, most: np.full(len(a), most))  # every comparison says equal
    starts, group = np.array([0, 160, 320]), np.zeros(3, np.int64)
    assert suffixes.repeated_windows(data, starts, group, 100).tolist() == [False, False, True]


def brute_groups(rows, n, percent):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = {}
    for i, t in rows:
        w = words((t or "").translate(low))
        sets[i] = {tuple(w[j : j + n]) for j in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())
    inverted, parent = defaultdict(list), {i: i for i in sets}
    for i, s in sets.items():
        for x in s:
            inverted[x].append(i)

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in sets:
        for j, k in Counter(j for x in sets[i] for j in inverted[x] if j < i).items():
            if 100 * k >= percent * (len(sets[i]) + len(sets[j]) - k):
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    return {i: (len(s), root(i)) for i, s in sets.items()}


def near_rows():
    rng, rows = random.Random(3), []
    line = "The quick line that is shared by all of them here"
    for _ in range(3):
        base = [f"w{rng.randrange(5000)}" for _ in range(rng.choice([40, 120, 300]))]
        for _ in range(70):
            w = list(base)
            for _ in range(rng.randrange(0, max(2, len(w) // 12))):
                w[rng.randrange(len(w))] = f"x{rng.randrange(10**6)}"
            rows.append((len(rows), line + "\n" + " ".join(w)))
    for _ in range(100):
        rows.append((len(rows), " ".join(f"y{rng.randrange(10**6)}" for _ in range(rng.randrange(0, 6))) + " " + line))
    for _ in range(40):
        rows.append((len(rows), " ".join(rng.choice("abc") for _ in range(rng.randrange(0, 30)))))
    n = len(rows)
    return rows + [(n, None), (n + 1, ""), (n + 2, " \n"), (n + 3, "a"), (n + 4, "A"), (n + 5, "Long word " * 4000)]


@pytest.mark.parametrize("n,percent,whole", [(3, 90, None), (5, 80, None), (3, 90, True), (5, 80, False)])
def test_near_groups_are_brute_force(docs_frame, monkeypatch, n, percent, whole):
    real = ngramjoin.cut

    def chosen(df, name):  # large blocks as a whole, or by signature
        return real(df.withColumn("whole", F.lit(whole)) if name == "choice" and whole is not None else df, name)

    monkeypatch.setattr(ngramjoin, "cut", chosen)
    rows = near_rows()
    got = ngramjoin.near_groups(docs_frame(rows), n, percent, cell=16, hubs=3)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got.collect()} == brute_groups(rows, n, percent)


def test_near_groups_edge_rows(docs_frame):
    rows = [(4, "one two three four five six"), (4, "one two three four five six"), (9, "ONE two three four five six"), (None, "one two three four five six"), (11, None)]
    got = [(r["doc_id"], r["component_id"]) for r in ngramjoin.near_groups(docs_frame(rows)).collect()]
    assert sorted(got, key=str) == sorted([(4, 4), (4, 4), (9, 4), (None, None), (11, 11)], key=str)
    assert ngramjoin.near_groups(docs_frame(rows).limit(0)).count() == 0


def test_similar_sets_share_a_signature():
    rng = np.random.default_rng(8)
    for percent in (70, 80, 90):
        for size in (1, 2, 3, 7, 20, 60, 200):
            for common in (None, "half"):
                base = rng.integers(0, 2**63, size).astype(np.uint64)
                listed = base[: size // 2].copy() if common else None
                enum = ngramjoin.PartEnum(percent, listed)
                for _ in range(20):
                    drop = int(rng.integers(0, max(1, int(size * (1 - percent / 100))) + 1))
                    other = np.concatenate((base[drop:], rng.integers(0, 2**63, int(rng.integers(0, drop + 1))).astype(np.uint64)))
                    a, b = np.unique(base), np.unique(other)
                    both = len(np.intersect1d(a, b))
                    if 100 * both >= percent * (len(a) + len(b) - both):
                        assert len(np.intersect1d(enum.signatures(a), enum.signatures(b))), (percent, size, drop)


def test_components(spark):
    rng = random.Random(6)
    edges = [(i, i + 1) for i in range(40)] + [(100, x) for x in range(101, 140)] + [(rng.randrange(200, 300), rng.randrange(200, 300)) for _ in range(80)]
    parent = {}

    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a != b:
            x, y = root(a), root(b)
            parent[max(x, y)] = min(x, y)
    got = {r["node"]: r["label"] for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: root(x) for x in parent}
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_tables_are_dropped(spark):
    path = spark.createDataFrame([(i, i + 1) for i in range(50)], "a long, b long")
    store.clear(spark)
    labels = graph.components(path)
    assert len(store._written) == 1 and labels.count() == 51  # what the labels are read from
    store.clear(spark)
    assert not store._written and not any(os.path.exists(f.partition(":")[2]) for f in labels.inputFiles())


def test_components_do_not_stop_halfway(spark):
    path = spark.createDataFrame([(i, i + 1) for i in range(200)], "a long, b long")
    with pytest.raises(RuntimeError, match="2 rounds"):
        graph.components(path, most_rounds=2)
    assert {r["label"] for r in graph.components(path).collect()} == {0}


def test_long_texts_link(docs_frame, monkeypatch):
    monkeypatch.setattr(ngramjoin, "CELL_SHINGLES", 1000)
    rng = random.Random(12)
    long = [f"w{rng.randrange(10**6)}" for _ in range(200_000)]  # above a step of 1 MB
    changed = [f"x{i}" if i % 200 == 0 else w for i, w in enumerate(long)]
    rows = [(1, " ".join(long)), (2, " ".join(changed)), (3, " ".join(long[:100_000])), (4, " ".join(changed[: 195_000]))]
    got = {r["doc_id"]: r["component_id"] for r in ngramjoin.near_groups(docs_frame(rows), 5, 80).collect()}
    assert got == {1: 1, 2: 1, 3: 3, 4: 1}


@pytest.mark.parametrize("letters", [512, 1024, 2048])
def test_words_that_defeat_polynomials(docs_frame, letters):
    word = "".join("ab"[bin(i).count("1") % 2] for i in range(letters))  # and its complement have the same polynomial for every odd base
    rows = [(1, word), (2, word.translate(str.maketrans("ab", "ba"))), (3, "x y z")]
    got = {r["doc_id"]: r["component_id"] for r in ngramjoin.near_groups(docs_frame(rows), 3, 90).collect()}
    assert got == {1: 1, 2: 2, 3: 3}


def test_exact_sets_are_shingle_sets():
    rng = random.Random(9)
    texts = [" ".join(rng.choice("aB") * rng.randrange(1, 3) for _ in range(rng.randrange(9))) for _ in range(80)] + ["", "A a a", "a a A", "  a\n", " ".join(f"w{i}" for i in range(70_000))]
    for n in (1, 3, 5, 8):
        numbers, upto = shingles.exact_sets([t.encode() for t in texts], n)
        hashes, ends = shingles.shingle_sets(*utf8(pa.array(texts)), n)
        assert upto.tolist() == ends.tolist()
        for t, a, b in zip(texts, upto[:-1], upto[1:]):
            ws = words("".join(c.lower() if "A" <= c <= "Z" else c for c in t))
            want = {tuple(ws[i : i + n]) for i in range(max(1, len(ws) - n + 1))} if ws else set()
            assert len(want) == b - a
        assert len(set(numbers.tolist())) == len(set(hashes.tolist()))


@pytest.mark.parametrize("whole", [True, False])
def test_repeated_rows_change_no_group(docs_frame, monkeypatch, whole):
    kept, real = [], ngramjoin.cut

    def chosen(df, name):
        made = real(df.withColumn("whole", F.lit(whole)) if name == "choice" else df, name)
        if name == "signature-groups":
            kept.append(made.count())
        return made

    monkeypatch.setattr(ngramjoin, "cut", chosen)
    rows = near_rows()
    once, twice = ({r["doc_id"]: r["component_id"] for r in ngramjoin.near_groups(docs_frame(x), 3, 90, cell=16, hubs=3).collect()} for x in (rows, rows * 2))
    assert once == twice == {k: v[1] for k, v in brute_groups(rows, 3, 90).items()}
    assert kept[0] == kept[1] > 0


def test_common_shingles_are_counted_over_all_documents(spark):
    # more documents than a sample of 40,000 would take; words of ten documents each, and of nine
    n = 60_000
    texts = spark.range(n, numPartitions=4).select(F.col("id").alias("doc_id"), F.concat(F.lit("same a"), F.floor(F.col("id") / 10), F.lit(" b"), F.floor(F.col("id") / 9)).alias("text"))
    got = ngramjoin.common_shingles(texts, 1, share=10 / n)
    wanted = [f"a{i}" for i in range(n // 10)] + ["same"]
    data = "".join(wanted).encode()
    offsets = np.concatenate((np.zeros(1, np.int64), np.cumsum([len(w) for w in wanted])))
    found, _ = shingles.shingle_sets(offsets, np.frombuffer(data, np.uint8), 1)
    assert set(got.tolist()) == set(found.tolist()) and len(got) == len(wanted)
    assert got[-1] == found[-1]  # the most frequent comes last
