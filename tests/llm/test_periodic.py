import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from cellwave.llm import periodic, suffixtree
from tests.llm.conftest import words


def brute(ws, exponent=4, least=6):
    """All runs of a list of words, period by period."""
    n, found = len(ws), []
    for q in range(1, n // exponent + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and ws[j] == ws[j + q]:
                j += 1
            length = j - i + q
            if j > i and length >= max(least, exponent * q):
                part = ws[i : i + length]
                if not any(part[p:] == part[:-p] for p in range(1, q)):
                    found.append((i, length, q))
            i = max(j, i + 1)
    return sorted(found, key=lambda r: (r[0], r[2]))


def sequences():
    rng = random.Random(3)
    for n in (0, 1, 5, 6, 7, 12, 40, 150):
        for letters in (1, 2, 3, 8):
            yield [rng.randrange(letters) for _ in range(n)]
    a, b = [0], [0, 1]
    for _ in range(9):
        a, b = b, b + a  # Fibonacci words have runs of exponents above 3
    yield b
    for _ in range(60):
        ws = []
        for _ in range(rng.randrange(1, 5)):
            root = [rng.randrange(4) for _ in range(rng.randrange(1, 9))]
            ws += (root * 9)[: rng.randrange(1, 9 * len(root))] + [rng.randrange(4) for _ in range(rng.randrange(4))]
        yield ws


@pytest.mark.parametrize("exponent,least", [(4, 6), (2, 2), (3, 5)])
def test_runs_are_those_of_brute_force(exponent, least):
    every = list(sequences())
    ids = np.array([w for ws in every for w in ws])
    upto = np.concatenate(([0], np.cumsum([len(ws) for ws in every])))
    start, length, period = periodic.find(ids, upto, exponent, least)
    want = [(upto[i] + s, n, q) for i, ws in enumerate(every) for s, n, q in brute(ws, exponent, least)]
    assert list(zip(start.tolist(), length.tolist(), period.tolist())) == want and len(want) > 50
    for i, ws in enumerate(every):  # one text at a time
        got = periodic.find(np.array(ws, np.int64), np.array([0, len(ws)]), exponent, least)
        assert list(zip(*[x.tolist() for x in got])) == brute(ws, exponent, least)


def test_tree_extensions_and_lyndon_words():
    rng = random.Random(5)
    s = [rng.randrange(1, 4) for _ in range(300)] + [0]
    tree = suffixtree.SuffixTree(s, 1)
    assert tree.order(False) == sorted(range(301), key=lambda i: s[i:])
    turned = [-x if x else -9 for x in s]
    assert tree.order(True) == sorted(range(301), key=lambda i: turned[i:])
    a, b = np.array([(i, j) for i in range(301) for j in range(301) if i != j]).T
    got = tree.extension(a, b)
    for i, j, n in zip(a.tolist(), b.tolist(), got.tolist()):
        assert s[i : i + n] == s[j : j + n] and s[i + n] != s[j + n]
    for back, t in ((False, s), (True, turned)):
        longest = tree.lyndon(back)
        for i in range(300):
            lyndon = [n for n in range(1, 301 - i) if all(t[i : i + n] < t[i + k : i + n] for k in range(1, n))]
            assert longest[i] == lyndon[-1]


def test_periodic_edge_cases(spark, docs_frame):
    long = "la " * 50_000 + "x y z " * 3_000
    rows = [(1, None), (2, ""), (3, " \t\n"), (None, "a " * 9), (4, "a b " * 8 + "c"), (4, "a b " * 8 + "c"), (5, long), (6, "é b  " * 7)]
    got = periodic.periodic_runs(docs_frame(rows), ["doc_id", "lang", "n_chars"]).collect()
    assert len(got) == len(rows)
    by = {r["doc_id"]: r for r in got}
    assert by[1]["runs"] == by[2]["runs"] == by[3]["runs"] == [] and by[3]["collapsed"] == "" and by[1]["n_words"] == 0
    assert [tuple(x) for x in by[None]["runs"]] == [(0, 9, 1)] and by[None]["collapsed"] == "a"
    assert [tuple(x) for x in by[4]["runs"]] == [(0, 16, 2)] and by[4]["collapsed"] == "a b c"
    assert [tuple(x) for x in by[5]["runs"]] == [(0, 50_000, 1), (50_000, 9_000, 3)] and by[5]["collapsed"] == "la x y z"
    assert by[6]["n_words"] == 7 and by[6]["collapsed"] == "é b "
    assert periodic.periodic_runs(docs_frame([]), ["doc_id"]).count() == 0
    with pytest.raises(ValueError):
        periodic.periodic_runs(docs_frame([]), ["doc_id"], exponent=1)


def test_op11_is_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}
    got = {r["doc_id"]: r for r in periodic.op11_periodic_runs(spark, sf).collect()}
    assert got.keys() == texts.keys()
    planted = 0
    for i, text in texts.items():
        ws = words(text)
        n, h = len(ws), zlib.crc32(str(i).encode())
        g = h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            ws = [w if k < a else ws[a + (k - a) % p] for k, w in enumerate(ws)]
            planted += 1
        if n > 3_000:
            continue  # brute force is quadratic
        runs = brute(ws)
        r = got[i]
        drop = {k for s, m, q in runs for k in range(s + q, s + m)}
        best = max(runs, key=lambda x: (x[1], -x[0], -x[2]), default=None)
        want = (best[0], best[1], best[2], 1000 * best[1] // best[2]) if best else (None,) * 4
        assert (r["start"], r["length"], r["period"], r["exponent_milli"]) == want and r["n_runs"] == len(runs)
        assert r["runs_sha256"] == hashlib.sha256("".join(f"{s},{m},{q}\n" for s, m, q in runs).encode()).hexdigest()
        assert r["collapsed_sha256"] == hashlib.sha256(" ".join(w for k, w in enumerate(ws) if k not in drop).encode()).hexdigest()
    assert planted > 5


def test_planted_keeps_null_ids_and_empty_texts(spark):
    ids = [i for i in range(200) if zlib.crc32(str(i).encode()) % 10 == 0][:3]
    df = spark.createDataFrame([(None, "a b"), (ids[0], None), (ids[1], " \n"), (ids[2], "one")], "doc_id long, text string")
    got = {r["doc_id"]: r["text"] for r in periodic.planted(df).collect()}
    assert got == {None: "a b", ids[0]: None, ids[1]: " \n", ids[2]: "one"}
    assert periodic.planted(df.filter(F.lit(False))).count() == 0
