import random
import re
from collections import Counter

import numpy as np
import pytest

from cellwave.llm import phrases


def brute(rows, least=30, inside=80, top=2000):
    counts, totals, first = Counter(), Counter(), {}
    for doc, text, lang in rows:
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            ws = re.findall(r"[^\x20\x09]+", piece)
            totals[lang or "und"] += len(ws)
            for n in range(1, 5):
                for i in range(len(ws) - n + 1):
                    key = (lang or "und", tuple(ws[i : i + n]))
                    counts[key] += 1
                    if doc is not None:
                        first[key] = min(doc, first.get(key, doc))
    often = {k: a for k, a in counts.items() if len(k[1]) > 1 and a >= least}
    out = []
    for (lang, p), a in often.items():
        score, k = min((2_000_000 * a // (counts[lang, p[:k]] + counts[lang, p[k:]]), k) for k in range(1, len(p)))
        longer = [b for (other, q), b in often.items() if other == lang and len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q)))]
        if not any(100 * b >= inside * a for b in longer):
            out.append((lang, " ".join(p), a, counts[lang, p[:k]], counts[lang, p[k:]], totals[lang], score, first.get((lang, p))))
    found = []
    for lang in sorted({r[0] for r in out}):
        best = sorted((r for r in out if r[0] == lang), key=lambda r: (-r[6], -r[2], r[1].encode()))[:top]
        found += [(r[0], i + 1, *r[1:]) for i, r in enumerate(best)]
    return found


def frame(spark, rows):
    from pyspark.sql import functions as F

    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    return df.select("*", *[F.lit("x").alias(c) for c in ("phrase", "a", "n", "score", "rank", "size", "fp", "w")])


def some_rows(seed):
    rng = random.Random(seed)
    vocab = ["a", "b", "É", "é", "Cd", "cD", "x-y", "\U0001f600", "zz"]
    ends = [" ", "  ", "\t", ", ", ".\n", "!", " ? ", "\r\n", "\x0b"]
    rows = [(i, "".join(rng.choice(vocab) + rng.choice(ends) for _ in range(rng.randrange(60))), rng.choice(["en", "fr", None, "und"])) for i in range(60)]
    return [*rows, (60, None, "en"), (61, "", None), (62, " \t.,", "fr"), (None, "a b a b a b", "en"), (5, "a b a b", "en"), (5, "a b a b", "en"), (63, "a b c d e " * 20_000, "long")]


@pytest.mark.parametrize("least,inside,top", [(3, 80, 2000), (6, 50, 5)])
def test_collocations_are_brute_force(spark, least, inside, top):
    rows = some_rows(least)
    got = phrases.collocations(frame(spark, rows), least=least, inside_percent=inside, top=top, bits=10).collect()
    want = brute(rows, least, inside, top)
    assert sorted(map(tuple, got)) == want and len(want) > 10


def test_collocations_of_nothing(spark):
    assert phrases.collocations(frame(spark, [])).count() == 0
    assert phrases.collocations(frame(spark, [(1, None, None), (2, "a b", "en")])).count() == 0


def test_collided_fingerprints_are_told_apart():
    texts = [b"ab cd ab cd", b"ef gh ef gh, ab cd"]
    w = phrases.Words(texts, ["en", "en"])
    everything = lambda prints: np.ones(len(prints), bool)
    w.word = np.zeros_like(w.word)  # all words collide
    ids = w.exact()
    assert len(set(ids.tolist())) == 4 and ids.tolist()[0] == ids.tolist()[2] == ids.tolist()[8]
    w.sums[:] = 0  # and so do all phrases
    raw = w.data.tobytes()
    for n in (1, 2, 3):
        pointer, counts = w.frequent(n, ids, everything)
        got = Counter()
        for i, c in zip(pointer.tolist(), counts.tolist()):
            got[w.phrase(raw, i, n)] += c
        want = Counter(b" ".join(x[i : i + n]) for piece in (b"ab cd ab cd", b"ef gh ef gh", b"ab cd") for x in [piece.split()] for i in range(len(x) - n + 1))
        assert got == want


def test_the_map_lets_frequent_fingerprints_through(spark):
    prints = np.random.default_rng(1).integers(0, 2**64, 2_000, dtype=np.uint64)
    told = (prints >> np.uint64(32)).astype(np.uint32).view(np.int32)
    rows = [(int(p), 3) for p in told[:500]] + [(int(p), 1) for p in told]
    found = phrases.Frequent(16).with_frequent(spark.createDataFrame(rows, "fp int, n long"), 4)
    assert found(prints[:500]).all() and found(prints[500:]).sum() < 50
    more = found.with_frequent(spark.createDataFrame(rows, "fp int, n long"), 1)
    assert more(prints).all() and found(prints[500:]).sum() < 50


def test_products_past_64_bits(spark):
    big = 2**62
    row = spark.createDataFrame([(big, big, big)], "a long, l long, r long").selectExpr("(cast(a as decimal(20,0)) * 2000000BD) div (cast(l as decimal(20,0)) + cast(r as decimal(20,0))) s").first()
    assert row["s"] == 1_000_000
