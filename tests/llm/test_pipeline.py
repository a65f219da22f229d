import hashlib
from collections import Counter

from pyspark.sql import functions as F

import corpus_pipeline as pipeline
from cellwave.llm import bpe, mixing, toxicity
from cellwave.llm.store import cut

from .test_repeats_joins import brute_groups

SMALL = "/root/testdata/sf0.001"


def rows_of(df):
    return sorted(tuple(r) for r in df.select(*pipeline.COLUMNS).collect())


def rolling_hashes(hashes, base, prime=2**31 - 1):
    """The number of each gap by the rolling update: the oldest line leaves, the next one enters; the prime at both ends."""
    numbers, rolled = [prime], hashes[0] % prime
    for k in range(1, len(hashes)):
        oldest = hashes[k - 2] * base if k > 1 else 0
        rolled = ((rolled - oldest) * base + hashes[k]) % prime
        numbers.append(rolled)
    return numbers + [prime]


def brute_chunks(rows, seeds=8):
    """Texts without the chunks of two and more lines that have occurred before, and whether anything went."""
    found = []
    for i, text, *_ in rows:
        lines = (text or "").split("\n")
        hashes = [int(hashlib.md5(x.encode()).hexdigest()[:7], 16) for x in lines]
        for s in range(seeds):
            numbers = rolling_hashes(hashes, 48271 ** (9 * s + 9))
            begin = 0
            for k in range(1, len(lines) + 1):
                if k == len(lines) or not (hashes[k] == hashes[k - 1] or numbers[k - 1] > numbers[k] < numbers[k + 1]):
                    if k - begin > 1:
                        found.append((tuple(lines[begin:k]), i, begin))
                    begin = k
    first, gone = {}, set()
    for body, i, begin in sorted(set(found), key=lambda x: x[1:]):
        if first.setdefault(body, (i, begin)) != (i, begin):
            gone |= {(i, k) for k in range(begin, begin + len(body))}
    return {i: ["\n".join(x for k, x in enumerate((text or "").split("\n")) if (i, k) not in gone), any(g == i for g, _ in gone)] for i, text, *_ in rows}


def test_each_stage_and_the_whole(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    before = rows_of(docs)
    model = toxicity.learn_from_tables(spark, docs, SMALL)
    low = {r["doc_id"] for r in toxicity.score(docs, model, ["doc_id"]).filter("score < 0.3").collect()}
    clean = cut(pipeline.drop_toxic(spark, docs, SMALL), "test-clean")
    assert rows_of(clean) == [r for r in before if r[0] in low]

    lines = cut(pipeline.drop_repeated_lines(spark, clean, SMALL), "test-lines")
    left = brute_chunks(rows_of(clean))
    expected = [(i, left[i][0], lang, source, len(left[i][0]) if left[i][1] else n) for i, _, lang, source, n in rows_of(clean) if not left[i][1] or left[i][0].strip(" ")]
    assert rows_of(lines) == expected and any(cut_ for _, cut_ in left.values())

    single = cut(pipeline.drop_near_copies(spark, lines, SMALL), "test-single")
    groups = brute_groups([r[:2] for r in rows_of(lines)], 5, 80)
    assert rows_of(single) == [r for r in rows_of(lines) if groups[r[0]][1] in (None, r[0])]

    mixed = cut(pipeline.mix_sources(spark, single, SMALL), "test-mixed")
    taken = {r["doc_id"]: (r["size"], r["taken"]) for r in mixing.mix(single).collect()}
    times = {i: int(t / s + 0.5) if s else 1 for i, (s, t) in taken.items()}
    assert Counter(r[0] for r in rows_of(mixed)) == Counter({i: n for i, n in times.items() if n})

    tokens = cut(pipeline.encode_tokens(spark, mixed, SMALL), "test-tokens")
    texts = {r[0]: r[1] for r in rows_of(mixed)}
    for r in tokens.collect():
        assert r["decoded_sha256"] == hashlib.sha256((texts[r["doc_id"]] or "").encode()).hexdigest() and r["n_tokens"] == len(r["ids"])
    for r in bpe.decode(tokens, bpe.default_tokenizer(), ["doc_id"]).collect():
        assert r["text"] == texts[r["doc_id"]]
    key = lambda df: sorted((r["doc_id"], r["source"], tuple(r["ids"]), r["decoded_sha256"]) for r in df.collect())
    assert key(pipeline.run(spark, SMALL)) == key(tokens)


def edge_rows(spark):
    """Nulls in every column, empty and repeated rows, one id with two texts, and columns that clash."""
    block = "\n".join(f"line {k} of the block" for k in range(6))
    long = " ".join(f"w{k % 977}" for k in range(4000))
    rows = [
        (1, block + "\nfirst", "en", "a", 5), (1, block + "\nfirst", "en", "a", 5), (2, "second\n" + block, None, None, None), (3, None, "en", "a", 0), (4, "", "en", "b", 0),
        (None, "no id " + long, "en", "b", 7), (5, long, "en", "b", 9), (6, long + " more", "en", "c", 9), (7, "one text", "en", "c", 1), (7, "another text", "en", "c", 1), (8, " \n ", "de", "c", 3),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    return df.select("*", *[F.lit("x").alias(c) for c in ("score", "_text", "key", "component_id", "_times", "_copy", "ids", "label")])


def test_stages_on_edge_rows(spark):
    docs = edge_rows(spark)
    before = Counter(map(str, docs.select(*pipeline.COLUMNS).collect()))
    clean = pipeline.drop_toxic(spark, docs, SMALL)
    assert clean.columns == pipeline.COLUMNS and not Counter(map(str, clean.collect())) - before
    lines = pipeline.drop_repeated_lines(spark, docs, SMALL)
    got = Counter((r["doc_id"], r["text"]) for r in lines.collect())
    assert lines.columns == pipeline.COLUMNS and sum(got.values()) == docs.count()
    assert got[1, docs.filter("doc_id = 1").first()["text"]] == 2 and got[3, None] == got[4, ""] == 1
    assert ("second" in next(t for i, t in got if i == 2)) and len(next(t for i, t in got if i == 2)) < 120
    single = pipeline.drop_near_copies(spark, docs, SMALL)
    got = Counter((r["doc_id"], r["text"]) for r in single.collect())
    assert single.columns == pipeline.COLUMNS and got[1, docs.filter("doc_id = 1").first()["text"]] == 1
    # 2 is near 1, and 6 near 5
    assert {i for i, _ in got} == {1, 3, 4, 5, 7, 8, None} and got[7, "one text"] == got[7, "another text"] == 1
    mixed = pipeline.mix_sources(spark, docs, SMALL)
    got = Counter((r["doc_id"], r["text"]) for r in mixed.collect())
    assert mixed.columns == pipeline.COLUMNS and got[3, None] == got[4, ""] == got[8, " \n "] == 1 and all(n <= 6 for n in got.values())
    tokens = pipeline.encode_tokens(spark, docs, SMALL).collect()
    assert len(tokens) == docs.count() and {r["n_tokens"] for r in tokens if r["doc_id"] in (3, 4)} == {0}
    for _, stage in pipeline.STAGES:
        assert stage(spark, docs.limit(0), SMALL).count() == 0
