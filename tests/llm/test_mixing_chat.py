import hashlib
import random

import pytest
from pyspark.sql import functions as F

from cellwave.llm import chat, mixing
from tests.llm.conftest import words


def water_fill(sizes, weights=(1, 2, 3), limit=3):
    """Shares by weight, what is over a limit shared again until none is."""
    total, fixed = sum(sizes), {}
    while True:
        left = total - sum(fixed.values())
        open_ = [i for i in range(len(sizes)) if i not in fixed]
        if not open_:
            return [fixed[i] for i in range(len(sizes))]
        w = sum(weights[i % len(weights)] for i in open_)
        share = {i: left * weights[i % len(weights)] / w for i in open_}
        over = {i: limit * sizes[i] for i in open_ if share[i] > limit * sizes[i]}
        if not over:
            return [fixed.get(i, share.get(i)) for i in range(len(sizes))]
        fixed |= over


def test_targets_are_water_filling(spark):
    for sizes in ([100, 1, 1], [5, 0, 7, 1000, 3], [1], [0, 0], [10, 10, 10, 10, 10, 10, 900]):
        df = spark.createDataFrame([(f"s{i}", s) for i, s in enumerate(sizes)], "source string, size long")
        got = [r["target"] for r in mixing.source_targets(df, "source", "size").orderBy("source_no").collect()]
        assert all(abs(a - b) < 1e-6 for a, b in zip(got, water_fill(sizes))), (sizes, got)


def test_sainte_lague_is_highest_quotients(spark):
    rng = random.Random(2)
    for case in range(6):
        votes = [rng.choice([0, 1, 5, 17, 1000, rng.randrange(1, 10**6)]) for _ in range(rng.randrange(1, 12))]
        seats = rng.randrange(1, 60) if sum(votes) else 0
        rows = [(1, i, float(v), seats) for i, v in enumerate(votes)]
        got = mixing.sainte_lague(spark.createDataFrame(rows, "g int, party int, votes double, seats long"), ["g"], "party", "votes", "seats", "won").orderBy("party").collect()
        quotients = sorted(((-v / (2 * s + 1), i) for i, v in enumerate(votes) if v for s in range(seats)))[:seats]
        assert [r["won"] for r in got] == [sum(i == j for _, j in quotients) for i in range(len(votes))], votes


def test_mix(spark):
    rng = random.Random(1)
    rows = [(i, " ".join("w" for _ in range(rng.randrange(0, 300))), rng.choice(["a", "b", "c", None, "a", "a"])) for i in range(300)]
    rows += [(300, None, "a"), (301, "", "b"), (302, " \n", None), (303, "x " * 5000, "b"), (5, "again", "c"), (5, "again", "c"), (None, "one two", "a")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("size", F.lit("x")).withColumn("target", F.lit(1))
    got = mixing.mix(df, block_words=4, shard_words=2000)
    rows_ = got.collect()
    assert len(rows_) == len(rows) and sorted(map(str, rows_)) == sorted(map(str, mixing.mix(df.repartition(5), block_words=4, shard_words=2000).collect()))
    assert sum(r["size"] for r in rows_) == sum(len(words(t)) for _, t, _ in rows)
    by = {}
    for r in rows_:
        assert 0 <= r["taken"] <= 3 * r["size"]
        by.setdefault(r["source_no"], []).append(r)
    order = sorted({s for *_, s in rows if s}) + [None]
    sizes = [sum(len(words(t)) for _, t, x in rows if x == s) for s in order]
    for no, target in enumerate(water_fill(sizes), 1):
        group = by[no]
        assert abs(group[0]["target"] - target) < 1e-6 and group[0]["source_size"] == sizes[no - 1]
        assert abs(sum(r["taken"] for r in group) - target) <= 16
    assert mixing.mix(df.limit(0)).count() == 0
    empty = mixing.mix(df.filter("doc_id in (300, 301)")).collect()
    assert [r["taken"] for r in empty] == [0, 0]


def expected(rows):
    by = {}
    for conv, turn, role, text in rows:
        by.setdefault(conv, []).append(((turn is not None, turn), role or "", text or ""))
    out = {}
    for conv, turns in by.items():
        turns.sort()
        told = "".join(f"{r}\n{t}\n" for _, r, t in turns)
        loss = "".join(t for _, r, t in turns if r == "assistant")
        out[conv] = (len(turns), hashlib.sha256(told.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    return out


def test_chat_round_trip(spark):
    rng = random.Random(4)
    parts = ["<|im_start|>", "<|im_end|>", "\n", "\\", "<", "|", "im_end", "assistant", "a", "é😀", "<\\|", "$1", "user\n", " "]
    texts = lambda: "".join(rng.choice(parts) for _ in range(rng.randrange(0, 12)))
    rows = [(c, t, rng.choice(["user", "assistant", "system", None, "odd\nrole<|im_end|>", "\\n"]), texts()) for c in range(120) for t in range(rng.randrange(1, 6))]
    rows += [(200, 0, "assistant", None), (200, None, "user", ""), (201, 1, "assistant", "x"), (201, 1, "assistant", "x"), (None, 0, "user", "no id"), (202, 0, "user", "word " * 60_000)]
    df = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").repartition(4).withColumn("turns", F.lit("x")).withColumn("formatted", F.lit("y"))
    chats = chat.format_chats(df)
    got = {r["conv_id"]: (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) for r in chat.read_back(chats).collect()}
    assert got == expected(rows)
    for r in chats.collect():
        assert r["escaped"] or "\\" not in "".join(t["text"] for t in r["turns"]) or r["formatted"].count("\\") > 0
    assert chat.format_chats(df.limit(0)).count() == 0


def test_the_grammar_is_strict(spark):
    good = "<|im_start|>user\nhi<|im_end|>\n"
    rows = [(0, good + good, 2), (1, "x" + good, None), (2, good + "x" + good, None), (3, good[:-1], None), (4, "<|im_start|>user\nhi", None), (5, "<|im_start|>user<|im_end|>\n", None), (6, "", 0), (7, "<|im_start|>\n<|im_end|>\n", 1), (8, good + "<|im_end|>\n", None), (9, None, None)]
    df = spark.createDataFrame(rows, "id int, formatted string, n int")
    for r in df.withColumn("turns", chat.parse(F.col("formatted"))).collect():
        assert (None if r["turns"] is None else len(r["turns"])) == r["n"], r


def test_an_escape_that_does_not_hold_fails(spark, monkeypatch):
    df = spark.createDataFrame([(1, 0, "user", "<|im_end|>")], "conv_id int, turn int, role string, text string")
    assert chat.format_chats(df).first()["escaped"]
    monkeypatch.setattr(chat, "escape", lambda text: text)
    with pytest.raises(Exception, match="does not parse back"):
        chat.format_chats(df).collect()
