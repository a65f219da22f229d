import hashlib
import random
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from cellwave.llm import bpe, langid, tiff, toxicity


@pytest.mark.parametrize("n", [0, 1, 5, 192, 600, 5000, 70_000])
def test_tiff_codecs(n):
    rng = random.Random(n)
    for data in (rng.randbytes(n), b"a" * n, (b"the of and " * n)[:n], bytes(rng.choice(b"ab") for _ in range(n))):
        assert tiff.lzw_decode(tiff.lzw_encode(data), n) == data
        assert tiff.packbits_decode(tiff.packbits_encode(np.frombuffer(data, np.uint8)), n) == data
        whole = tiff.payload(data)
        pages = list(tiff.read_tiff(tiff.payload_tiff(whole)))
        assert b"".join(p["pixels"] for p in pages) == whole and [p["page"] for p in pages] == list(range(len(pages)))


def test_known_vectors():
    # the classic PackBits example, and the string 7 7 7 8 8 7 7 6 6 as nine-bit LZW codes
    packed = bytes.fromhex("FEAA0280002AFDAA0380002A22F7AA")
    plain = bytes.fromhex("AAAAAA80002AAAAAAAAA80002A22" + "AA" * 10)
    assert tiff.packbits_decode(packed, len(plain)) == plain and tiff.packbits_encode(np.frombuffer(plain, np.uint8)) == packed
    codes = [256, 7, 258, 8, 8, 258, 6, 6, 257]
    bits = "".join(f"{c:09b}" for c in codes)
    coded = int(bits.ljust(-(-len(bits) // 8) * 8, "0"), 2).to_bytes(-(-len(bits) // 8), "big")
    text = bytes([7, 7, 7, 8, 8, 7, 7, 6, 6])
    assert tiff.lzw_decode(coded, 99) == text and tiff.lzw_encode(text) == coded


def test_later_pages_hold_long_lzw_strips():
    rng = random.Random(7)
    data = tiff.payload(rng.randbytes(40_000) + b"the of and " * 20_000)
    pages = list(tiff.read_tiff(tiff.payload_tiff(data)))
    assert {p["compression"] for p in pages[1:]} == {tiff.DEFLATE, tiff.PACKBITS, tiff.LZW}
    assert b"".join(p["pixels"] for p in pages) == data


def grey(fields, strip=b"\0" * 16):
    """A file of pages with the given fields (tag, kind, value) and one strip."""
    out, link = bytearray(struct.pack("<2sHI", b"II", 42, 0)) + strip, 4
    for page in fields:
        page = {273: (4, 8), 279: (4, len(strip)), 256: (4, 4), 257: (4, 4), 258: (3, 8), 259: (3, 1)} | page
        struct.pack_into("<I", out, link, len(out))
        out += struct.pack("<H", len(page)) + b"".join(struct.pack("<HHII", t, k, 1, v) for t, (k, v) in sorted(page.items()))
        link = len(out)
        out += b"\0\0\0\0"
    return bytes(out)


@pytest.mark.parametrize(
    "fields,strip",
    [
        ({256: (4, 1 << 20), 257: (4, 1 << 20)}, b"\0" * 16),  # larger than the file can hold
        ({256: (4, 1 << 20), 257: (4, 1 << 20), 259: (3, 8)}, zlib.compress(b"\0" * (1 << 24))),
        ({256: (4, 0)}, b"\0" * 16),
        ({322: (4, 0), 323: (4, 16), 324: (4, 8), 325: (4, 16)}, b"\0" * 16),
        ({278: (4, 0)}, b"\0" * 16),
        ({259: (3, 7)}, b"\0" * 16),
        ({258: (3, 1)}, b"\0" * 16),
        ({284: (3, 2)}, b"\0" * 16),
        ({317: (3, 3)}, b"\0" * 16),
        ({273: (4, 1 << 30)}, b"\0" * 16),
        ({259: (3, 5)}, b"\xff" * 16),
        ({259: (3, 8)}, b"no deflate here.."),
    ],
)
def test_broken_pages_are_rows(fields, strip):
    bad, good = list(tiff.read_tiff(grey([fields, {}], strip)))
    assert bad["error"] and bad["pixels"] is None and bad["page"] == 0
    assert good["error"] is None and good["pixels"] == strip[:16] and good["page"] == 1


def test_large_pages_and_bombs(monkeypatch):
    bomb = zlib.compress(b"\0" * (1 << 26))
    assert tiff.unpack(bomb, tiff.DEFLATE, 10) == b"\0" * 10
    monkeypatch.setattr(tiff.read_page, "__defaults__", (15,))
    assert "larger than 15 bytes" in next(tiff.read_tiff(grey([{}])))["error"]


@pytest.mark.parametrize("code, pack", [(1, bytes), (8, zlib.compress), (32773, lambda b: tiff.packbits_encode(np.frombuffer(b, np.uint8)))])
def test_reversed_bits_are_turned_round(code, pack):
    pixels = bytes(range(100, 116))
    reverse = bytes(int(f"{b:08b}"[::-1], 2) for b in pack(pixels))
    page, plain, unknown = tiff.read_tiff(grey([{259: (3, code), 266: (3, 2), 279: (4, len(reverse))}, {259: (3, code), 266: (3, 1)}, {266: (3, 3)}], reverse))
    assert page["error"] is None and page["pixels"] == pixels
    assert plain["pixels"] != pixels and "fill order 3" in unknown["error"]


def big_endian_rgb16():
    """A 2 x 3 page of 16-bit RGB, most significant byte first, with the horizontal predictor, in one deflate strip."""
    pixels = np.arange(18, dtype=np.uint16).reshape(2, 3, 3) * 3000
    rows = pixels.copy()
    rows[:, 1:] -= pixels[:, :-1]
    strip = zlib.compress(rows.astype(">u2").tobytes())
    head, at = b"MM" + struct.pack(">HI", 42, 8), 8
    fields = [(256, 3, 3), (257, 3, 2), (259, 3, 8), (262, 3, 2), (277, 3, 3), (278, 3, 2), (317, 3, 2)]
    entries = [struct.pack(">HHIHH", t, k, 1, v, 0) for t, k, v in fields]
    size = 2 + 12 * (len(fields) + 3) + 4
    entries.append(struct.pack(">HHII", 258, 3, 3, at + size))
    entries.append(struct.pack(">HHII", 273, 4, 1, at + size + 6))
    entries.append(struct.pack(">HHII", 279, 4, 1, len(strip)))
    entries.sort()
    return head + struct.pack(">H", len(entries)) + b"".join(entries) + struct.pack(">I", 8) + struct.pack(">HHH", 16, 16, 16) + strip, pixels


def test_tiff_pages(spark):
    other, pixels = big_endian_rgb16()  # its directory links to itself: one page
    good = tiff.payload_tiff(tiff.payload(b"x" * 2000))
    rows = [(1, good), (2, None), (3, b""), (4, b"II*\0garbage"), (5, other), (6, good[:300])]
    df = spark.createDataFrame(rows, "id int, media binary").withColumn("page", F.lit("clash"))
    got = {}
    for r in tiff.tiff_pages(df, keep=["id"]).collect():
        got.setdefault(r["id"], []).append(r)
    assert set(got) == {1, 3, 4, 5, 6} and len(got[1]) == 2 and all(got[i][-1]["error"] for i in (3, 4, 6))
    assert (got[5][0]["bits"], got[5][0]["samples"], bytes(got[5][0]["pixels"])) == (16, 3, pixels.astype("<u2").tobytes())
    assert tiff.tiff_pages(df.limit(0), keep=["id"]).count() == 0
    with pytest.raises(ValueError, match="page"):
        tiff.tiff_pages(df, keep=["page"])
    kept = tiff.tiff_pages(df.withColumnRenamed("page", "_0").withColumn("text", F.lit("t")), keep=["_0", "text", "id"]).filter("id = 5").first()
    assert (kept["_0"], kept["text"], kept["page"]) == ("clash", "t", 0)


def test_tiff_digest(docs_frame):
    rows = [(1, None), (2, ""), (3, "é" * 400), (4, "é" * 400), (5, "long " * 250_000), (None, "x")]
    out = tiff.tiff_pages(tiff.texts_to_tiff(docs_frame(rows)), fold=tiff.digest, fold_schema=tiff.DIGEST_SCHEMA, keep=["doc_id", "n_bytes"]).collect()
    assert len(out) == len(rows)
    for r in out:
        data = (dict(rows)[r["doc_id"]] or "").encode()
        whole = data + b"\xff" * (max(1, -(-len(data) // 576)) * 576 - len(data))
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(data), len(whole), hashlib.sha256(whole).hexdigest(), zlib.crc32(whole[-32:]))
    by = {r["doc_id"]: r for r in out}
    assert by[3]["media_sha256"] == by[4]["media_sha256"] and by[1]["feature"] == by[2]["feature"]


PHRASES = {"en": "the weather is fine and we are going to the market with them", "fr": "le temps est beau et nous allons au marché avec eux", "de": "das wetter ist schön und wir gehen mit ihnen auf den markt", "ru": "погода хорошая и мы идём с ними на рынок"}


def test_language(spark):
    rng = random.Random(1)
    rows = []
    for i in range(200):
        lang = rng.choice(list(PHRASES))
        w = PHRASES[lang].split()
        rng.shuffle(w)
        rows.append((i, " ".join(w * rng.randrange(1, 4)), lang))
    rows += [(500, None, "en"), (501, "123 !?", "fr"), (502, "", None), (503, "the market is fine", None), (504, "marché " * 170_000, None), (None, "das wetter", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("score", F.lit("x")).repartition(4)
    got = {r["doc_id"]: r for r in langid.identify(df, F.col("doc_id") % 5 != 0).collect()}
    assert len(got) == len(rows) and all(0 <= r["score"] <= 1 for r in got.values())
    assert [got[i]["lang_pred"] for i in (500, 501, 502)] == ["und"] * 3
    assert sum(got[i]["lang_pred"] == lang for i, _, lang in rows[:200] if i % 5 == 0) >= 39
    assert (got[503]["lang_pred"], got[504]["lang_pred"], got[None]["lang_pred"]) == ("en", "fr", "de")
    assert {r["lang_pred"] for r in langid.identify(df, F.lit(False)).collect()} == {"und"}
    assert langid.identify(df.limit(0), F.lit(True)).count() == 0


def test_language_is_plain_bundling(spark):
    rng, dims = random.Random(8), 64
    rows = [(i, " ".join(rng.sample(PHRASES[lang].split(), 5)), lang) for i, lang in enumerate(rng.choice(list(PHRASES)) for _ in range(80))]
    rows += [(100, "Ünder the 3 tables!", "en"), (101, "x", "de")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in langid.identify(df, F.col("doc_id") % 4 != 0, dims=dims).collect()}
    single = {c: np.random.default_rng([11, c]).choice(np.array([-1, 1], np.int8), size=dims) for c in {0, *map(ord, "".join(t for _, t, _ in rows).lower())}}

    def bundle(text):
        codes, total = [0, *[ord(c) if c.isalpha() else 0 for c in text.lower()], 0], np.zeros(dims)
        for a, b, c in zip(codes, codes[1:], codes[2:]):
            if b:
                total += np.roll(single[a], 2) * np.roll(single[b], 1) * single[c]
        return total / np.linalg.norm(total)

    sums = {}
    for i, text, lang in rows:
        if i % 4:
            sums[lang] = sums.get(lang, 0) + bundle(text)
    names = sorted(sums)
    unit = np.array([sums[x] / np.linalg.norm(sums[x]) for x in names])
    common = unit.mean(0)
    axes = unit - common
    for i, text, _ in rows:
        v = bundle(text)
        v = v - common * (v @ common) / (common @ common)
        cosines = axes @ v / np.linalg.norm(axes, axis=1) / np.linalg.norm(v)
        assert got[i][0] == names[int(np.argmax(cosines))] and abs(got[i][1] - (1 + cosines.max()) / 2) < 1e-4


def test_every_letter_has_a_vector_of_its_own():
    points = np.fromiter(map(ord, "abcdefghijklmnopqrstuvwxyzéèàäößñçíáжщ語"), np.uint32)
    space = langid.Letters(512, 11)
    slots = space.slots(points)
    drawn = space.vectors[slots].astype(int)
    near = np.abs(drawn @ drawn.T - 512 * np.eye(len(points), dtype=int)).max()
    assert near < 150 and len(set(space.slots(points))) == len(points) and set(space.slots(np.array([32, 51], np.uint32))) == {0}
    # the same vectors whatever was met before
    other = langid.Letters(512, 11)
    slots = other.slots(points[::-1].copy())
    assert (other.vectors[slots][::-1] == drawn).all()
    assert (langid.text_vector("kék", 64, 11) != langid.text_vector("kkk", 64, 11)).any()


def test_languages_of_a_dirty_column_are_bounded(spark):
    rows = [(i, "the market is fine", "en") for i in range(20)] + [(100 + i, "das wetter ist gut", "de") for i in range(10)] + [(1000 + i, "abc", f"x{i:05}") for i in range(10_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = langid.identify(df.repartition(4), F.lit(True), most_langs=3)
    assert {r["lang_pred"] for r in got.select("lang_pred").distinct().collect()} <= {"en", "de", "x00000"}
    assert {r["lang_pred"] for r in got.filter("doc_id < 20").collect()} == {"en"} and got.count() == len(rows)


def test_rare_languages_are_learned(spark):
    rows = [(i, PHRASES["en"], "en") for i in range(3000)] + [(4000 + i, PHRASES["fr"], "fr") for i in range(3)] + [(5000, "nous allons avec eux", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r["doc_id"]: r["lang_pred"] for r in langid.identify(df, F.lit(True), sample_rows=20).collect()}
    assert got[5000] == got[4001] == "fr" and got[7] == "en"


def labelled():
    rng = random.Random(2)
    plain = ["table", "garden", "music", "window", "coffee", "people", "river", "market"]
    docs, labels = [], []
    for i in range(400):
        w = [rng.choice(plain) for _ in range(12)]
        toxic = i % 4 == 0
        if toxic:
            w += [rng.choice(["grobling", "snarfer"])] + (["muslim"] if i % 8 == 0 else [])
        docs.append((i, " ".join(rng.sample(w, len(w)))))
        labels.append((i, int(toxic)))
    return docs, labels + [(0, 0), (900, 1), (None, 1), (3, None)]


def test_toxicity(spark, docs_frame):
    docs, labels = labelled()
    extra = [(1000, None), (1001, ""), (1002, "table " * 200_000 + "snarfer"), (None, "you grobling")]
    df, table = docs_frame(docs + extra), spark.createDataFrame(labels, "doc_id long, toxic int")
    models = {f: toxicity.learn(df.select("doc_id", "text"), table, fairness=f) for f in (0.0, 30.0)}
    got = {r["doc_id"]: r["score"] for r in toxicity.score(df, models[30.0], ["doc_id"]).collect()}
    assert len(got) == 404 and all(0 <= s <= 1 for s in got.values())
    assert all((got[i] >= 0.3) == (i % 4 == 0) for i in range(400)) and got[1002] >= 0.3 and got[None] >= 0.3 and got[1000] == got[1001] < 0.3
    # a neutral mention of a group counts for less with the penalty than without
    gap = {f: m.score("a muslim in the garden") - m.score("a christian in the garden") for f, m in models.items()}
    assert gap[0.0] > 0.01 and abs(gap[30.0]) < 0.5 * gap[0.0]
    assert toxicity.learn(df.select("doc_id", "text"), table.filter("toxic = 0")).score("snarfer") < 0.3
    assert toxicity.score(df.limit(0), models[0.0], ["doc_id"]).count() == 0


def test_penalty_at_its_default(spark, docs_frame):
    docs, labels = labelled()
    df, table = docs_frame(docs).select("doc_id", "text"), spark.createDataFrame(labels, "doc_id long, toxic int")
    gap = {f: m.score("a muslim in the garden") - m.score("a christian in the garden") for f, m in ((f, toxicity.learn(df, table, fairness=f)) for f in (0.0, 1.0))}
    assert gap[0.0] > 0.01 and abs(gap[1.0]) < 0.9 * gap[0.0]


def test_swapping():
    swap = toxicity.swaps((("women", "men"), ("frau", "mann")))
    told = toxicity.swapped("Women work. They work! Men\nwork; women too? Eine Frau, women", swap)
    assert told == {(("wome*", "women"), ("men",)): 2, (("men",), ("wome*", "women")): 1, (("frau", "wome*", "women"), ("mann", "men")): 1}
    assert not toxicity.swapped("they work", swap)
    with pytest.raises(ValueError):
        toxicity.swaps((("a", "b"), ("b", "c")))
    assert len(toxicity.swaps(toxicity.IDENTITY_PAIRS)) == 2 * len(toxicity.IDENTITY_PAIRS)


def test_training_is_a_plain_gradient_loop():
    rng = random.Random(9)
    rows = []
    for i in range(60):
        own = sorted(rng.sample(range(12), 4))
        changes = [([x for x in own if x < 3], [3 + own[0] % 3], 1 + i % 2)] if own[0] < 3 else []
        rows.append((own, changes, int(11 in own or (5 in own and i % 3 == 0)), 1.0 + i % 2))
    ridge, fairness, rounds = 0.5, 2.0, 80
    got_w, got_c = toxicity.train(rows, 12, ridge, fairness, rounds)
    total = sum(r[3] for r in rows)
    paid = sum(r[3] / total * n for r in rows for *_, n in r[1])
    base = sum(r[3] * r[2] for r in rows) / total
    w, c = [0.0] * 12, float(np.log(base / (1 - base)))
    first, second = [0.0] * 13, [0.0] * 13
    for t in range(1, rounds + 1):
        g = [ridge * x / len(rows) for x in w] + [0.0]
        for own, changes, y, weight in rows:
            error = weight / total * (1 / (1 + np.exp(-(c + sum(w[f] for f in own)))) - y)
            g[12] += error
            for f in own:
                g[f] += error
            for lost, gained, n in changes:
                pull = 2 * fairness * weight / total * n / paid * (sum(w[f] for f in lost) - sum(w[f] for f in gained))
                for f in lost:
                    g[f] += pull
                for f in gained:
                    g[f] -= pull
        for j in range(13):
            first[j], second[j] = 0.9 * first[j] + 0.1 * g[j], 0.999 * second[j] + 0.001 * g[j] ** 2
            step = 0.1 * first[j] / (1 - 0.9**t) / (np.sqrt(second[j] / (1 - 0.999**t)) + 1e-8)
            if j < 12:
                w[j] -= step
            else:
                c -= step
    assert np.abs(got_w - w).max() < 1e-9 and abs(got_c - c) < 1e-9


def test_kept_columns_may_have_any_name(docs_frame):
    df = docs_frame([(1, "a b"), (None, None)]).withColumn("_0", F.lit(7))
    out = toxicity.score(df, toxicity.Model({"a": 1.0}, 0.0), ["_text", "_0", "doc_id", "text"]).collect()
    assert sorted(tuple(r)[:2] for r in out) == [("x", 7)] * 2 and {r["text"] for r in out} == {"a b", None}
    path = bpe.default_tokenizer()
    made = bpe.encode(df, path, bpe.Lexicon.compile({}).pack(), ["_text", "_0", "text"])
    assert {tuple(r)[:2] for r in made.collect()} == {("x", 7)}
    assert {r["_text"] for r in bpe.decode(made.drop("text"), path, ["_text", "_0"]).collect()} == {"x"}


def test_held_out_rows_teach_nothing(spark, docs_frame):
    docs, labels = labelled()
    keep = [x for x in labels if x[0] is not None and zlib.crc32(str(x[0]).encode()) % 4 != 2]
    rows = spark.createDataFrame(labels, "doc_id long, toxic int").filter(~toxicity.held_out(F.col("doc_id"))).collect()
    assert sorted(r["doc_id"] for r in rows if r["doc_id"] is not None) == sorted(x[0] for x in keep)


def test_unlike_tokenizers_are_refused():
    spec = {"model": {"type": "BPE"}, "normalizer": None, "pre_tokenizer": {"type": "ByteLevel", "add_prefix_space": False}, "added_tokens": [], "decoder": {"type": "ByteLevel"}}
    bpe.check_kind(spec)
    for change in ({"normalizer": {"type": "NFC"}}, {"pre_tokenizer": {"type": "Whitespace"}}, {"pre_tokenizer": None}, {"model": {"type": "BPE", "dropout": 0.1}}, {"model": {"type": "Unigram"}}, {"added_tokens": [{"content": "x", "lstrip": True}]}, {"decoder": None}):
        with pytest.raises(ValueError, match="not supported"):
            bpe.check_kind(spec | change)


@pytest.fixture(scope="module")
def tokenizer():
    tokenizers = pytest.importorskip("tokenizers")
    return tokenizers.Tokenizer.from_file(bpe.default_tokenizer())


def test_lexicon():
    words = sorted({"".join(random.Random(i).choices("abcé", k=i % 7 + 1)).encode() for i in range(300)})
    entries = {w: [i, i + 1][: i % 2 + 1] for i, w in enumerate(words)}
    lexicon = bpe.Lexicon.map(bpe.Lexicon.compile(entries).pack())
    assert lexicon.find(words).tolist() == list(range(len(words)))
    assert lexicon.find([b"", b"zz", words[0] + b"zzz", words[5][:-1] + b"\xff"]).tolist() == [-1] * 4
    assert [lexicon.ids[a:b].tolist() for a, b in zip(lexicon.offsets[:-1], lexicon.offsets[1:])] == [entries[w] for w in words]
    assert len(lexicon.finals) < sum(map(len, words)) and bpe.Lexicon.compile({}).find([b"a", b""]).tolist() == [-1, -1]


def test_encoding_is_the_tokenizers(tokenizer):
    rules = bpe.merger(bpe.default_tokenizer())
    lexicon = bpe.Lexicon.compile({w.encode(): rules.merge(w.encode()) for w in ("the", " the", " of", "ing")})
    coder, rng = bpe.Coder(bpe.default_tokenizer(), bpe.Lexicon.map(lexicon.pack()), remembered=50), random.Random(3)
    letters = [*"abcthe \n\t\r'sdé中  \x1c\x85​😀12²Ⅷ_.,!?<|>", "<|endoftext|>", " the", " of", "'ll", "\x00"]
    texts = ["".join(rng.choice(letters) for _ in range(rng.randrange(30))) for _ in range(3000)] + ["", "ab" * 5000 + "the" * 3000]
    ids, upto = coder.encode(texts)
    for text, a, b in zip(texts, upto[:-1], upto[1:]):
        wanted = tokenizer.encode(text, add_special_tokens=False).ids
        assert ids[a:b].tolist() == wanted, text
        assert coder.decode(ids[a:b]).decode() == tokenizer.decode(wanted, skip_special_tokens=False)


def test_round_trip(docs_frame, tokenizer):
    path = bpe.default_tokenizer()
    rows = [(1, "The cat sat on the mat."), (2, None), (3, ""), (4, "é<|endoftext|>é"), (4, "é<|endoftext|>é"), (None, "no id"), (6, "word " * 700_000)]
    df = docs_frame(rows)
    packed = bpe.build_lexicon(df, path, words=3)
    out = bpe.round_trip(df, path, packed, ["doc_id"]).collect()
    assert len(out) == len(rows)
    for r in out:
        text = dict(rows)[r["doc_id"]] or ""
        ids = tokenizer.encode(text, add_special_tokens=False).ids
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest())
    back = bpe.decode(bpe.encode(df, path, packed, ["doc_id"]), path, ["doc_id"]).collect()
    assert sorted((str(r["doc_id"]), r["text"]) for r in back) == sorted((str(i), t or "") for i, t in rows)
    assert bpe.round_trip(df.limit(0), path, bpe.build_lexicon(df.limit(0), path), ["doc_id"]).count() == 0


def test_rows_of_one_labelled_id_are_bounded(docs_frame, spark, monkeypatch):
    seen, real = [], toxicity.train
    monkeypatch.setattr(toxicity, "train", lambda rows, n, **k: seen.append(rows) or real(rows, n, rounds=3))
    sentences = ". ".join(f"she met {i} {'the old' * (i % 2)} men" for i in range(400))
    docs = docs_frame([(1, f"you fool number {i}") for i in range(500)] + [(2, sentences)])
    toxicity.learn(docs, spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, toxic int"), sample_rows=100, least=1, most_swaps=2)
    assert len(seen[0]) <= 200 and max(len(r[1]) for r in seen[0]) <= 2


def test_long_words_are_not_collected(docs_frame):
    path = bpe.default_tokenizer()
    docs = docs_frame([(i, "b" * (1 << 20) + " the the cat") for i in range(4)])
    assert all(len(w) < bpe.LONG_WORD for w in bpe.frequent_words(docs, path, 1 << 18)) and " the" in bpe.frequent_words(docs, path, 1 << 18)
