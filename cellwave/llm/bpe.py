"""Byte-level BPE encoding and decoding with a transducer lexicon.

The corpus's most frequent words, with the ids they encode to, are compiled
into a minimal acyclic automaton whose equal suffixes are shared and whose arcs
carry numbers that add up to a word's place in the id table. The automaton is a
few flat arrays of bounded size, which every worker maps into memory from an
unnamed file of its own, filled from a broadcast. The words
of a batch walk it together; a word that is not in it is merged by the
tokenizer's rules, exactly. Words come from the tokenizer's own splitting
pattern, so the ids are those of the tokenizer.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import os
import re
import tempfile
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellwave.llm.arrow import map_column, steps
from cellwave.llm.store import cut

#: The splitting pattern of byte-level BPE (fixed value).
SPLIT = regex.compile(r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")

#: The same for texts of nothing but the characters of PLAIN_TEXT, which need no tables of character classes.
_LETTERS = "A-Za-zÀ-ÖØ-öø-ɏ"
PLAIN_SPLIT = re.compile(rf"'(?:[sdmt]|ll|ve|re)| ?[{_LETTERS}]+| ?[0-9]+| ?[^\t-\r {_LETTERS}0-9]+|[\t-\r ]+(?![^\t-\r ])|[\t-\r ]+")
OTHER_TEXT = re.compile(rf"[^\x00-\x7f{_LETTERS}]")

#: Bytes of text whose words are looked up together: the more, the fewer words are looked up twice.
WORDS_STEP = 3 << 20

#: Bits of an id where two go in one number, and what stands for no rule.
WIDTH = 24
MASK, NO_RULE = (1 << WIDTH) - 1, 1 << 62


def byte_letters() -> dict[int, str]:
    """The printable letter that stands for each byte in a byte-level vocabulary: itself if printable, else the next free one from 256 on."""
    plain = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


def check_kind(spec: dict) -> None:
    """Raises unless a tokenizer file is one whose rules are known here: byte-level BPE with the usual splitting pattern and plain added tokens."""
    model, split, added = spec["model"], spec.get("pre_tokenizer") or {}, spec["added_tokens"]
    unlike = [
        *(f"model {k} {model[k]!r}" for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges") if model.get(k)),
        *([f"model type {model.get('type')!r}"] if model.get("type", "BPE") != "BPE" else []),
        *([f"normalizer {spec['normalizer']!r}"] if spec.get("normalizer") else []),
        *([f"pre_tokenizer {split!r}"] if split.get("type") != "ByteLevel" or split.get("add_prefix_space") or not split.get("use_regex", True) else []),
        *(f"added token {t['content']!r}" for t in added if any(t.get(k) for k in ("single_word", "lstrip", "rstrip"))),
        *([f"decoder {spec['decoder']!r}"] if (spec.get("decoder") or {}).get("type") != "ByteLevel" else []),
    ]
    if unlike:
        raise ValueError("this tokenizer is not supported: " + "; ".join(unlike))


class Merger:
    """A tokenizer file's vocabulary and merge rules."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        check_kind(spec)
        vocab = spec["model"]["vocab"]
        letters = byte_letters()
        byte_of = {c: b for b, c in letters.items()}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special_pattern = regex.compile("(" + "|".join(regex.escape(s) for s in sorted(self.special, key=len, reverse=True)) + ")") if self.special else None
        self.start = [vocab[letters[b]] for b in range(256)]
        pairs = (m if isinstance(m, list) else m.split(" ", 1) for m in spec["model"]["merges"])
        # a pair's rank and what it becomes in one number, by the pair in one number
        self.rules = {vocab[a] << WIDTH | vocab[b]: rank << WIDTH | vocab[a + b] for rank, (a, b) in enumerate(pairs)}
        size = max([*vocab.values(), *self.special.values()]) + 1
        spelt = [b""] * size
        for token, i in vocab.items():
            spelt[i] = bytes(byte_of[c] for c in token) if all(c in byte_of for c in token) else token.encode()
        for token, i in self.special.items():
            spelt[i] = token.encode()
        self.offsets = np.concatenate(([0], np.cumsum([len(x) for x in spelt]))).astype(np.int64)
        self.spelt = np.frombuffer(b"".join(spelt), np.uint8)

    def merge(self, word: bytes) -> list[int]:
        ids, rule = [self.start[b] for b in word], self.rules.get
        if len(ids) > 48:
            return self.merge_long(ids)
        ranks = [rule(a << WIDTH | b, NO_RULE) for a, b in zip(ids, ids[1:])]
        while ranks and (best := min(ranks)) != NO_RULE:
            at = ranks.index(best)
            ids[at] = best & MASK
            del ids[at + 1], ranks[at]
            if at < len(ranks):
                ranks[at] = rule(ids[at] << WIDTH | ids[at + 1], NO_RULE)
            if at:
                ranks[at - 1] = rule(ids[at - 1] << WIDTH | ids[at], NO_RULE)
        return ids

    def merge_long(self, ids: list[int]) -> list[int]:
        """The same with a heap of pairs over a linked list."""
        rules, n = self.rules, len(ids)
        before, after = list(range(-1, n - 1)), [*range(1, n), -1]
        heap = [(r, i, ids[i], ids[i + 1]) for i in range(n - 1) if (r := rules.get(ids[i] << WIDTH | ids[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            r, i, a, b = heapq.heappop(heap)
            j = after[i]
            if ids[i] != a or j < 0 or ids[j] != b:
                continue
            ids[i], ids[j], after[i] = r & MASK, -1, after[j]
            if after[j] >= 0:
                before[after[j]] = i
            for x, y in ((before[i], i), (i, after[i])):
                if x >= 0 and y >= 0 and (r := rules.get(ids[x] << WIDTH | ids[y])) is not None:
                    heapq.heappush(heap, (r, x, ids[x], ids[y]))
        return [x for x in ids if x >= 0]


@lru_cache(maxsize=4)
def merger(path: str) -> Merger:
    return Merger(path)


class Lexicon:
    """A minimal acyclic automaton over byte strings; a word's arcs add up to its number in sorted order, its place in the id table."""

    PARTS = (("arcs", np.int64), ("targets", np.int32), ("adds", np.int32), ("finals", np.uint8), ("offsets", np.int32), ("ids", np.uint32))

    def __init__(self, **parts: np.ndarray):
        self.__dict__.update(parts)

    @classmethod
    def compile(cls, entries: dict[bytes, list[int]]) -> Lexicon:
        words = sorted(entries)
        register: dict[tuple, int] = {}
        kept: list[tuple[bool, list[tuple[int, int]]]] = []
        # the path of the last word: for each state its final flag and finished arcs
        path: list[list] = [[False, []]]

        def close(to: int) -> None:
            """Finished states leave the path for the register, where an equal one may be already."""
            while len(path) > to + 1:
                final, arcs = path.pop()
                key = (final, tuple(arcs))
                if key not in register:
                    register[key] = len(kept)
                    kept.append((final, arcs))
                path[-1][1][-1] = (path[-1][1][-1][0], register[key])

        last = b""
        for word in words:
            common = len(os.path.commonprefix((last, word)))
            close(common)
            for b in word[common:]:
                path[-1][1].append((b, -1))
                path.append([False, []])
            path[-1][0] = True
            last = word
        close(0)
        kept.append((path[0][0], path[0][1]))
        below = [0] * len(kept)
        arcs, targets, adds = [], [], []
        for s, (final, out) in enumerate(kept):  # targets come before the states that lead to them
            n = int(final)
            for b, t in out:
                arcs.append(s * 256 + b)
                targets.append(t)
                adds.append(n)
                n += below[t]
            below[s] = n
        ids = [entries[w] for w in words]
        return cls(
            arcs=np.array(arcs, np.int64), targets=np.array(targets, np.int32), adds=np.array(adds, np.int32), finals=np.array([f for f, _ in kept], np.uint8),
            offsets=np.concatenate(([0], np.cumsum([len(x) for x in ids]))).astype(np.int32), ids=np.array([i for x in ids for i in x], np.uint32),
        )

    def pack(self) -> bytes:
        head = np.array([len(getattr(self, n)) for n, _ in self.PARTS], np.int64).tobytes()
        return head + b"".join((raw := getattr(self, n).astype(t).tobytes()) + b"\0" * (-len(raw) % 8) for n, t in self.PARTS)

    @classmethod
    def map(cls, packed: bytes) -> Lexicon:
        """Maps a packed lexicon from a file of its own, which has no name any more once mapped."""
        with tempfile.NamedTemporaryFile() as f:
            f.write(packed)
            f.flush()
            whole = np.memmap(f.name, np.uint8, mode="r")
        sizes, at, parts = whole[: 8 * len(cls.PARTS)].view(np.int64), 8 * len(cls.PARTS), {}
        for n, (name, kind) in zip(sizes.tolist(), cls.PARTS):
            length = n * np.dtype(kind).itemsize
            parts[name] = whole[at : at + length].view(kind)
            at += length + -length % 8
        return cls(**parts)

    def find(self, words: list[bytes]) -> np.ndarray:
        """The words' numbers, -1 where one is not in the lexicon; all words take a step at a time."""
        lengths = np.fromiter((len(w) for w in words), np.int64, len(words))
        begin = np.cumsum(lengths) - lengths
        data = np.frombuffer(b"".join(words), np.uint8)
        number = np.zeros(len(words), np.int64)
        state = np.full(len(words), len(self.finals) - 1, np.int64)
        live = np.arange(len(words))
        out = np.full(len(words), -1, np.int64)
        step = 0
        while len(live) and len(self.arcs):
            ended = lengths[live] == step
            at_end = live[ended]
            good = self.finals[state[at_end]] == 1
            out[at_end[good]] = number[at_end[good]]
            live = live[~ended]
            if not len(live):
                break
            key = state[live] * 256 + data[begin[live] + step]
            at = np.minimum(np.searchsorted(self.arcs, key), len(self.arcs) - 1)
            hit = self.arcs[at] == key
            live, at = live[hit], at[hit]
            state[live] = self.targets[at]
            number[live] += self.adds[at]
            step += 1
        return out


def gather(flat: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The runs of ``flat`` that begin at ``starts``, one after the other."""
    ends = np.cumsum(lengths)
    if not len(ends) or not ends[-1]:
        return flat[:0]
    return flat[np.repeat(starts - (ends - lengths), lengths) + np.arange(ends[-1])]


class Coder:
    """Encodes and decodes batches of texts."""

    def __init__(self, path: str, lexicon: Lexicon, remembered: int = 1 << 17):
        self.rules, self.lexicon, self.remembered = merger(path), lexicon, remembered
        self.memory: dict[str, list[int]] = {}

    def words(self, text: str) -> list[str]:
        return split_words(text, self.rules)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after the other, and where each text's begin (one more than texts)."""
        words: list[str] = []
        ends = [0]
        for t in texts:
            words += self.words(t)
            ends.append(len(words))
        if not words:
            return np.zeros(0, np.uint32), np.zeros(len(ends), np.int64)
        place = {w: i for i, w in enumerate(dict.fromkeys(words))}
        codes, distinct = np.fromiter(map(place.__getitem__, words), np.int64, len(words)), list(place)
        numbers = self.lexicon.find([w.encode() for w in distinct])
        lengths = np.where(numbers >= 0, np.diff(self.lexicon.offsets)[numbers] if len(self.lexicon.offsets) > 1 else 0, 0).astype(np.int64)
        starts = np.where(numbers >= 0, self.lexicon.offsets[numbers], 0).astype(np.int64)
        more: list[int] = []
        base = len(self.lexicon.ids)
        special, memory = self.rules.special, self.memory
        for i in np.flatnonzero(numbers < 0):
            w = distinct[i]
            ids = memory.get(w)
            if ids is None:
                ids = [special[w]] if w in special else self.rules.merge(w.encode())
                if len(memory) >= self.remembered:
                    memory.clear()
                if len(w) < 64:
                    memory[w] = ids
            starts[i], lengths[i] = base + len(more), len(ids)
            more += ids
        flat = np.concatenate((self.lexicon.ids, np.array(more, np.uint32)))
        per_word = lengths[codes]
        ids = gather(flat, starts[codes], per_word)
        upto = np.concatenate(([0], np.cumsum(per_word)))
        return ids, upto[np.array(ends)]

    def decode(self, ids: np.ndarray) -> bytes:
        """The bytes of a run of ids; bytes that are no UTF-8 become U+FFFD."""
        offsets = self.rules.offsets
        raw = gather(self.rules.spelt, offsets[ids], offsets[ids.astype(np.int64) + 1] - offsets[ids]).tobytes()
        return raw.decode("utf-8", "replace").encode()


def split_words(text: str, rules: Merger) -> list[str]:
    """A text's words by the splitting pattern; a special token is a word of its own."""
    split = SPLIT.findall if OTHER_TEXT.search(text) else PLAIN_SPLIT.findall
    if rules.special_pattern and any(s in text for s in rules.special):
        parts = rules.special_pattern.split(text)
        return [w for i, p in enumerate(parts) for w in ([p] if i % 2 else split(p))]
    return split(text)


#: Words of the lexicon are shorter than this; longer ones are merged where they occur.
LONG_WORD = 256


def frequent_words(docs: DataFrame, path: str, n: int, text: str = "text", most: int = 1 << 18) -> list[str]:
    """At most ``n`` words of fewer than LONG_WORD characters: those of all texts that occur most often, down to the count at which there would be more; special tokens are none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rules, counts = merger(path), Counter()

        def told() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], names=["word", "n"])

        for batch in steps(batches):
            for t in batch.column(0).to_pylist():
                counts.update(split_words(t or "", rules))
            if len(counts) > most:
                yield told()
                counts.clear()
        if counts:
            yield told()

    counted = docs.select(F.col(text).alias("text")).mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    # a word that occurs once is no frequent one; special tokens are words of their own already
    counted = cut(counted.filter(~F.col("word").isin(list(merger(path).special)) & (F.col("n") > 1) & (F.length("word") < LONG_WORD)), "words")
    # counts by size, the larger ones in steps of an eightieth, so that their table has a few thousand rows at most
    level = F.when(F.col("n") < 1024, F.col("n")).otherwise(F.floor(F.log2("n") * 64) - 640 + 1024)
    upto, least = 0, None
    for r in counted.groupBy(level.alias("level")).count().orderBy(F.col("level").desc()).collect():
        upto += r["count"]
        if upto > n:
            break
        least = r["level"]
    if least is None:
        return []
    return [r["word"] for r in counted.filter(level >= least).select("word").collect()]


def build_lexicon(docs: DataFrame, path: str, words: int = 1 << 18, text: str = "text") -> bytes:
    """A packed lexicon of the corpus's most frequent words; its size is bounded by ``words``."""
    rules = merger(path)
    return Lexicon.compile({w.encode(): rules.merge(w.encode()) for w in frequent_words(docs, path, words, text)}).pack()


_coders: dict[tuple[str, str], Coder] = {}


def worker_coder(path: str, packed: bytes) -> Coder:
    key = (path, hashlib.sha256(packed).hexdigest())
    if key not in _coders:
        _coders.clear()
        _coders[key] = Coder(path, Lexicon.map(packed))
    return _coders[key]


def _map(docs: DataFrame, path: str, packed: bytes, keep: list[str], text: str, fields: list[tuple[str, str]], make) -> DataFrame:
    """``make`` maps (coder, texts) to columns; the lexicon, of bounded size, is broadcast."""
    shared = docs.sparkSession.sparkContext.broadcast(packed)

    def made(texts: pa.Array) -> list:
        return make(worker_coder(path, shared.value), texts.to_pylist())

    return map_column(docs, keep, F.coalesce(F.col(text), F.lit("")), fields, made, WORDS_STEP)


def lists(ids: np.ndarray, upto: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(upto, pa.int32()), pa.array(ids.astype(np.int32)))


def digests(values) -> pa.Array:
    return pa.array([hashlib.sha256(x).hexdigest() for x in values], pa.string())


def encode(docs: DataFrame, path: str, packed: bytes, keep: list[str], text: str = "text") -> DataFrame:
    """The columns ``keep`` and ids (array<int>) of every whole text; null is an empty text, which has no ids."""
    return _map(docs, path, packed, keep, text, [("ids", "array<int>")], lambda coder, texts: [lists(*coder.encode(texts))])


def encode_checked(docs: DataFrame, path: str, packed: bytes, keep: list[str], text: str = "text") -> DataFrame:
    """As ``encode``, with decoded_sha256: the digest of what the ids decode to, which is that of the text."""

    def make(coder: Coder, texts: list[str]) -> list:
        ids, upto = coder.encode(texts)
        return [lists(ids, upto), digests(coder.decode(ids[a:b]) for a, b in zip(upto[:-1], upto[1:]))]

    return _map(docs, path, packed, keep, text, [("ids", "array<int>"), ("decoded_sha256", "string")], make)


def decode(rows: DataFrame, path: str, keep: list[str], ids: str = "ids") -> DataFrame:
    """The columns ``keep`` and text of ids (array<int>); null ids give an empty text. ``keep`` must not hold text."""
    kept = [f"_{i}" for i in range(len(keep))]
    picked = rows.select(*[F.col(f"`{c}`").alias(k) for c, k in zip(keep, kept)], F.col(ids).alias("ids"))
    schema = "".join(f"`{k}` {picked.schema[k].dataType.simpleString()}, " for k in kept)
    empty = Lexicon.compile({})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Coder(path, empty)
        for batch in batches:
            made = [coder.decode(np.array(x or [], np.int64)).decode() for x in batch.column(len(keep)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(made, pa.string())], names=[*kept, "text"])

    return picked.mapInArrow(run, f"{schema}text string").select(*[F.col(k).alias(c) for c, k in zip(keep, kept)], "text")


def round_trip(docs: DataFrame, path: str, packed: bytes, keep: list[str], text: str = "text") -> DataFrame:
    """Encodes every whole text and decodes its ids again: the columns ``keep``, n_tokens and the digests of ids and decoded text.

    A null text is an empty one, which has no ids. Repeated rows are rows like
    others, and an empty table gives no rows. ``keep`` must not hold the names
    returned; other columns are not read.
    """

    def make(coder: Coder, texts: list[str]) -> list:
        ids, upto = coder.encode(texts)
        runs = [ids[a:b] for a, b in zip(upto[:-1], upto[1:])]
        return [pa.array([len(r) for r in runs], pa.int64()), digests(r.astype("<u4").tobytes() for r in runs), digests(coder.decode(r) for r in runs)]

    return _map(docs, path, packed, keep, text, [("n_tokens", "long"), ("ids_sha256", "string"), ("decoded_sha256", "string")], make)


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op5_bpe_round_trip(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    path = default_tokenizer()
    return round_trip(docs, path, build_lexicon(docs, path), ["doc_id"])
