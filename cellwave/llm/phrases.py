"""Phrases whose words occur together more often than apart, by Rabin-Karp fingerprints.

Every word n-gram has a fingerprint, taken from prefix polynomials over the
hashes of its words, which are themselves polynomials over bytes. Fingerprints
only say what may be frequent: they are counted first, those of words, of pairs
of frequent words, then of longer phrases of frequent pairs, and those that are
frequent set bits of a map of fixed size. Then the texts are read once more; what the map lets
through is grouped by fingerprint, each occurrence is compared with the first
one of its group, to whose place the group points, and only such phrases become
text. What the shuffle adds up then has the text for a key, so that a count
never rests on a hash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cellwave.llm.arrow import steps
from cellwave.llm.shingles import BASE, INVERSE, U64, mix, powers, prefix_hashes, span_hashes
from cellwave.llm.store import cut

#: A to Z to lower case and tabs to blanks; then what a byte is: part of a word, a blank, the end of a piece.
PLAIN = np.arange(256, dtype=np.uint8)
PLAIN[65:91] += 32
PLAIN[9] = 32
KIND = np.zeros(256, np.uint8)
KIND[32] = 1
KIND[[*b".,;:!?", 10, 11, 12, 13]] = 2

#: Words of the longest phrases, and bytes of text that are looked at together.
LONGEST, BYTES = 4, 1 << 20
#: Tasks a core that a scan keeps, and parts of the input that one takes at most: larger tasks add up more before they shuffle.
TASKS_A_CORE, PARTS_A_TASK = 3, 4


class Words:
    """The words of some texts and the fingerprints of their n-grams; ``langs`` has the language of each text."""

    def __init__(self, texts: list[bytes], langs: list[str]):
        self.data = PLAIN[np.frombuffer(b"\n".join(texts), np.uint8)]
        kind = KIND[self.data]
        inside = np.zeros(len(kind) + 2, bool)
        inside[1:-1] = kind == 0
        self.begin, self.end = np.flatnonzero(inside[1:-1] & ~inside[:-2]), np.flatnonzero(inside[1:-1] & ~inside[2:]) + 1
        n = len(self.begin)
        self.piece = np.cumsum(kind == 2)[self.begin] if n else self.begin
        text_ends = np.cumsum([len(t) + 1 for t in texts])
        self.text = np.searchsorted(text_ends, self.begin, side="right")
        self.langs = langs
        names = {x: int.from_bytes(hashlib.blake2b(x.encode(), digest_size=8).digest(), "little") for x in set(langs)}
        self.seed = np.array([names[x] for x in langs], U64)[self.text] if n else np.zeros(0, U64)
        self.word = mix(span_hashes(prefix_hashes(self.data), self.begin, self.end))
        self.sums = np.zeros(n + 1, U64)
        np.cumsum(self.word * powers(BASE, n), out=self.sums[1:])

    def places(self, n: int) -> np.ndarray:
        """Where the n-grams begin that lie in one piece."""
        at = np.arange(max(0, len(self.begin) - n + 1))
        return at[self.piece[at] == self.piece[at + n - 1]]

    def prints(self, at: np.ndarray, n: int) -> np.ndarray:
        """Fingerprints of the n-grams at ``at``, different for each length and language."""
        plain = (self.sums[at + n] - self.sums[at]) * powers(INVERSE, len(self.sums))[at]
        return mix(plain + mix(self.seed[at] + U64(n)))

    def exact(self) -> np.ndarray:
        """A number for each word, the same for the same bytes only."""
        _, first, number = np.unique(self.word, return_index=True, return_inverse=True)
        size = self.end - self.begin
        twin = first[number]
        unlike = size != size[twin]
        alike = np.flatnonzero(~unlike)
        starts = np.cumsum(size[alike]) - size[alike]
        inner = np.arange(int(size[alike].sum())) - np.repeat(starts, size[alike])
        same = self.data[np.repeat(self.begin[alike], size[alike]) + inner] == self.data[np.repeat(self.begin[twin[alike]], size[alike]) + inner]
        if len(alike):
            unlike[alike] = ~np.logical_and.reduceat(same, starts)
        if unlike.any():  # a collision: numbers of their own
            raw, more = self.data.tobytes(), {}
            for i in np.flatnonzero(unlike).tolist():
                number[i] = len(first) + more.setdefault(raw[self.begin[i] : self.end[i]], len(more))
        return number

    def frequent(self, n: int, ids: np.ndarray, passes) -> tuple[np.ndarray, np.ndarray]:
        """Of the n-grams that the map lets through, where each first occurs and how often; ``ids`` are those of ``exact``.

        An occurrence that has a group's fingerprint and not its words stands by
        itself, as often as it occurs: who adds up the counts does so by text.
        """
        at = self.places(n)
        prints = self.prints(at, n)
        passed = passes(prints)
        at, prints = at[passed], prints[passed]
        _, first, group = np.unique(prints, return_index=True, return_inverse=True)
        pointer = at[first]
        same = self.seed[at] == self.seed[pointer[group]]
        for k in range(n):
            same &= ids[at + k] == ids[pointer[group] + k]
        counts, lone = np.bincount(group[same], minlength=len(pointer)), at[~same]
        return np.concatenate((pointer, lone)), np.concatenate((counts, np.ones(len(lone), np.int64)))

    def phrase(self, raw: bytes, i: int, n: int) -> bytes:
        begin, end = self.begin, self.end
        return b" ".join(raw[a:b] for a, b in zip(begin[i : i + n].tolist(), end[i : i + n].tolist()))


class Frequent:
    """A map of 2 ** ``bits`` bits that lets all frequent fingerprints through, and others by chance; its size does not depend on the data."""

    def __init__(self, bits: int, blocks: np.ndarray | None = None):
        self.bits, self.blocks = bits, np.zeros(1 << (bits - 6), U64) if blocks is None else blocks

    def __call__(self, prints: np.ndarray) -> np.ndarray:
        bit = prints >> U64(64 - self.bits)
        return (self.blocks[(bit >> U64(6)).astype(np.int64)] >> (bit & U64(63))) & U64(1) > 0

    def with_frequent(self, counted: DataFrame, least: int) -> Frequent:
        """This map with the fingerprints (fp, n) that are counted ``least`` times; 2 ** (bits - 6) rows at most reach the driver."""
        often = counted.groupBy("fp").agg(F.sum("n").alias("n")).filter(F.col("n") >= least)
        bit = F.shiftrightunsigned("fp", 32 - self.bits)
        mask = F.call_function("shiftleft", F.lit(1).cast("long"), bit.bitwiseAND(F.lit(63)).cast("int"))
        blocks = often.select(F.shiftrightunsigned(bit, 6).alias("block"), mask.alias("mask"))
        table = blocks.groupBy("block").agg(F.bit_or("mask").alias("mask")).toArrow()
        made = self.blocks.copy()
        made[table.column("block").to_numpy()] |= table.column("mask").to_numpy().view(U64)
        return Frequent(self.bits, made)


def words_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, Words]]:
    """Steps of the rows (doc_id, lang, text) by id, null ids last, so that what comes first has the least id, and their words."""
    for step in steps(batches, most=BYTES):
        batch = step.take(pc.sort_indices(step.column(0)))
        yield batch, Words(batch.column(2).cast(pa.binary()).to_pylist(), batch.column(1).to_pylist())


def counted_prints(rows: DataFrame, sizes: tuple[int, ...], inner: int = 0, frequent: Frequent | None = None) -> DataFrame:
    """fp (its first 32 bits), n: fingerprints of the n-grams of the given sizes and how often a part of the texts has them; of those only whose ``inner``-grams the map lets through."""
    shared = rows.sparkSession.sparkContext.broadcast(frequent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, w in words_of(batches):
            found = []
            if inner:
                at = w.places(inner)
                good = np.zeros(len(w.begin), bool)
                good[at] = shared.value(w.prints(at, inner))
            for n in sizes:
                at = w.places(n)
                for k in range(n - inner + 1 if inner else 0):
                    at = at[good[at + k]]
                found.append(w.prints(at, n))
            prints, n = np.unique((np.concatenate(found) >> U64(32)).astype(np.uint32), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(prints.view(np.int32)), pa.array(n)], names=["fp", "n"])

    return rows.mapInArrow(run, "fp int, n long")


def materialised(rows: DataFrame, frequent: Frequent) -> DataFrame:
    """lang, size, phrase, a, first_doc: the phrases that the map lets through, counted by their text; size 0 and no phrase: all words of a language."""
    shared = rows.sparkSession.sparkContext.broadcast(frequent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, w in words_of(batches):
            ids, raw = w.exact(), w.data.tobytes()
            docs = batch.column(0)
            total = np.bincount(w.text, minlength=batch.num_rows)
            size, count, text, phrases = [np.zeros(batch.num_rows, np.int64)], [total], [np.arange(batch.num_rows)], [b""] * batch.num_rows
            for n in range(1, LONGEST + 1):
                pointer, counts = w.frequent(n, ids, shared.value)
                phrases += [w.phrase(raw, i, n) for i in pointer.tolist()]
                size.append(np.full(len(pointer), n))
                count.append(counts)
                text.append(w.text[pointer])
            text_of = np.concatenate(text)
            langs = pa.array(w.langs, pa.string()).take(pa.array(text_of))
            yield pa.RecordBatch.from_arrays([langs, pa.array(np.concatenate(size), pa.int32()), pa.array(phrases, pa.binary()).cast(pa.string()), pa.array(np.concatenate(count)), docs.take(pa.array(text_of))], names=["lang", "size", "phrase", "a", "first_doc"])

    made = rows.mapInArrow(run, "lang string, size int, phrase string, a long, first_doc long")
    return made.groupBy("lang", "size", "phrase").agg(F.sum("a").alias("a"), F.min("first_doc").alias("first_doc"))


def wide(c: str):
    return F.col(c).cast("decimal(20,0)")


def collocations(docs: DataFrame, least: int = 30, inside_percent: int = 80, top: int = 2000, id_col: str = "doc_id", text: str = "text", lang: str = "lang", bits: int = 26) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score, first_doc: the ``top`` phrases of each language, best first.

    A to Z count as lower case. Texts are cut into pieces at . , ; : ! ? and
    line ends, pieces into words at blanks and tabs. A phrase has 2 to 4 words
    of a piece and occurs ``least`` times or more in its language (null: und).
    Cut in two after its first k words, the parts occur l and r times, and its
    score is floor(2000000 a / (l + r)); the cut with the lowest score counts,
    the smallest k of equals. A phrase goes if a longer one that holds it occurs
    ``inside_percent`` of its times or more. Ties in score go to the larger a,
    then to the phrase that comes first by its UTF-8 bytes. n counts all words
    of the language; first_doc is the least id of a document with the phrase.

    Null and empty texts have no words. Repeated rows are rows like others; an
    empty table gives no rows. Counts are exact; ``bits``, 32 at most, sets the
    size of the map of frequent fingerprints (8 MB) and what passes it by
    chance, not the result. Other columns are not read.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(lang), F.lit("und")).alias("lang"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    tasks = max(TASKS_A_CORE * rows.sparkSession.sparkContext.defaultParallelism, -(-rows.rdd.getNumPartitions() // PARTS_A_TASK))
    rows = rows.coalesce(tasks)
    frequent = Frequent(bits).with_frequent(counted_prints(rows, (1,)), least)
    frequent = frequent.with_frequent(counted_prints(rows, (2,), 1, frequent), least)
    frequent = frequent.with_frequent(counted_prints(rows, (3, 4), 2, frequent), least)
    phrases = cut(materialised(rows, frequent).filter((F.col("size") == 0) | (F.col("a") >= least)), "phrases")
    totals = phrases.filter("size = 0").select("lang", F.col("a").alias("n"))
    every = phrases.filter("size > 0").select("lang", "size", "phrase", "a", "first_doc")
    long = every.filter("size > 1").withColumn("w", F.split("phrase", " "))
    cuts = long.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("size") - 1)))
    cuts = cuts.select("lang", "phrase", "a", "k", F.array_join(F.slice("w", F.lit(1), F.col("k")), " ").alias("head"), F.array_join(F.slice("w", F.col("k") + 1, F.col("size") - F.col("k")), " ").alias("tail"))
    heads = every.select("lang", F.col("phrase").alias("head"), F.col("a").alias("l"))
    tails = every.select("lang", F.col("phrase").alias("tail"), F.col("a").alias("r"))
    scored = cuts.join(heads, ["lang", "head"]).join(tails, ["lang", "tail"]).withColumn("score", F.expr("(cast(a as decimal(20,0)) * 2000000BD) div (cast(l as decimal(20,0)) + cast(r as decimal(20,0)))"))
    best = scored.groupBy("lang", "phrase").agg(F.min(F.struct("score", "k", "l", "r")).alias("best"))
    held = long.filter("size > 2").withColumn("m", F.explode(F.sequence(F.lit(2), F.col("size") - 1))).withColumn("i", F.explode(F.sequence(F.lit(1), F.col("size") - F.col("m") + 1)))
    held = held.select("lang", F.array_join(F.slice("w", F.col("i"), F.col("m")), " ").alias("phrase"), F.col("a").alias("longer")).groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    kept = long.join(best, ["lang", "phrase"]).join(held, ["lang", "phrase"], "left").filter(F.col("longer").isNull() | (wide("longer") * 100 < wide("a") * inside_percent))
    kept = kept.select("lang", "phrase", "a", "best.l", "best.r", "best.score", "first_doc")
    order = W.partitionBy("lang").orderBy(F.col("score").desc(), F.col("a").desc(), F.col("phrase"))
    ranked = kept.withColumn("rank", F.row_number().over(order).cast("long")).filter(F.col("rank") <= top)
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score", "first_doc")


def op12_phrase_collocations(spark, sf_dir: str) -> DataFrame:
    return collocations(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP12_SQL = r"""
WITH pieces AS (
  SELECT doc_id, coalesce(lang, 'und') AS lang,
         unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents
), worded AS (
  SELECT doc_id, lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces
), totals AS (
  SELECT lang, sum(len(w))::BIGINT AS n FROM worded GROUP BY lang
), sized AS (
  SELECT *, unnest([1, 2, 3, 4]) AS size FROM worded
), grams AS (
  SELECT doc_id, lang, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM sized WHERE len(w) >= size
), counted AS (
  SELECT lang, size, array_to_string(w[i:i + size - 1], ' ') AS phrase, count(*)::HUGEINT AS a, min(doc_id) AS first_doc FROM grams GROUP BY ALL HAVING count(*) >= 30
), long AS (
  SELECT *, string_split(phrase, ' ') AS w FROM counted WHERE size > 1
), cuts AS (
  SELECT *, unnest(range(1, size)) AS k FROM long
), scored AS (
  SELECT c.lang, c.phrase, k, h.a AS l, t.a AS r, (2000000 * c.a) // (h.a + t.a) AS score
  FROM cuts c JOIN counted h ON h.lang = c.lang AND h.phrase = array_to_string(c.w[1:k], ' ') JOIN counted t ON t.lang = c.lang AND t.phrase = array_to_string(c.w[k + 1:], ' ')
), best AS (
  SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1
), inner_sizes AS (
  SELECT lang, a, w, size, unnest(range(2, size)) AS m FROM long WHERE size > 2
), inner_places AS (
  SELECT *, unnest(range(1, size - m + 2)) AS i FROM inner_sizes
), held AS (
  SELECT lang, array_to_string(w[i:i + m - 1], ' ') AS phrase, max(a) AS longer FROM inner_places GROUP BY ALL
), kept AS (
  SELECT c.lang, c.phrase, c.a, b.l, b.r, b.score, c.first_doc FROM long c JOIN best b ON b.lang = c.lang AND b.phrase = c.phrase
  LEFT JOIN held h ON h.lang = c.lang AND h.phrase = c.phrase WHERE longer IS NULL OR 100 * longer < 80 * c.a
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept
)
SELECT k.lang, rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n, score::BIGINT AS score, first_doc FROM ranked k JOIN totals t ON t.lang = k.lang WHERE rank <= 2000
"""
