"""Similarity join of word-shingle sets by PartEnum signatures.

Two sets of at most s shingles each with Jaccard similarity g or more differ in
at most k = 2 s (1 - g) / (1 + g) shingles. The shingle domain is cut into
first-level partitions, enough that in more than E of them such sets differ in
one shingle at most, and each of these into second-level partitions, of which
all subsets but one are enumerated: in each of those partitions the sets agree
on one subset. A signature is the hash of what a set holds in such a subset.
Bands of sizes, each set in its own and the next, keep k small.

A subset that holds nothing, or only shingles from a list of very common ones,
says little. A set that has such weak subsets in E partitions at most need not
give them: it has a strong one in common with every similar set. A set with
more gives, besides its strong subsets, the least common shingles that make up
its prefix (size - ceil(g size) + 1); two such sets that are similar share one
of these. So a line that a third of all texts hold ties none of them together.

Sets that are equal are one class and join by their first document only. What
shares a signature, directly or through others, is a block of candidates. A
small block is compared in one cell. A large one is first compared with a few
hubs; then each document that has not fallen into the block's largest component
is compared with those of a like size in the block, or with those that it shares
a signature with, whichever sends fewer rows, so that a chain of chance meetings
costs no more than the meetings. A signature that very many share is dealt to
cells as well, so that no group is ever one task and nothing that could link is
left out.

Cells get sketches first: a set's shingles, counted modulo two in a row of bits.
Two sets differ in as many shingles at least as their sketches differ in bits, so
pairs whose sketches differ too much surely don't link. The larger a table, the
more documents meet by chance; their texts are not sent. Those of the pairs that
are left are compared word by word, as a matrix product, in one cell for each
pair, which reports spanning edges only.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellwave.llm.arrow import runs, small_batches, steps, utf8
from cellwave.llm.graph import components
from cellwave.llm.idmap import part_by_map
from cellwave.llm.shingles import U64, exact_sets, mix, shingle_sets
from cellwave.llm.store import cut


class PartEnum:
    """Signatures for sets with Jaccard similarity of at least ``percent`` / 100.

    ``common`` are hashes of shingles from the rarest to the most frequent, the
    same list for all sets; any list gives right results.
    """

    def __init__(self, percent: int, common: np.ndarray | None = None, parts: int = 2, spare: float = 0.25):
        self.g, self.percent, self.parts, self.spare = percent / 100, percent, parts, spare
        listed = np.zeros(0, U64) if common is None else common
        order = np.argsort(listed)
        self.common, self.rank = listed[order], order + 1

    def band(self, size: int) -> int:
        """Bands are (1 / g) ** b <= size < (1 / g) ** (b + 1); similar sets are in one band or in neighbouring ones."""
        b = max(0, math.floor(math.log(size) / -math.log(self.g)))
        while self.g ** -(b + 1) <= size:
            b += 1
        while b and self.g**-b > size:
            b -= 1
        return b

    def ranks(self, found: np.ndarray) -> np.ndarray:
        """Places in the list of common shingles, 0 for those that aren't in it."""
        if not len(self.common):
            return np.zeros(len(found), np.int64)
        at = np.minimum(np.searchsorted(self.common, found), len(self.common) - 1)
        return np.where(self.common[at] == found, self.rank[at], 0)

    def signatures(self, found: np.ndarray) -> np.ndarray:
        """All signatures of a set of distinct hashes."""
        if not len(found):
            return np.zeros(0, U64)
        rank = self.ranks(found)
        spread = mix(found)
        own = self.band(len(found))
        out, over = [], False
        for b in (own, own + 1):
            made, many = self.of_band(spread, rank == 0, b)
            out.append(made)
            over |= many
        if over:
            size = len(found)
            prefix = size - -(-self.percent * size // 100) + 1
            out.append(mix(spread[np.lexsort((spread, rank))[:prefix]] ^ U64(0xA0761D6478BD642F)))
        return np.concatenate(out)

    def of_band(self, spread: np.ndarray, rare: np.ndarray, band: int) -> tuple[np.ndarray, bool]:
        """Strong signatures that pairs whose larger set is in ``band`` have in common, and whether too many subsets are weak."""
        most = math.floor(self.g ** -(band + 1) + 1e-9)
        k = math.floor(2 * most * (1 - self.g) / (1 + self.g) + 1e-9)
        number = U64((band + 1) * 0x9E3779B97F4A7C15 % 2**64)
        if not k:  # equal sets only
            return mix(spread.sum(dtype=U64, keepdims=True) + number), False
        least = -(-(k + 1) // 2)  # of so many partitions one has one difference at most
        spare = math.ceil(least * self.spare) + 1
        first, parts = least + spare, self.parts
        cell = ((spread >> U64(17)) % U64(first * parts)).astype(np.int64)
        held = np.zeros(first * parts, U64)
        np.add.at(held, cell, spread)
        held = held.reshape(first, parts)
        strong = np.bincount(cell[rare], minlength=first * parts).reshape(first, parts)
        number = number + np.arange(first, dtype=U64) * U64(1_000_003)
        made, weak = [], np.zeros(first, bool)
        for left_out in range(parts):  # a subset of all second-level partitions but one
            rest = [p for p in range(parts) if p != left_out]
            total = mix(number + U64(left_out + 1))
            for p in rest:
                total = mix(total + held[:, p])
            good = strong[:, rest].sum(1) > 0
            made.append(total[good])
            weak |= ~good
        return np.concatenate(made), int(weak.sum()) > spare


#: Hashes of shingles are counted in at most 2 ** COUNT_BITS buckets first, 2 ** ROW_BITS of them in a row.
COUNT_BITS, ROW_BITS = 24, 12
#: Counting takes so many tasks a core at least, and so many input parts a task where there are more: a task's counts are shuffled whole.
TASKS_A_CORE, PARTS_A_TASK = 3, 4


def bucket_counts(texts: DataFrame, n: int, bits: int) -> DataFrame:
    """part, width, counts: how many documents of a task have a shingle in each of a part's buckets, as whole numbers of ``width`` bytes."""
    size = 1 << ROW_BITS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = None
        for batch in steps(batches):
            found, _ = shingle_sets(*utf8(batch.column(1)), n)
            if counts is None:
                counts = np.zeros(1 << bits, np.uint32)
            bucket, k = np.unique(found >> U64(64 - bits), return_counts=True)
            counts[bucket.astype(np.int64)] += k.astype(np.uint32)
        if counts is None:
            return
        parts = counts.reshape(-1, size)
        for at in range(0, len(parts), 256):
            rows = [(i, np.min_scalar_type(int(parts[i].max()))) for i in range(at, min(at + 256, len(parts))) if parts[i].any()]
            packed = [parts[i].astype(kind).tobytes() for i, kind in rows]
            yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in rows], pa.int64()), pa.array([kind.itemsize for _, kind in rows], pa.int32()), pa.array(packed, pa.binary())], names=["part", "width", "counts"])

    return texts.select("doc_id", "text").mapInArrow(run, "part long, width int, counts binary")


def often_buckets(texts: DataFrame, n: int, bits: int, least: int) -> np.ndarray:
    """For each of the 2 ** ``bits`` buckets, a bit that says whether its shingles are in ``least`` documents together: 2 MB at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in runs(batches, ["part"]):
            total = np.zeros(1 << ROW_BITS, np.int64)
            for width, counts in zip(table.column("width").to_pylist(), table.column("counts").to_pylist()):
                total += np.frombuffer(counts, f"<u{width}")
            yield pa.RecordBatch.from_arrays([pa.array(table.column("part").to_pylist()[:1], pa.int64()), pa.array([np.packbits(total >= least).tobytes()], pa.binary())], names=["part", "often"])

    made = bucket_counts(texts, n, bits).repartition("part").sortWithinPartitions("part").mapInArrow(run, "part long, often binary").toArrow()
    often = np.zeros((1 << (bits - ROW_BITS), 1 << (ROW_BITS - 3)), np.uint8)
    for part, packed in zip(made.column("part").to_pylist(), made.column("often").to_pylist()):
        often[part] = np.frombuffer(packed, np.uint8)
    return often.reshape(-1)


def common_shingles(texts: DataFrame, n: int, share: float = 3 / 40_000, least: int = 3, most: int = 1 << 18) -> np.ndarray:
    """The shingles that ``least`` documents have and ``share`` of all, the ``most`` most frequent of them, from the rarest on.

    Counts are exact and over all documents. Those of buckets of hashes come
    first, so that only shingles of a bucket that has as many are shuffled.
    Only which signatures are given depends on the list, never what links.
    """
    docs = texts.count()
    texts = texts.coalesce(max(TASKS_A_CORE * texts.sparkSession.sparkContext.defaultParallelism, -(-texts.rdd.getNumPartitions() // PARTS_A_TASK)))
    least = max(least, math.ceil(share * docs))
    bits = min(COUNT_BITS, max(ROW_BITS, (256 * docs).bit_length()))
    often = texts.sparkSession.sparkContext.broadcast(often_buckets(texts, n, bits, least))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches):
            found, _ = shingle_sets(*utf8(batch.column(1)), n)
            bucket = (found >> U64(64 - bits)).astype(np.int64)
            shingle, k = np.unique(found[(often.value[bucket >> 3] >> (7 - (bucket & 7)).astype(np.uint8)) & 1 > 0], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(shingle.view(np.int64)), pa.array(k)], names=["shingle", "n"])

    counted = texts.select("doc_id", "text").mapInArrow(run, "shingle long, n long").groupBy("shingle").agg(F.sum("n").alias("count"))
    # written first, so that the best of each partition meet in a task and not in the driver
    top = cut(counted.filter(F.col("count") >= least).orderBy(F.col("count").desc(), "shingle").limit(most), "common").orderBy(F.col("count").desc(), "shingle").collect()
    often.unpersist()
    return np.array([r["shingle"] for r in reversed(top)], np.int64).view(U64)


def set_features(docs: DataFrame, n: int) -> DataFrame:
    """doc_id, n_shingles, digest (what tells sets apart): one row per row of ``docs`` (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches):
            found, upto = shingle_sets(*utf8(batch.column(1)), n)
            digests = []
            for spread in (mix(found), mix(found ^ U64(0xD6E8FEB86659FD93))):
                sums = np.concatenate((np.zeros(1, U64), np.cumsum(spread, dtype=U64)))
                digests.append(pa.array((sums[upto[1:]] - sums[upto[:-1]]).view(np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(upto), pa.int64()), *digests], names=["doc_id", "n_shingles", "low", "high"])

    made = docs.mapInArrow(run, "doc_id long, n_shingles long, low long, high long")
    return made.select("doc_id", "n_shingles", F.struct("n_shingles", "low", "high").alias("digest"))


#: Shingles, about, whose signatures meet in one part, and the bits of a signature that are told apart within it.
PART_SHINGLES, TOLD_BITS = 1 << 19, 42


def narrow(numbers: np.ndarray) -> bytes:
    """Whole numbers in as many bytes each as the largest needs: all lowest bytes, then all next ones."""
    width = max(1, -(-int(numbers.max()).bit_length() // 8))
    return np.ascontiguousarray(numbers.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes()


def widen(data: bytes, count: int) -> np.ndarray:
    """The ``count`` numbers that ``narrow`` has packed."""
    planes = np.frombuffer(data, np.uint8).reshape(-1, count)
    out = np.zeros((count, 8), np.uint8)
    out[:, : len(planes)] = planes.T
    return out.view("<u8").reshape(-1).astype(U64)


def firsts(sig: np.ndarray) -> np.ndarray:
    first = np.ones(len(sig), bool)
    first[1:] = sig[1:] != sig[:-1]
    return first


def pairs(doc: np.ndarray, leader: np.ndarray) -> np.ndarray:
    keep = doc != leader
    return np.unique(np.stack((doc[keep], leader[keep]), 1), axis=0) if keep.any() else np.zeros((0, 2), np.int64)


def packed_signatures(texts: DataFrame, n: int, shared: Broadcast[PartEnum], parts: int, held: int = 1 << 18, tied: bool = True) -> DataFrame:
    """part, many, least, sigs, docs, a, b: a task's signatures of a part, packed, each with one document; or an edge (a, b).

    A task first ties its own documents of a signature to the least of them, so
    that a signature reaches its part once per ``held`` signatures or so of a
    task, however many documents share it. If not ``tied``, all documents of a
    signature reach its part, and there are no edges. Signatures are sorted and go as
    differences, documents as what they are above ``least``: 7 or 8 bytes in all
    where rows of whole numbers take 18 in a shuffle. A part's signatures are
    told apart by ``TOLD_BITS`` bits; two that are not only make a candidate.
    """

    def combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        docs: list[np.ndarray] = []
        sigs: list[np.ndarray] = []

        def told() -> pa.RecordBatch:
            doc, sig = np.concatenate(docs), np.concatenate(sigs)
            docs.clear()
            sigs.clear()
            part = ((sig >> U64(44)) * U64(parts)) >> U64(20)
            sig = (part << U64(TOLD_BITS)) | (sig & U64((1 << TOLD_BITS) - 1))
            order = np.lexsort((doc, sig))
            sig, doc = sig[order], doc[order]
            first = firsts(sig) if tied else firsts(sig) | firsts(doc)
            edges = pairs(doc, doc[first][np.cumsum(first) - 1]) if tied and len(sig) else np.zeros((0, 2), np.int64)
            sig, doc = sig[first], doc[first]
            part, sig = (sig >> U64(TOLD_BITS)).astype(np.int64), sig & U64((1 << TOLD_BITS) - 1)
            starts = np.flatnonzero(firsts(part)).tolist()
            rows = []
            for x, y in zip(starts, [*starts[1:], len(part)]):
                least = doc[x:y].min()
                rows.append((int(part[x]), y - x, int(least), narrow(np.diff(sig[x:y], prepend=U64(0))), narrow((doc[x:y] - least).view(U64))))
            k, m = len(rows), len(edges)
            columns = list(zip(*rows)) if rows else [()] * 5
            there = [pa.array(c, kind) for c, kind in zip(columns, (pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.binary()))]
            nothing = [pa.nulls(m, c.type) for c in there[1:]]
            dealt = pa.array((mix(edges[:, 0].view(U64) ^ mix(edges[:, 1].view(U64))) % U64(parts)).astype(np.int64))
            joined = [pa.concat_arrays(x) for x in zip(there, [dealt, *nothing])]
            ends = [pa.concat_arrays([pa.nulls(k, pa.int64()), pa.array(edges[:, i])]) for i in (0, 1)]
            return pa.RecordBatch.from_arrays([*joined, *ends], names=["part", "many", "least", "sigs", "docs", "a", "b"])

        for batch in steps(batches):
            found, upto = shingle_sets(*utf8(batch.column(1)), n)
            lists = [shared.value.signatures(found[a:b]) for a, b in zip(upto[:-1], upto[1:])]
            docs.append(np.repeat(batch.column(0).to_numpy(), [len(x) for x in lists]))
            sigs.append(np.concatenate(lists))
            if sum(len(x) for x in sigs) >= held:
                yield told()
        if sigs:
            yield told()

    return texts.select("doc_id", "text").mapInArrow(combine, "part long, many int, least long, sigs binary, docs binary, a long, b long")


def parts_for(texts: DataFrame, shingles: int) -> int:
    """Parts of about half a million signatures, whose number grows with the shingles."""
    return min(1 << 20, max(4 * texts.sparkSession.sparkContext.defaultParallelism, -(-shingles // PART_SHINGLES)))


def unpacked(packed: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """The signatures and documents of a part's packed rows, of which there is one at least, by signature and document."""
    rows = list(zip(*(packed.column(c).to_pylist() for c in ("many", "least", "sigs", "docs"))))
    sig = np.concatenate([np.cumsum(widen(sigs, many), dtype=U64) for many, _, sigs, _ in rows])
    doc = np.concatenate([widen(docs, many).view(np.int64) + np.int64(least) for many, least, _, docs in rows])
    order = np.lexsort((doc, sig))
    return sig[order], doc[order]


def candidate_edges(texts: DataFrame, n: int, shared: Broadcast[PartEnum], shingles: int) -> DataFrame:
    """Edges (a, b) that tie all documents of one signature together: ``texts`` has doc_id and text, and about so many ``shingles``.

    Signatures are dealt to parts; a part's are unpacked and sorted in one task.
    """

    def chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in runs(batches, ["part"]):
            made = table.filter(pc.is_valid(table.column("a")))
            out = [np.stack((made.column("a").to_numpy(), made.column("b").to_numpy()), 1)]
            packed = table.filter(pc.is_null(table.column("a")))
            if packed.num_rows:
                sig, doc = unpacked(packed)
                first = firsts(sig)
                out.append(pairs(doc, doc[first][np.cumsum(first) - 1]))
            ready = np.concatenate(out)
            yield pa.RecordBatch.from_arrays([pa.array(ready[:, 0]), pa.array(ready[:, 1])], names=["a", "b"])

    rows = packed_signatures(texts, n, shared, parts_for(texts, shingles))
    return rows.repartition("part").sortWithinPartitions("part").mapInArrow(chain, "a long, b long").distinct()


def shared_signatures(texts: DataFrame, n: int, shared: Broadcast[PartEnum], shingles: int) -> DataFrame:
    """sig, doc_id: each signature (its part and what is told apart there) that two documents or more have, once with each of them."""

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in runs(batches, ["part"]):
            sig, doc = unpacked(table)
            other = firsts(sig) | firsts(doc)  # not a row's copy
            sig, doc = sig[other], doc[other]
            first = firsts(sig)
            met = ~(first & np.append(first[1:], True))
            sig = sig[met] | U64(table.column("part")[0].as_py() << TOLD_BITS)
            yield pa.RecordBatch.from_arrays([pa.array(sig.view(np.int64)), pa.array(doc[met])], names=["sig", "doc_id"])

    rows = packed_signatures(texts, n, shared, parts_for(texts, shingles), tied=False)
    return rows.repartition("part").sortWithinPartitions("part").mapInArrow(meet, "sig long, doc_id long")


def sketch(found: np.ndarray) -> bytes:
    """A bit for each of 2 ** k places, 64 at least and twice as many as hashes: whether an odd number of the hashes fall on it."""
    places = max(64, 1 << (2 * len(found) - 1).bit_length()) if len(found) else 64
    at = (mix(found ^ U64(0x8EBC6AF09C88C6E3)) & U64(places - 1)).astype(np.int64)
    return np.packbits((np.bincount(at, minlength=places) & 1).astype(bool), bitorder="little").tobytes()


def sketches(texts: DataFrame, n: int) -> DataFrame:
    """doc_id, size, bits: the number of shingles and the sketch of each row of ``texts`` (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches):
            found, upto = shingle_sets(*utf8(batch.column(1)), n)
            bits = [sketch(found[a:b]) for a, b in zip(upto[:-1], upto[1:])]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(upto), pa.int64()), pa.array(bits, pa.binary())], names=["doc_id", "size", "bits"])

    return texts.select("doc_id", "text").mapInArrow(run, "doc_id long, size long, bits binary")


def near_by_sketch(sizes: np.ndarray, bits: list[bytes], percent: int) -> Iterator[tuple[int, np.ndarray]]:
    """Positions i, and all j that come with it, of pairs whose sketches leave open that their Jaccard similarity is percent / 100 or more; each pair once.

    Sets that differ in d shingles have sketches that differ in d bits at most;
    a longer sketch is folded to the other's length, which keeps that.
    """
    words = np.fromiter((len(b) // 8 for b in bits), np.int64, len(bits))
    for w in np.unique(words).tolist():
        base = np.flatnonzero(words == w)
        most = 100 * sizes[base].max()
        places, rows = [base], [np.frombuffer(b"".join([bits[i] for i in base]), U64).reshape(len(base), w)]
        for longer in np.unique(words[words > w]).tolist():
            at = np.flatnonzero((words == longer) & (percent * sizes <= most))
            if len(at):
                places.append(at)
                rows.append(np.bitwise_xor.reduce(np.frombuffer(b"".join([bits[i] for i in at]), U64).reshape(len(at), longer // w, w), axis=1))
        place, row = np.concatenate(places), np.concatenate(rows)
        size = sizes[place]
        for k in range(len(base)):
            there = np.flatnonzero((percent * np.maximum(size[k + 1 :], size[k]) <= 100 * np.minimum(size[k + 1 :], size[k]))) + k + 1
            if len(there):
                apart = np.bitwise_count(row[there] ^ row[k]).sum(1, dtype=np.int64)
                there = there[(100 + percent) * apart <= (100 - percent) * (size[there] + size[k])]
                if len(there):
                    yield int(place[k]), place[there]


def near_pairs(cells: DataFrame, percent: int) -> DataFrame:
    """a, b, cell: pairs a < b of a cell's left and right side that may link, by their sketches, with the least cell they meet in.

    ``cells`` has cell (a struct), side (0 left, 1 right, 2 both), doc_id, size and bits.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in runs(batches, ["k0", "k1", "k2"]):
            ids, side = table.column("doc_id").to_numpy(), table.column("side").to_numpy()
            a, b = [ids[:0]], [ids[:0]]
            for i, js in near_by_sketch(table.column("size").to_numpy(), table.column("bits").to_pylist(), percent):
                js = js[((side[i] != 1) & (side[js] != 0) | (side[i] != 0) & (side[js] != 1)) & (ids[js] != ids[i])]
                a.append(np.minimum(ids[js], ids[i]))
                b.append(np.maximum(ids[js], ids[i]))
            found = np.unique(np.stack((np.concatenate(a), np.concatenate(b)), 1), axis=0)
            if len(found):
                keys = [pa.array(np.full(len(found), table.column(k)[0].as_py()), pa.int64()) for k in ("k0", "k1", "k2")]
                yield pa.RecordBatch.from_arrays([*keys, pa.array(found[:, 0]), pa.array(found[:, 1])], names=["k0", "k1", "k2", "a", "b"])

    flat = cells.select(F.col("cell.k0").alias("k0"), F.col("cell.k1").alias("k1"), F.col("cell.k2").alias("k2"), "side", "doc_id", "size", "bits")
    met = flat.repartition("k0", "k1", "k2").sortWithinPartitions("k0", "k1", "k2").mapInArrow(run, "k0 long, k1 long, k2 long, a long, b long")
    return met.groupBy("a", "b").agg(F.min(F.struct("k0", "k1", "k2")).alias("cell"))


def verified_cells(cells: DataFrame, sketched: DataFrame, texts: DataFrame, n: int, percent: int) -> DataFrame:
    """Edges (a, b) that connect what the links of all cells connect; ``cells`` has cell, side and doc_id.

    Only texts of pairs that their sketches leave open are sent, to one cell a pair.
    """
    near = near_pairs(cells.join(sketched, "doc_id"), percent)
    ids = cut(near.select("cell", F.explode(F.array("a", "b")).alias("doc_id")).distinct(), "near-ids")
    met = part_by_map(texts, ids)[0].join(ids, "doc_id")
    return cell_links(met.select("cell", F.lit(2).alias("side"), "doc_id", "text"), n, percent)


def links(found: np.ndarray, upto: np.ndarray, left: np.ndarray, right: np.ndarray, percent: int, most: int = 4096) -> Iterator[tuple[int, int]]:
    """Positions (i of left, j of right) whose sets have a Jaccard similarity of at least percent / 100, by matrix products."""
    sizes = np.diff(upto)
    owner = np.repeat(np.arange(len(sizes)), sizes)
    _, feature, counts = np.unique(found, return_inverse=True, return_counts=True)
    common = counts[feature] > 1  # a shingle of one set alone is in no intersection
    feature, owner = feature[common], owner[common]
    used, feature = np.unique(feature, return_inverse=True)
    both = np.zeros((len(left), len(right)), np.int64)
    order = np.argsort(feature, kind="stable")
    feature, owner = feature[order], owner[order]
    for start in range(0, len(used), most):
        a, b = np.searchsorted(feature, (start, start + most))
        dense = np.zeros((len(sizes), min(most, len(used) - start)), np.float32)
        dense[owner[a:b], feature[a:b] - start] = 1
        both += (dense[left] @ dense[right].T).astype(np.int64)  # whole numbers of ``most`` at most
    union = sizes[left][:, None] + sizes[right][None, :] - both
    i, j = np.nonzero((100 * both >= percent * union) & (both > 0))
    return zip(i.tolist(), j.tolist())


def cell_links(cells: DataFrame, n: int, percent: int) -> DataFrame:
    """Edges (a, b) of a spanning forest of each cell's links, linked documents of each cell's left and right side.

    ``cells`` has cell (a struct), side (0 left, 1 right, 2 both), doc_id and
    text. Words are compared as they are, so that no link rests on hashes.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in runs(batches, ["k0", "k1", "k2"]):
            ids, side = table.column("doc_id").to_numpy(), table.column("side").to_numpy()
            found, upto = exact_sets(table.column("text").cast(pa.binary()).to_pylist(), n)
            left, right = np.flatnonzero(side != 1), np.flatnonzero(side != 0)
            parent = list(range(len(ids)))

            def root(x: int) -> int:
                while parent[x] != x:
                    parent[x] = parent[parent[x]]
                    x = parent[x]
                return x

            out = []
            for i, j in links(found, upto, left, right, percent):
                x, y = root(int(left[i])), root(int(right[j]))
                if x != y:
                    parent[max(x, y)] = min(x, y)
                    out.append((ids[left[i]], ids[right[j]]))
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in out], pa.int64()), pa.array([y for _, y in out], pa.int64())], names=["a", "b"])

    flat = cells.select(F.col("cell.k0").alias("k0"), F.col("cell.k1").alias("k1"), F.col("cell.k2").alias("k2"), "side", "doc_id", "text")
    return flat.repartition("k0", "k1", "k2").sortWithinPartitions("k0", "k1", "k2", "doc_id").mapInArrow(run, "a long, b long").filter("a <> b")


def key(k0, k1, k2):
    return F.struct(F.col(k0).alias("k0"), k1.cast("long").alias("k1"), k2.cast("long").alias("k2")).alias("cell")


def size_band(size, percent: int):
    """Bands of sizes of which similar sets are in the same or in neighbouring ones; a little wide, so that rounding does no harm."""
    return F.floor(F.ln(size) / F.lit(-1.0001 * math.log(percent / 100)))


#: Shingles, about, that a side of a cell holds.
CELL_SHINGLES = 1 << 16


def cells_for(documents: str, shingles: str, cell: int):
    """How many cells so many documents with so many shingles are dealt to: by the number that asks for more of them, but not more than documents."""
    return F.greatest(F.ceil(F.col(documents) / cell), F.least(F.col(documents), F.ceil(F.col(shingles) / CELL_SHINGLES))).cast("long")


def verified_edges(texts: DataFrame, blocks: DataFrame, n: int, percent: int, shared: Broadcast[PartEnum], cell: int, hubs: int) -> DataFrame:
    """Edges of a spanning forest of each block's true links.

    ``texts``: doc_id, text of all documents; ``blocks``: node, label (block), n_shingles.
    """
    sized = blocks.groupBy("label").agg(F.count("*").alias("members"), F.sum("n_shingles").alias("shingles"))
    placed = blocks.join(sized, "label").filter("members > 1").withColumn("cells", cells_for("members", "shingles", cell))
    placed = cut(placed.select(F.col("node").alias("doc_id"), "label", "cells", "members", "n_shingles"), "placed")
    sketched = cut(sketches(part_by_map(texts, placed)[0], n).distinct(), "sketches")  # a row however often it is repeated
    nil = F.lit(0)
    small = placed.filter("cells = 1").select(key("label", nil, nil), F.lit(2).alias("side"), "doc_id")
    large = placed.filter("cells > 1")
    if large.isEmpty():
        return verified_cells(small, sketched, texts, n, percent)
    block = F.pmod(F.xxhash64("doc_id"), F.col("cells"))
    spread = F.pmod(F.xxhash64(F.lit(3), "doc_id"), F.lit(1 << 40))
    is_hub = (F.col("doc_id") == F.col("label")) | (spread < F.lit(float(hubs << 40)) / F.col("members"))
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.col("cells") - 1))
    hub_rows = large.filter(is_hub).withColumn("at", every).select(key("label", F.col("at"), nil), F.lit(0).alias("side"), "doc_id")
    own_rows = large.select(key("label", block, nil), F.lit(1).alias("side"), "doc_id")
    edges = cut(verified_cells(small.unionByName(hub_rows).unionByName(own_rows), sketched, texts, n, percent), "links")
    # what the hubs have not drawn into a block's largest component is compared with what it shares a signature with
    labels = components(edges).select(F.col("node").alias("doc_id"), F.col("label").alias("part"))
    ids = large.select("doc_id", "label").distinct()
    parts = cut(ids.join(labels, "doc_id", "left").withColumn("part", F.coalesce("part", "doc_id")), "parts")
    counted = parts.groupBy("label", "part").agg(F.count("*").alias("n"))
    largest = cut(counted.groupBy("label").agg(F.max(F.struct("n", "part")).alias("top")).select("label", F.col("top.part").alias("top")), "largest")
    moved = cut(parts.join(largest, "label").select("doc_id", "label", "part", (F.col("part") != F.col("top")).alias("moves")), "moved")
    shingles = large.agg(F.sum("n_shingles")).first()[0]
    met = shared_signatures(part_by_map(texts, large)[0], n, shared, shingles)
    groups = signature_groups(met, sketched.select("doc_id", "size").distinct(), moved, percent, cell)
    lone = groups.filter("cells = 1").select("doc_id", key("sig", nil, nil), F.lit(2).alias("side"))
    groups = groups.filter("cells > 1")
    sums = [f(F.when(F.col("moves") | F.lit(every_one), F.col("size"))).alias(f"{name}_{what}") for name, every_one in (("all", True), ("movers", False)) for what, f in (("n", F.count), ("shingles", F.sum))]
    bands = groups.groupBy("sig", "band").agg(*sums)
    bands = cut(bands.select("sig", "band", *[F.when(F.col(f"{c}_n") > 0, cells_for(f"{c}_n", f"{c}_shingles", cell)).otherwise(0).alias(c) for c in ("all", "movers")]), "bands")
    near = F.explode(F.array(*[F.col("band") + i for i in (-1, 0, 1)]))

    def pairs(rows: DataFrame, shelves: str, other: str, hash_seed: int) -> DataFrame:
        """doc_id, sig, own (its band and shelf), and each band and shelf of the other side that it meets."""
        own = rows.join(bands.select("sig", "band", F.col(shelves).alias("_own")), ["sig", "band"])
        own = own.withColumn("own", F.col("band") * SHELVES + F.pmod(F.xxhash64(F.lit(hash_seed), "doc_id"), F.col("_own")))
        theirs = bands.filter(F.col(other) > 0).select("sig", F.col("band").alias("there"), F.col(other).alias("_shelves"))
        met = own.withColumn("there", near).join(theirs, ["sig", "there"])
        shelf = F.explode(F.sequence(F.lit(0).cast("long"), F.col("_shelves") - 1))
        return met.withColumn("shelf", shelf).select("doc_id", "sig", "own", (F.col("there") * SHELVES + F.col("shelf")).alias("other"))

    movers = pairs(groups.filter("moves"), "movers", "all", 5).select("doc_id", key("sig", F.col("own"), F.col("other")), F.lit(0).alias("side"))
    others = pairs(groups, "all", "movers", 7).select("doc_id", key("sig", F.col("other"), F.col("own")), F.lit(1).alias("side"))
    return edges.unionByName(verified_cells(lone.unionByName(movers).unionByName(others), sketched, texts, n, percent))


def signature_groups(met: DataFrame, sizes: DataFrame, moved: DataFrame, percent: int, cell: int) -> DataFrame:
    """sig, doc_id, size, band, moves and cells (that the group asks for): groups whose movers are to be compared with the rest of the group.

    ``met``: sig, doc_id, as ``shared_signatures`` gives them; ``sizes``: doc_id,
    size, each once; ``moved``: doc_id, label (block), part, moves. The groups of
    a block are those that share a signature and hold a mover and something it
    is not tied to yet; of groups of the same documents one is enough. Where it
    sends fewer rows, the block itself is the one group, with its label for a
    signature.
    """
    # each document and size once, so that xors below tell groups of different documents apart
    own = cut(moved.join(sizes, "doc_id"), "block-rows")
    rows = cut(met.join(own, "doc_id"), "signatures")
    told = rows.groupBy("label", "sig").agg(
        F.count("*").alias("members"), F.sum("size").alias("shingles"), F.max("moves").alias("any"), F.min("part").alias("low"), F.max("part").alias("high"),
        F.bit_xor(F.xxhash64("doc_id", "size")).alias("one"), F.bit_xor(F.xxhash64(F.lit(1), "doc_id", "size")).alias("two"),
    )
    kept = told.filter(F.col("any") & (F.col("low") != F.col("high"))).groupBy("label", "members", "shingles", "low", "high", "one", "two").agg(F.min("sig").alias("sig"))
    kept = cut(kept.select("label", "sig", "members", cells_for("members", "shingles", cell).alias("cells")), "signature-groups")
    sums = [f(F.when(F.col("moves") | F.lit(every_one), F.col("size"))).alias(f"{name}_{what}") for name, every_one in (("all", True), ("movers", False)) for what, f in (("n", F.count), ("shingles", F.sum))]
    sized = own.groupBy("label").agg(*sums).withColumn("cells", cells_for("all_n", "all_shingles", cell))
    by_block = sized.select("label", "cells", (F.col("movers_n") * F.col("cells") + F.col("all_n") * cells_for("movers_n", "movers_shingles", cell)).alias("by_block"))
    by_signature = kept.groupBy("label").agg(F.sum(F.col("members") * F.col("cells")).alias("by_signature"))
    choice = cut(by_block.join(by_signature, "label").select("label", "cells", (F.col("by_block") <= F.col("by_signature")).alias("whole")), "choice")
    band = size_band(F.col("size"), percent).alias("band")
    whole = own.join(choice.filter("whole"), "label").select(F.col("label").alias("sig"), "doc_id", "size", band, "moves", "cells")
    split = kept.join(choice.filter("not whole").select("label"), "label").select("sig", "label", "cells")
    return cut(rows.join(split, ["label", "sig"]).select("sig", "doc_id", "size", band, "moves", "cells").unionByName(whole), "grouped")


#: More shelves than a band ever has.
SHELVES = 1 << 40


def near_groups(docs: DataFrame, n: int = 5, percent: int = 80, id_col: str = "doc_id", text: str = "text", cell: int = 128, hubs: int = 48) -> DataFrame:
    """doc_id, n_shingles, class_id, component_id: one row per row of ``docs``.

    Words are runs without blanks and the like, A to Z lower-cased; a set is a
    text's distinct ``n``-word shingles, the whole sequence where there are
    fewer words. Two documents link when 100 * intersection >= ``percent`` *
    union. class_id is the least id with the same set, component_id the least
    id reachable by links. Texts without words and null texts have no shingle
    and link with nothing; ids are whole numbers; the class and the
    component of a null id are null, and nothing links with it. Rows of one id count as one document, linked
    by whatever any of them links to. Other columns are not read.

    Arrow batches of the session are held to 8 MB from then on: cells send
    texts, and a batch is held by the executor, its worker and a buffer between.
    """
    small_batches(docs.sparkSession)
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text).alias("text"))
    there = texts.filter("doc_id is not null and text is not null")
    features = cut(set_features(texts, n), "set-features")
    # written, as both sides of a join must be plain exchanges for Spark to split a large class
    classes = cut(features.filter("n_shingles > 0 and doc_id is not null").groupBy("digest").agg(F.min("doc_id").alias("class_id")), "class-ids")
    rows = cut(features.join(classes, "digest", "left").select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.col("class_id")).alias("class_id")), "classes")
    shared = docs.sparkSession.sparkContext.broadcast(PartEnum(percent, common_shingles(there, n)))  # its list of common shingles is bounded
    class_of = rows.filter("class_id is not null").select("doc_id", "class_id")
    shingles = rows.filter("class_id is not null").agg(F.sum("n_shingles")).first()[0] or 0
    edges = candidate_edges(there, n, shared, shingles)
    edges = edges.join(class_of.select(F.col("doc_id").alias("a"), F.col("class_id").alias("x")), "a").join(class_of.select(F.col("doc_id").alias("b"), F.col("class_id").alias("y")), "b")
    sizes = rows.filter("doc_id = class_id").groupBy("doc_id").agg(F.max("n_shingles").alias("n_shingles"))
    blocks = components(edges.select(F.col("x").alias("a"), F.col("y").alias("b")))
    blocks = cut(blocks.join(sizes.withColumnRenamed("doc_id", "node"), "node"), "blocks")
    labels = components(verified_edges(there, blocks, n, percent, shared, cell, hubs))
    shared.unpersist()
    placed = rows.join(labels.select(F.col("node").alias("class_id"), "label"), "class_id", "left")
    lone = F.when(F.col("n_shingles") > 0, F.col("class_id")).otherwise(F.col("doc_id"))
    return placed.select("doc_id", "n_shingles", "class_id", F.coalesce("label", lone).alias("component_id"))


def op4_ngram_jaccard(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return near_groups(docs, n=3, percent=90).select("doc_id", "n_shingles", "component_id")
