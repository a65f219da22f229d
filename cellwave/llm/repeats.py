"""Removal of repeated byte strings with a hash-compared suffix sort.

Every byte covered by a string of ``length`` bytes that also starts earlier in
the corpus goes. Equal windows have equal anchors (the gram with the least hash
in them), so windows are dealt by anchor, a run of neighbouring windows with
one anchor at a time: about one row for thirty bytes. A run whose anchor stands
nowhere else needs no more; all others send their bytes to the anchor's task.
There runs with the same bytes are one, and the windows of those that differ
are sorted as suffixes, by a mergesort that compares by prefix hashes. Hashes
only say what to compare: nothing goes whose bytes have not been compared with
those of an earlier string.

An anchor with very many runs is dealt in shares of documents first, where
equal runs become one; what is left of them is dealt window by window, by the
hash of the window. So neither a passage that all documents hold nor an anchor
with endless different surroundings is a task of its own. Anchors that occur
again and again in a sample of documents are not dealt by anchor to find out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellwave.llm.arrow import STEP_BYTES, steps, utf8
from cellwave.llm.shingles import mix, prefix_hashes, span_hashes
from cellwave.llm.store import cut
from cellwave.llm.suffixes import anchors, repeated_windows, same_bytes, same_spans

#: A run in one number: first window, last less first, anchor less first, and whether it is known to be a repeat.
SHIFT = 15


def pack(first: np.ndarray, last: np.ndarray, at: np.ndarray, gone) -> np.ndarray:
    return (first.astype(np.int64) << SHIFT) | ((last - first).astype(np.int64) << 8) | (at.astype(np.int64) << 1) | np.int64(gone)


def unpack(run: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    first = run >> SHIFT
    return first, first + ((run >> 8) & 127), (run >> 1) & 127, (run & 1).astype(bool)


def table(**columns: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns.values()], names=list(columns))


def changes(*columns: np.ndarray) -> np.ndarray:
    """Where a row differs from the one before in any column; the first row does."""
    out = np.zeros(len(columns[0]), bool)
    out[:1] = True
    for c in columns:
        out[1:] |= c[1:] != c[:-1]
    return out


def verified(data: np.ndarray, begin: np.ndarray, sizes: np.ndarray, *name: np.ndarray) -> np.ndarray:
    """Of spans sorted so that equal names follow each other, those with the same bytes as the first span of their name."""
    first = changes(*name)
    leader = np.flatnonzero(first)[np.cumsum(first) - 1] if len(first) else np.zeros(0, np.int64)
    out = ~first & (sizes == sizes[leader])
    at = np.flatnonzero(out)
    out[at] = same_spans(data, begin[at], begin[leader[at]], sizes[at])
    return out


def usual_anchors(texts: DataFrame, length: int, gram: int, sample_docs: int, least: int = 64, most: int = 1 << 14) -> np.ndarray:
    """At most ``most`` anchors of ``least`` runs in about ``sample_docs`` sampled documents.

    Only how runs are dealt depends on it, never what is found.
    """
    share = min(1.0, sample_docs / max(1, texts.count()))
    sample = texts.filter(F.pmod(F.xxhash64(F.lit(9), "doc"), F.lit(1 << 30)) < int(share * (1 << 30)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches):
            key, n = np.unique(anchors(*utf8(batch.column(1)), length, gram)["key"], return_counts=True)
            yield table(key=key, n=n)

    counted = sample.mapInArrow(run, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))
    return np.sort(np.array([r["key"] for r in counted.filter(F.col("n") >= least).orderBy(F.col("n").desc(), "key").limit(most).collect()], np.int64))


def find_runs(texts: DataFrame, length: int, gram: int, usual: np.ndarray) -> DataFrame:
    """doc, run, key: runs that repeat one of the same step of a task (with the mark), and those whose anchor stands elsewhere too."""
    known = texts.sparkSession.sparkContext.broadcast(usual)  # of bounded size

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches):
            offsets, data = utf8(batch.column(1))
            r = anchors(offsets, data, length, gram)
            doc = batch.column(0).to_numpy()[r["text"]]
            order = np.lexsort((r["first"], doc, r["cls"]))
            doc, r = doc[order], {k: v[order] for k, v in r.items()}
            gone = verified(data, offsets[r["text"]] + r["first"], r["last"] - r["first"] + length, r["cls"])
            run = pack(r["first"], r["last"], r["at"], 0) | gone.astype(np.int64)
            apart = gone | np.isin(r["key"], known.value)
            yield table(deal=np.where(apart, mix((doc ^ (run << 20)).view(np.uint64)).view(np.int64), r["key"]), apart=apart, doc=doc, run=run, key=r["key"])

    def sift(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, waiting = None, None  # the last anchor, and its first run while it is the only one
        for batch in batches:
            apart = batch.column(1).to_numpy(zero_copy_only=False)
            doc, run, key = (batch.column(i).to_numpy() for i in range(2, 5))
            out = [(doc[apart], run[apart], key[apart])]
            doc, run, key = doc[~apart], run[~apart], key[~apart]
            if len(key):
                new = changes(key)
                goes_on = bool(last == key[0])
                if goes_on and waiting is not None:
                    out.append(waiting)
                new[0] = not goes_on
                # an anchor stands elsewhere too if the row before or the row after has it
                shared = ~new | np.append(~new[1:], False)
                out.append((doc[shared], run[shared], key[shared]))
                waiting = None if shared[-1] else (doc[-1:], run[-1:], key[-1:])
                last = key[-1]
            doc, run, key = (np.concatenate(x) for x in zip(*out))
            yield table(doc=doc, run=run, key=key)

    rows = texts.mapInArrow(scan, "deal long, apart boolean, doc long, run long, key long")
    return rows.repartition("deal").sortWithinPartitions("deal").mapInArrow(sift, "doc long, run long, key long")


def squeezed(texts: DataFrame) -> DataFrame:
    """doc and body, the text's bytes compressed for the shuffle (null: empty)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(level=3)
        for batch in steps(batches):
            offsets, data = utf8(batch.column(1))
            bodies = [squeeze.compress(data[a:b].tobytes()) for a, b in zip(offsets[:-1], offsets[1:])]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(bodies, pa.binary())], names=["doc", "body"])

    return texts.mapInArrow(run, "doc long, body binary")


def cut_bytes(bodies: DataFrame, marked: DataFrame, length: int, windows: bool) -> DataFrame:
    """deal, doc, run, bytes, held: the bytes of each run, or of each window of it, of a document (``marked``: doc, runs).

    ``deal`` is what meets in one task; ``held`` says that this is a share of
    an anchor. Equal windows of one document become one here.
    """

    def run_(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        expand = zstandard.ZstdDecompressor()
        for batch in batches:
            for i in range(batch.num_rows):
                doc, data = batch.column(0)[i].as_py(), np.frombuffer(expand.decompress(batch.column(1)[i].as_py()), np.uint8)
                items = batch.column(2)[i].values
                run, deal, held = (items.field(k).to_numpy(zero_copy_only=False) for k in ("run", "deal", "held"))
                first, last, _, _ = unpack(run)
                if windows:
                    first = last = np.concatenate([np.arange(a, b + 1) for a, b in zip(first, last)])
                    sums = prefix_hashes(data)
                    name = mix(span_hashes(sums, first, first + length))
                    order = np.lexsort((first, name))
                    first = last = first[order]
                    name = name[order]
                    again = verified(data, first, np.full(len(first), length), name)
                    run = pack(first, first, np.zeros(len(first), np.int64), 0) | again.astype(np.int64)
                    deal, held = np.where(again, mix(name + first.astype(np.uint64)), name).view(np.int64), np.zeros(len(first), bool)
                for a in range(0, len(run), 4096):  # a few hundred kB at a time, however long the text
                    b = a + 4096
                    parts = [b"" if g else data[x : y + length].tobytes() for x, y, g in zip(first[a:b], last[a:b], run[a:b] & 1)]
                    yield pa.RecordBatch.from_arrays([pa.array(deal[a:b]), pa.array(np.full(len(parts), doc)), pa.array(run[a:b]), pa.array(parts, pa.binary()), pa.array(held[a:b])], names=["deal", "doc", "run", "bytes", "held"])

    return bodies.join(marked, "doc").mapInArrow(run_, "deal long, doc long, run long, bytes binary, held boolean")


def sort_part(key: np.ndarray, doc: np.ndarray, run: np.ndarray, offsets: np.ndarray, data: np.ndarray, held: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """doc and run of what goes (marked), and of what a share of an anchor passes on, from runs sorted by key, doc and place with their bytes."""
    first, last, at, gone = unpack(run)
    out = [(doc[gone], run[gone])]
    use = np.flatnonzero(~gone)
    # runs with the same bytes at the same distance from the anchor: the first of them stands for all
    sums = prefix_hashes(data)
    whole = span_hashes(sums, offsets[use], offsets[use + 1])
    order = np.lexsort((use, whole, at[use], key[use]))
    use, whole = use[order], whole[order]
    same = verified(data, offsets[use], offsets[use + 1] - offsets[use], key[use], at[use], whole)
    out.append((doc[use[same]], run[use[same]] | 1))
    use = np.sort(use[~same])
    out.append((doc[use[held[use]]], run[use[held[use]]]))
    use = use[~held[use]]
    new = changes(key[use])
    use = use[~new | np.append(~new[1:], False)[: len(new)]]  # a lone run has no window in common with another
    counts = (last - first + 1)[use]
    owner = np.repeat(use, counts)
    inner = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
    # windows meet those of the same key at the same distance from the anchor
    name = np.cumsum(changes(key))[owner] * 256 + at[owner] - inner + 128
    order = np.lexsort((first[owner] + inner, doc[owner], name))
    owner, inner, name = owner[order], inner[order], name[order]
    hit = repeated_windows(data, offsets[owner] + inner, name, length)
    if hit.any():
        d, w = doc[owner[hit]], (first[owner] + inner)[hit]
        order = np.lexsort((w, d))
        d, w = d[order], w[order]
        starts = np.flatnonzero(np.append(True, (d[1:] != d[:-1]) | (w[1:] > w[:-1] + 1)))
        ends = np.append(starts[1:], len(d)) - 1
        pieces = [(d[s], a, min(a + 127, w[e])) for s, e in zip(starts, ends) for a in range(int(w[s]), int(w[e]) + 1, 128)]
        pd_, a, b = (np.array(x, np.int64) for x in zip(*pieces))
        out.append((pd_, pack(a, b, np.zeros(len(a), np.int64), 1)))
    return tuple(np.concatenate(x) for x in zip(*out))


def sorted_runs(segments: DataFrame, length: int) -> DataFrame:
    """doc, run: see ``sort_part``; what is dealt together is sorted together, about STEP_BYTES at a time."""

    def sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in whole_keys(batches, STEP_BYTES):
            key, doc, run = (part.column(i).to_numpy() for i in range(3))
            offsets, data = utf8_of(part.column(3))
            d, r = sort_part(key, doc, run, offsets, data, part.column(4).to_numpy(zero_copy_only=False), length)
            yield table(doc=d, run=r)

    return segments.repartition("deal").sortWithinPartitions("deal", "doc", "run").mapInArrow(sort, "doc long, run long")


def find_windows(bodies: DataFrame, partial: DataFrame, length: int, most: int) -> DataFrame:
    """doc, run: runs of windows that also start earlier, among the runs that share an anchor with others.

    At most about ``most`` runs meet by an anchor.
    """
    # written, so that both sides of the join are plain exchanges, whose large partitions Spark can split
    many = cut(partial.groupBy("key").count().filter(F.col("count") > most), "large-anchors")
    shares = F.ceil(F.col("count") / most)
    dealt = partial.join(many, "key", "left").withColumn("held", F.col("count").isNotNull())
    dealt = dealt.withColumn("deal", F.when(F.col("held"), F.xxhash64("key", F.pmod(F.xxhash64("doc"), shares))).otherwise(F.col("key")))
    marked = dealt.groupBy("doc").agg(F.collect_list(F.struct("run", "deal", "held")).alias("runs"))
    found = cut(sorted_runs(cut_bytes(bodies, marked, length, windows=False), length), "found")
    gone, left = found.filter("run % 2 = 1"), found.filter("run % 2 = 0")
    if left.isEmpty():
        return gone
    left = left.groupBy("doc").agg(F.collect_list(F.struct("run", F.lit(0).cast("long").alias("deal"), F.lit(False).alias("held"))).alias("runs"))
    return gone.unionByName(sorted_runs(cut_bytes(bodies, left, length, windows=True), length))


def utf8_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    wide = column.cast(pa.large_binary())
    offsets = np.frombuffer(wide.buffers()[1], np.int64)[wide.offset : wide.offset + len(wide) + 1]
    data = np.frombuffer(wide.buffers()[2], np.uint8) if wide.buffers()[2] is not None else np.zeros(0, np.uint8)
    return offsets - offsets[0], data[offsets[0] : offsets[-1]]


def whole_keys(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """Rows sorted by their first column, in parts of about ``most`` bytes that no key straddles."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        at = 0
        while at < batch.num_rows:
            key = batch.column(0).to_numpy()
            ends = np.cumsum(np.diff(utf8_of(batch.column(3).slice(at))[0]))
            stop = at + 1 + int(np.searchsorted(ends, max(0, most - size)))
            if held and size >= most and held[-1].column(0)[-1].as_py() != key[at]:
                yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                held, size = [], 0
                continue
            while stop < batch.num_rows and key[stop] == key[stop - 1]:
                stop += 1
            stop = min(stop, batch.num_rows)
            held.append(batch.slice(at, stop - at))
            size += int(ends[stop - at - 1])
            at = stop
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text: str = "text", length: int = 100, gram: int = 32, anchor_runs: int = 2_000, sample_docs: int = 8_192) -> DataFrame:
    """Returns doc_id, n_bytes, spans (array of begin, end) and kept (binary): what is removed of each whole text and what is left.

    A byte goes if a string of ``length`` bytes that covers it also starts
    earlier: in a row with a smaller id, or earlier in the same row. Rows of one
    id are ordered by their text's hash, and null ids come first. Strings are
    judged on the input and do not cross texts. A null text is empty, and a text
    may be of any length. Rows with one id and one text are rows like others,
    of which all but one repeat the one. An empty table gives none. Other
    columns are not read. ``anchor_runs`` is how many runs, about, meet in one
    group of a task; ``sample_docs`` how many documents, about, tell which
    anchors are usual.
    """
    if not 16 <= gram < length <= gram + 127:
        raise ValueError("gram must be at least 16 and less than length, which is at most gram + 127")
    rows = docs.select(F.col(id_col).alias("id"), F.col(text).alias("text"))
    told = rows.agg(F.count("*").alias("rows"), F.count("id").alias("ids"), F.countDistinct("id").alias("distinct")).first()
    plain = told["rows"] == told["ids"] == told["distinct"] and rows.schema["id"].dataType.typeName() in ("long", "integer", "short", "byte")
    if plain:
        numbered = rows.select(F.col("id"), F.col("id").cast("long").alias("doc"), "text")
    else:  # numbers in the order of the ids take their place: those of a later part of the range are larger
        by = [F.col("id").asc_nulls_first(), F.xxhash64("text")]
        ordered = rows.repartitionByRange(*by).sortWithinPartitions(*by)
        numbered = cut(ordered.select("id", F.monotonically_increasing_id().alias("doc"), "text"), "numbered")
    texts = numbered.select("doc", "text")
    runs = cut(find_runs(texts, length, gram, usual_anchors(texts, length, gram, sample_docs)), "runs")
    partial = runs.filter("run % 2 = 0")
    bodies = squeezed(texts)
    found = find_windows(bodies, partial, length, anchor_runs)
    gone = runs.filter("run % 2 = 1").select("doc", "run").unionByName(found).groupBy("doc").agg(F.collect_list("run").alias("gone"))

    def take_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        expand = zstandard.ZstdDecompressor()
        span = pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))
        for batch in batches:
            for i in range(batch.num_rows):
                data = expand.decompress(batch.column(1)[i].as_py())
                runs_ = batch.column(2)[i]
                kept, spans = data, []
                if runs_.is_valid and len(runs_.values):
                    first, last, _, _ = unpack(runs_.values.to_numpy())
                    edge = np.bincount(first, minlength=len(data) + 1) - np.bincount(last + length, minlength=len(data) + 1)
                    removed = np.concatenate(([0], (np.cumsum(edge)[:-1] > 0).astype(np.int8), [0]))
                    turn = np.diff(removed)
                    spans = [{"begin": a, "end": b} for a, b in zip(np.flatnonzero(turn > 0).tolist(), np.flatnonzero(turn < 0).tolist())]
                    kept = np.frombuffer(data, np.uint8)[removed[1:-1] == 0].tobytes()
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, 1), pa.array([len(data)], pa.int64()), pa.array([spans], span), pa.array([kept], pa.binary())], names=["doc", "n_bytes", "spans", "kept"])

    taken = bodies.join(gone, "doc", "left").mapInArrow(take_out, "doc long, n_bytes long, spans array<struct<begin: long, end: long>>, kept binary")
    if plain:
        return taken.withColumnRenamed("doc", "doc_id")
    return taken.join(numbered.select("doc", F.col("id").alias("doc_id")), "doc").select("doc_id", "n_bytes", "spans", "kept")


def op3_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda acc, s: acc + s["end"] - s["begin"])
    out = remove_repeats(docs)
    return out.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
