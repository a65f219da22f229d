"""Line dedup by content-defined line chunks.

A polynomial rolling hash over the hashes of lines, two lines wide, goes down
the text, so that each gap between lines has a number that its two lines alone
decide. A gap is a chunk's boundary unless its number is smaller than those of
both gaps next to it; so a passage is cut alike wherever it stands, but for the
gaps next to its ends, and an inserted line moves only boundaries within two
lines of it. This is done under a few seeds, each with its own base. A chunk of
several lines that occurs anywhere else is removed but for its first
occurrence, after its bytes have been compared; what goes is the union over the
seeds. A third of all gaps lies within a chunk under one seed, so a line inside
a repeated passage is found in practice always, and one of two lines that recur
alone, each time between others, under eight seeds in 93 cases of 100.

DataFrame functions only. Keys of chunks, not texts, are shuffled to find what
occurs again, combined before the shuffle, so that a chunk with a third of all
occurrences reaches its reducer once per input task; the joins are ones whose
large partitions Spark splits. Texts are shuffled once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellwave.llm.store import cut

#: A chunk in one number: its first line (from 0) times this, and how many lines it has.
START = 1 << 31

#: Modulus of the rolling hash; larger than all its values.
PRIME = (1 << 31) - 1


def line_hash(line: Column) -> Column:
    """28 bits of a line's MD5, the same on every engine."""
    return F.conv(F.substring(F.md5(line), 1, 7), 16, 10).cast("long")


def base(seed: int) -> int:
    """The rolling hash's base under a seed, a power of a generator of the prime field."""
    return pow(48271, 9 * seed + 9, PRIME)


def chunk_key(low: Column, high: Column, n: Column) -> Column:
    """What chunks with the same lines have in common, from two hashes of each of their lines."""
    return F.xxhash64(low, high, n)


def line_keys(docs: DataFrame, text: str) -> DataFrame:
    """_row and three hashes of each line: one for the boundaries, two for the keys."""
    lines = F.split(text, "\n")
    return docs.filter(F.col(text).isNotNull()).select(
        "_row",
        F.transform(lines, lambda x: line_hash(x).cast("int")).alias("hashes"),
        F.transform(lines, lambda x: F.xxhash64(x)).alias("low"),
        F.transform(lines, lambda x: F.xxhash64(F.lit(1), x)).alias("high"),
    )


def line_chunks(keyed: DataFrame, chunkings: int, min_lines: int) -> DataFrame:
    """_row, chunk and key of every chunk of ``min_lines`` lines and more under any of the seeds.

    The rolling hash of the gap between lines with hashes g and h is
    (g * base + h) modulo ``PRIME``. A gap is no boundary if its number is
    smaller than those of the gaps before and after it (the text's ends count as
    ``PRIME``), or if both its lines have the same hash.
    """
    n = F.size("hashes")
    before = F.concat(F.array(F.lit(None).cast("int")), F.slice("hashes", F.lit(1), n - 1))
    gaps = F.arrays_zip(F.col("hashes").alias("here"), before.alias("before"), F.sequence(F.lit(0), n - 1).alias("at"))
    end = F.array(F.lit(PRIME).cast("long"))

    def roll(s: int):
        return lambda x: F.coalesce((x["before"].cast("long") * base(s) + x["here"]) % PRIME, F.lit(PRIME).cast("long"))

    def places(s: int) -> Column:
        rolled = F.col(f"_rolled{s}")
        around = F.arrays_zip(
            "_gaps",
            rolled.alias("own"),
            F.concat(end, F.slice(rolled, F.lit(1), F.col("n") - 1)).alias("left"),
            F.concat(F.slice(rolled, F.lit(2), F.col("n") - 1), end).alias("right"),
        )

        def begins(x: Column) -> Column:
            same = x["_gaps"]["before"].eqNullSafe(x["_gaps"]["here"])
            return ~(same | ((x["own"] < x["left"]) & (x["own"] < x["right"])))

        return F.transform(F.filter(around, begins), lambda x: x["_gaps"]["at"])

    rolled = keyed.filter(n >= min_lines).select("_row", "low", "high", n.alias("n"), gaps.alias("_gaps"))
    rolled = rolled.select("*", *[F.transform("_gaps", roll(s)).alias(f"_rolled{s}") for s in range(chunkings)])
    starts = rolled.select("_row", "low", "high", "n", *[places(s).alias(f"_starts{s}") for s in range(chunkings)])
    made = []
    for s in range(chunkings):
        begin = F.col(f"_starts{s}")
        both = F.arrays_zip(begin.alias("begin"), F.concat(F.slice(begin, F.lit(2), F.size(begin)), F.array("n")).alias("end"))
        made.append(F.transform(F.filter(both, lambda x: x["end"] - x["begin"] >= min_lines), lambda x: x["begin"].cast("long") * START + x["end"] - x["begin"]))
    codes = starts.select("_row", "low", "high", F.array_distinct(F.flatten(F.array(*made))).alias("_chunks"))

    def told(c: Column) -> Column:
        begin, size = first_line(c) + 1, line_count(c)
        return F.struct(c.alias("chunk"), chunk_key(F.slice("low", begin, size), F.slice("high", begin, size), size).alias("key"))

    return codes.select("_row", F.explode(F.transform("_chunks", told)).alias("_told")).select("_row", "_told.chunk", "_told.key")


def first_line(chunk: Column) -> Column:
    return F.shiftright(chunk, 31).cast("int")


def line_count(chunk: Column) -> Column:
    return chunk.bitwiseAND(START - 1).cast("int")


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text: str = "text", keep: list[str] | None = None, chunkings: int = 8, min_lines: int = 2) -> DataFrame:
    """Returns the columns ``keep`` (by default the id), kept_text, n_lines, removed_lines, removed_chunks.

    A chunk's first occurrence is that of the smallest id (nulls first), then of
    the smallest text hash, then the earliest in the text; so the first
    occurrence of each different line stays. Rows with one id and one text are
    one document, and each such row gets the same result. A null text has no
    lines and kept_text null; an empty text is one empty line. Chunks under
    ``min_lines`` lines stay. Chunks that share a key but not their bytes are
    told apart by their bytes. An empty table gives no rows. Columns of ``docs``
    other than those named are not read; ``keep`` must not hold the names
    returned.
    """
    names = keep or [id_col]
    row = F.struct(F.col(id_col).alias("id"), F.xxhash64(text).alias("hash"))
    rows = docs.select(row.alias("_row"), F.col(text).alias("_text"), *[F.col(c).alias(f"_keep{i}") for i, c in enumerate(names)])
    keyed = cut(line_keys(rows.select("_row", "_text"), "_text"), "line-keys")
    at = F.struct("_row.id", "_row.hash", "chunk").alias("at")
    each = line_chunks(keyed, chunkings, min_lines).select("key", at)
    once = each.groupBy("key").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("times"))
    # written, so that both sides of the join are plain exchanges, whose large partitions Spark can split
    repeated = cut(once.filter(F.col("times") > 1).select("key", "first"), "repeated-chunks")
    found = each.join(repeated, "key").select(F.struct("at.id", "at.hash").alias("_row"), F.struct("at.chunk", "key", (F.col("at") == F.col("first")).alias("stays")).alias("_told"))
    found = found.groupBy("_row").agg(F.collect_set("_told").alias("_found"))
    told = cut(rows.join(found, "_row", "left").select("_row", F.split("_text", "\n").alias("_lines"), "_found", *[f"_keep{i}" for i in range(len(names))]), "lines")

    bodies = F.transform("_found", lambda c: F.struct(c["key"].alias("key"), c["chunk"].alias("chunk"), F.array_join(F.slice("_lines", first_line(c["chunk"]) + 1, line_count(c["chunk"])), "\n").alias("body")))
    bodies = told.filter(F.col("_found").isNotNull()).select("_row", F.explode(bodies).alias("_body")).select("_row", "_body.*")
    compared = bodies.groupBy("key").agg(F.min("body").alias("low"), F.max("body").alias("high"))
    unlike = cut(compared.filter(F.col("low") != F.col("high")).select("key"), "unlike-chunks")
    gone = F.transform(F.filter("_found", lambda c: ~c["stays"]), lambda c: c["chunk"])
    if not unlike.isEmpty():  # practically never: the chunks of these keys once more, by their bytes
        doubtful = bodies.join(unlike, "key").withColumn("at", F.struct("_row", "chunk"))
        firsts = doubtful.groupBy("key", "body").agg(F.min("at").alias("first"))
        again = doubtful.join(firsts, ["key", "body"]).withColumn("goes", F.col("at") != F.col("first"))
        again = again.groupBy("at._row").agg(F.collect_set("chunk").alias("_doubtful"), F.collect_set(F.when(F.col("goes"), F.col("chunk"))).alias("_again"))
        told = cut(told.join(again, "_row", "left"), "lines")
        settled = F.array_except(gone, F.coalesce("_doubtful", F.array().cast("array<bigint>")))
        gone = F.array_union(settled, F.coalesce("_again", F.array().cast("array<bigint>")))
    told = told.withColumn("_gone", F.coalesce(gone, F.array().cast("array<bigint>")))
    covered = F.flatten(F.transform("_gone", lambda c: F.sequence(first_line(c), first_line(c) + line_count(c) - 1)))
    told = told.withColumn("_covered", F.array_distinct(covered))
    kept = F.array_except(F.sequence(F.lit(0), F.size("_lines") - 1), F.col("_covered"))
    kept_text = F.array_join(F.transform(kept, lambda k: F.element_at("_lines", k + 1)), "\n")
    return told.select(
        *[F.col(f"_keep{i}").alias(c) for i, c in enumerate(names)],
        kept_text.alias("kept_text"),
        F.coalesce(F.size("_lines"), F.lit(0)).cast("long").alias("n_lines"),
        F.size("_covered").cast("long").alias("removed_lines"),
        F.size("_gone").cast("long").alias("removed_chunks"),
    )


def op8_line_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    kept = F.sha2(F.coalesce(F.col("kept_text"), F.lit("")).cast("binary"), 256)
    return dedup_lines(docs).select("doc_id", "n_lines", "removed_lines", "removed_chunks", kept.alias("kept_sha256"))


OP8_SQL = f"""
WITH lines AS (
  SELECT doc_id, i, l, ('0x' || substr(md5(l), 1, 7))::BIGINT AS h
  FROM (SELECT doc_id, unnest(ls) AS l, unnest(range(1, len(ls) + 1)) AS i
        FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents WHERE text IS NOT NULL))
), seeded AS (
  SELECT doc_id, i, l, h, s, coalesce((lag(h) OVER w * b + h) % {PRIME}, {PRIME}) AS rolled, lag(h) OVER w = h AS same
  FROM lines, (VALUES {", ".join(f"({s}, {base(s)})" for s in range(8))}) t(s, b) WINDOW w AS (PARTITION BY doc_id, s ORDER BY i)
), marked AS (
  SELECT *, CASE WHEN same OR (rolled < lag(rolled) OVER w AND rolled < coalesce(lead(rolled) OVER w, {PRIME})) THEN 0 ELSE 1 END AS starts
  FROM seeded WINDOW w AS (PARTITION BY doc_id, s ORDER BY i)
), numbered AS (
  SELECT *, sum(starts) OVER (PARTITION BY doc_id, s ORDER BY i) AS chunk_no FROM marked
), chunks AS (
  SELECT DISTINCT doc_id, a, n, body
  FROM (SELECT doc_id, min(i) AS a, count(*) AS n, string_agg(l, chr(10) ORDER BY i) AS body FROM numbered GROUP BY doc_id, s, chunk_no) WHERE n >= 2
), gone AS (
  SELECT doc_id, a, n FROM (SELECT *, row_number() OVER (PARTITION BY body ORDER BY doc_id, a) AS r FROM chunks) WHERE r > 1
), covered AS (
  SELECT DISTINCT doc_id, unnest(range(a, a + n)) AS i FROM gone
), summed AS (
  SELECT l.doc_id, count(*) AS n_lines, count(c.i) AS removed_lines, string_agg(l.l, chr(10) ORDER BY l.i) FILTER (c.i IS NULL) AS kept
  FROM lines l LEFT JOIN covered c ON l.doc_id = c.doc_id AND l.i = c.i GROUP BY l.doc_id
)
SELECT d.doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(removed_lines, 0) AS removed_lines,
       (SELECT count(*) FROM gone g WHERE g.doc_id = d.doc_id) AS removed_chunks, sha256(coalesce(kept, '')) AS kept_sha256
FROM documents d LEFT JOIN summed USING (doc_id)
"""
