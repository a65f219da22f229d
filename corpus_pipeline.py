"""A corpus pipeline of five stages over ``documents``.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written
as Parquet and read again as the next stage's docs. All but the last return the
columns of ``documents``. Other columns are dropped, whatever their names, and
an empty table gives an empty one in every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellwave.llm import bpe, linededup, mixing, ngramjoin, toxicity
from cellwave.llm.idmap import part_by_map
from cellwave.llm.store import cut

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents whose score is 0.3 or more.

    A null or empty text has a score like any other; rows of one id or with a
    null id are judged one by one. Labels come from the table ``labels``.
    """
    model = toxicity.learn_from_tables(spark, docs, sf_dir)
    scored = toxicity.score(docs, model, COLUMNS)
    return scored.filter("score < 0.3").select(*COLUMNS)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes repeated chunks of two and more lines out of the texts, and drops documents of which nothing is left.

    A null text stays null, an empty one empty. Rows with one id and one text
    are one document and all stay; of unlike texts with one id, or with a null
    id, one comes before the other.
    """
    kept = linededup.dedup_lines(docs, keep=["doc_id", "lang", "source", "n_chars"])
    left = kept.filter((F.col("removed_lines") == 0) | (F.length(F.trim("kept_text")) > 0))
    n_chars = F.when(F.col("removed_lines") == 0, F.col("n_chars")).otherwise(F.char_length("kept_text").cast("long"))
    return left.select("doc_id", F.col("kept_text").alias("text"), "lang", "source", n_chars.alias("n_chars"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document, that with the least id, of each group linked by five-word shingles at 0.8 or more.

    Texts that are null or without words and rows with a null id link with
    nothing and stay. Rows of one id are one document: of those with one text
    one stays.
    """
    groups = cut(ngramjoin.near_groups(docs, n=5, percent=80), "groups")
    others = cut(groups.filter("component_id is not null and doc_id <> component_id").select("doc_id").distinct(), "others")
    # only rows that may go are shuffled
    may_go, stays = part_by_map(docs.select(*COLUMNS), others)
    kept = stays.unionByName(may_go.join(others, "doc_id", "left_anti"))
    often = cut(groups.filter("doc_id is not null").groupBy("doc_id").count().filter("count > 1").select("doc_id"), "repeated-ids")
    if often.isEmpty():
        return kept
    return kept.join(often, "doc_id", "left_anti").unionByName(kept.join(often, "doc_id", "left_semi").dropDuplicates(["doc_id", "text"]))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats each document as many times as the mix takes it; what is taken in part is rounded.

    Documents without words, null texts among them, stay once. Rows of one id
    are all repeated alike, and so are those with a null id. A null source is a
    source of its own.
    """
    taken = mixing.mix(docs).select("doc_id", "size", "taken").groupBy("doc_id").agg(F.max(F.when(F.col("size") > 0, F.round(F.col("taken") / F.col("size"))).otherwise(1)).cast("int").alias("_times"))
    rows = docs.select(*COLUMNS).join(taken.withColumnRenamed("doc_id", "_id"), F.col("doc_id").eqNullSafe(F.col("_id"))).filter("_times > 0")
    return rows.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_times")))).select(*COLUMNS)


def encode_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, ids, decoded_sha256 (of what the ids decode to) and n_tokens of every row the mix holds; a null text counts as empty and has no ids."""
    path = bpe.default_tokenizer()
    encoded = bpe.encode_checked(docs, path, bpe.build_lexicon(docs, path), ["doc_id", "source"])
    return encoded.withColumn("n_tokens", F.size("ids").cast("long"))


STAGES = [
    ("toxicity", drop_toxic),
    ("line dedup", drop_repeated_lines),
    ("n-gram Jaccard join", drop_near_copies),
    ("mixing sources to target weights", mix_sources),
    ("BPE encoding and decoding", encode_tokens),
]

#: A fitted classifier is no SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = cut(docs, f"stage-{i}")
    return docs
