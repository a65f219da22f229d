"""Mixing sources to target weights by Sainte-Lague apportionment.

Targets come from weights by water-filling under a repeat limit. The words of
all targets are cut into equal blocks; the blocks go to sources by the highest
quotients target / (2 s + 1), a source's blocks go to its shards in the same
way, and each shard reads its quota from its seeded document order, starting
at a seeded block and going round.

Everything is DataFrame work. A source is spread over as many shards as its
words ask for, so a source with a third of all rows is many groups. The only
windows without a partition key run over one row per source, four numbers and a
name, which one task takes for some millions of sources; and one group of a
window holds the shards of a source, ``max_shards`` rows at most: above 10 ** 11
words a source, shards get larger instead of more.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cellwave.llm.store import cut

#: A word: no blank, tab, line feed, vertical tab, form feed or carriage return.
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def seeded(*parts: Column | str) -> Column:
    """A number below 2 ** 60 from the parts, the same on every run and engine."""
    key = F.concat_ws(":", *[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])
    return F.conv(F.substring(F.md5(key), 1, 15), 16, 10).cast("long")


def source_targets(sizes: DataFrame, source: str, size: str, weights: tuple[int, ...] = (1, 2, 3), share: float = 1.0, max_repeat: int = 3) -> DataFrame:
    """One row per source: source_no, source_size, target.

    Sources by code point, nulls last, get the weights in turn. The targets
    share ``share`` of all words by weight; a source that would get more than
    ``max_repeat`` times its size gets just that, and the excess goes to the
    others by weight.
    """
    order = W.orderBy(F.col(source).asc_nulls_last())
    table = sizes.groupBy(source).agg(F.sum(size).alias("source_size")).withColumn("source_no", F.row_number().over(order))
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("source_no") - 1) % len(weights) + 1)
    table = table.withColumn("_weight", weight).withColumn("_cap", F.col("source_size") * max_repeat)
    by_ratio = W.orderBy(F.col("_cap") / F.col("_weight"), "source_no")
    total = F.sum("source_size").over(W.partitionBy()) * F.lit(share)
    full = F.coalesce(F.sum("_cap").over(by_ratio.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    left = F.sum("_weight").over(by_ratio.rowsBetween(0, W.unboundedFollowing))
    table = table.withColumn("_level", (total - full).cast("double") / left)
    # the level of the first source, by ratio, that stays under its limit; it is the highest such level
    level = F.max(F.when(F.col("_level") * F.col("_weight") <= F.col("_cap"), F.col("_level"))).over(W.partitionBy())
    target = F.least(F.col("_cap").cast("double"), F.coalesce(level, F.lit(0.0)) * F.col("_weight"))
    return table.withColumn("target", F.when(F.col("_level") * F.col("_weight") > F.col("_cap"), F.col("_cap").cast("double")).otherwise(target)).select(source, "source_no", "source_size", "target")


def sainte_lague(parties: DataFrame, group: list[str], party: str, votes: str, seats: str, out: str) -> DataFrame:
    """Adds ``out``: the seats each party of a group gets, exactly, without listing all quotients.

    With V votes, N seats and k parties the divisor lies between V / (N + k/2)
    and V / (N - k/2), so that each party's seats are known up to a few. Only
    those few quotients are ranked: about two a party. Parties without votes
    get none; ties go to the smaller party.
    """
    g = W.partitionBy(*group)
    v = F.col(votes).cast("double")
    k = F.count(F.when(v > 0, 1)).over(g)
    total = F.sum(v).over(g)
    n = F.col(seats).cast("double")
    known = parties.withColumn("_low", F.when(v > 0, F.greatest(F.lit(0), F.floor(v * (n - k / 2) / total - 0.5))).otherwise(0).cast("long"))
    known = known.withColumn("_high", F.when(v > 0, F.ceil(v * (n + k / 2) / total + 0.5)).otherwise(0).cast("long"))
    known = known.withColumn("_open", F.col(seats) - F.sum("_low").over(g))
    tries = known.withColumn("_seat", F.explode_outer(F.when(F.col("_high") > F.col("_low"), F.sequence(F.col("_low"), F.col("_high") - 1))))
    rank = F.row_number().over(g.orderBy((v / (2 * F.col("_seat") + 1)).desc_nulls_last(), party))
    won = (F.col("_seat").isNotNull() & (F.col("_rank") <= F.col("_open"))).cast("long")
    gained = tries.withColumn("_rank", rank).groupBy(*parties.columns, "_low").agg(F.sum(won).alias("_won"))
    return gained.withColumn(out, F.col("_low") + F.col("_won")).select(*parties.columns, out)


def mix(docs: DataFrame, id_col: str = "doc_id", text: str = "text", source: str = "source", weights: tuple[int, ...] = (1, 2, 3), share: float = 1.0, max_repeat: int = 3, block_words: int = 16, shard_words: int = 1 << 17, max_shards: int = 1 << 20, seed: str = "mix") -> DataFrame:
    """How many words of each document the mix takes, repeats counted.

    Returns doc_id, source_no, size, source_size, target and taken. Null text
    and text without words have size 0 and nothing taken; a null source is a
    source of its own, the last. Repeated rows are documents like others. No
    rows give no rows. Columns of ``docs`` other than the three named are not
    read, whatever their names.
    """
    sizes = cut(docs.select(F.col(id_col).alias("doc_id"), F.col(source).alias("source"), word_count(F.col(text)).alias("size")), "mix-sizes")
    sources = source_targets(sizes, "source", "size", weights, share, max_repeat)
    whole = F.sum("target").over(W.partitionBy())
    sources = sources.withColumn("_seats", F.greatest(F.round(whole / block_words), F.signum(whole)).cast("long")).withColumn("_all", F.lit(1))
    sources = sainte_lague(sources, ["_all"], "source_no", "target", "_seats", "blocks")
    shards = F.least(F.lit(max_shards), F.greatest(F.lit(1), F.ceil(F.col("source_size") / shard_words)))
    sources = cut(sources.select(F.col("source").alias("_source"), "source_no", "source_size", "target", "blocks", shards.cast("long").alias("_shards")), "mix-sources")
    rows = sizes.join(sources, F.col("source").eqNullSafe(F.col("_source"))).withColumn("shard", F.pmod(seeded(seed + "-shard", F.col("doc_id")), F.col("_shards")))
    quotas = rows.groupBy("source_no", "shard", "blocks").agg(F.sum("size").alias("shard_size"))
    quotas = sainte_lague(quotas, ["source_no"], "shard", "shard_size", "blocks", "quota").select("source_no", "shard", "shard_size", "quota")
    rows = rows.join(quotas, ["source_no", "shard"])
    order = W.partitionBy("source_no", "shard").orderBy(seeded(seed, F.col("doc_id")), "doc_id", "size").rowsBetween(W.unboundedPreceding, 0)
    rows = rows.withColumn("_end", F.sum("size").over(order)).withColumn("_begin", F.col("_end") - F.col("size"))
    size = F.col("shard_size")
    wanted = F.least(F.col("quota") * block_words, size * max_repeat)
    rows = rows.withColumn("_times", F.when(size > 0, F.floor(wanted / size)).otherwise(0)).withColumn("_rest", wanted - F.col("_times") * size)
    first = F.when(size > 0, F.pmod(seeded(seed + "-start", F.col("source_no"), F.col("shard")), F.greatest(F.lit(1), F.ceil(size / block_words))) * block_words).otherwise(0)
    rows = rows.withColumn("_first", first)

    def shared(begin: Column) -> Column:
        return F.greatest(F.lit(0), F.least(F.col("_end"), begin + F.col("_rest")) - F.greatest(F.col("_begin"), begin))

    taken = F.col("_times") * F.col("size") + shared(F.col("_first")) + shared(F.col("_first") - size)
    return rows.select("doc_id", "source_no", "size", "source_size", "target", taken.cast("long").alias("taken"))


def op1_source_mix(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return mix(docs).select("doc_id", "size", "source_size", "target", "taken")
