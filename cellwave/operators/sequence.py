"""A forecaster that samples: token n-grams counted over all series, with back-off, and seeded paths drawn from them.

Tokens are bins of scaled values (``tokens``). The law of the next token mixes
what follows the last two tokens, the last one, and any; a context that no
series has leaves its share to the next shorter one. Draws are named by seed,
sector, path and step, so paths do not depend on how rows are dealt.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cellwave.functions import draws
from cellwave.operators import tokens
from cellwave.sources import shared

#: More than there are bins: a context of two tokens is one number.
BASE = 1 << 13
#: Up to so many bins, the laws after one token (at most the square of it in numbers) go to every task.
SMALL_BINS = 512
#: Tasks a core that series are dealt to before their paths are drawn.
TASKS_A_CORE = 4
#: Shares of the laws after two tokens, one and none.
SHARES = (0.6, 0.3, 0.1)


def with_previous(binned: DataFrame, sector: str = "sector", order: tuple[str, ...] = ("first_seq", "row_seq")) -> DataFrame:
    """The rows with one and two, the tokens one and two points before, null where a series begins."""
    series = W.partitionBy(sector).orderBy(*order)
    return binned.withColumn("one", F.lag("bin").over(series)).withColumn("two", F.lag("bin", 2).over(series))


def count_grams(rows: DataFrame) -> DataFrame:
    """length, context, bin, n: how often a token follows the last ``length`` tokens, which ``context`` names, in all series of ``with_previous``."""
    seen = [F.struct(F.lit(0).alias("length"), F.lit(0).cast("long").alias("context")), F.when(F.col("one").isNotNull(), F.struct(F.lit(1).alias("length"), F.col("one").cast("long").alias("context")))]
    seen.append(F.when(F.col("two").isNotNull(), F.struct(F.lit(2).alias("length"), (F.col("two").cast("long") * BASE + F.col("one")).alias("context"))))
    each = rows.select("bin", F.explode(F.filter(F.array(*seen), lambda x: x.isNotNull())).alias("c"))
    return each.groupBy("c.length", "c.context", "bin").agg(F.count("*").alias("n"))


def laws(counts: DataFrame) -> DataFrame:
    """length, context, total and upto (array of cumulated count and bin, by bin): a row has as many entries as there are bins at most."""
    upto = F.sum("n").over(W.partitionBy("length", "context").orderBy("bin").rowsBetween(W.unboundedPreceding, 0))
    summed = counts.withColumn("upto", upto)
    return summed.groupBy("length", "context").agg(F.sum("n").alias("total"), F.sort_array(F.collect_list(F.struct("upto", "bin"))).alias("upto"))


def sample_paths(starts: DataFrame, model: DataFrame, samples: int = 32, steps: int = 1, seed: int = 0, bins: int = 256, shares: tuple[float, float, float] = SHARES, sector: str = "sector") -> DataFrame:
    """The rows of ``starts`` (sector, one, two: the last tokens, newest first) with k (path), step (from 1) and bin, for every path and step.

    ``model`` are the ``laws``. Every step looks up the laws after one and two
    tokens; those after two are joined, which Spark can split where a context
    is frequent.
    """
    bounded = F.broadcast if bins <= SMALL_BINS else (lambda table: table)
    none, after_one, after_two = (model.filter(F.col("length") == i).select(F.col("context").alias(f"c{i}"), F.struct("total", "upto").alias(f"law{i}")) for i in range(3))
    kept = starts.columns
    rows = starts.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(samples - 1)))).withColumn("_one", F.col("one")).withColumn("_two", F.col("two")).withColumn("_path", F.array().cast("array<int>"))
    rows = rows.join(F.broadcast(none.select("law0")))  # one row
    for step in range(1, steps + 1):
        rows = rows.withColumn("c1", F.col("_one").cast("long")).withColumn("c2", F.col("_two").cast("long") * BASE + F.col("_one"))
        rows = rows.join(bounded(after_one), "c1", "left").join(after_two, "c2", "left").withColumn("_digits", draws.named(seed, F.col(sector), F.col("k"), step))
        which, where = draws.uniform(F.col("_digits")), draws.uniform(F.col("_digits"), 1)
        two = (which < shares[0]) & F.col("law2").isNotNull()
        one = (which < shares[0] + shares[1]) & F.col("law1").isNotNull()
        rows = rows.withColumn("_law", F.when(two, F.col("law2")).when(one, F.col("law1")).otherwise(F.col("law0")))
        rows = rows.withColumn("_at", F.floor(where * F.col("_law.total")))
        rows = rows.withColumn("_next", F.element_at(F.filter("_law.upto", lambda x: x["upto"] > F.col("_at")), 1)["bin"])
        rows = rows.select(*kept, "k", "law0", F.col("_next").alias("_one"), F.col("_one").alias("_two"), F.array_append("_path", F.col("_next")).alias("_path"))
    # not an explode of the path: Spark would filter by its size first, and so draw every step again
    rows = rows.select(*kept, "k", "_path", F.explode(F.sequence(F.lit(1), F.lit(steps))).alias("step"))
    return rows.select(*kept, "k", "step", F.get("_path", F.col("step") - 1).alias("bin"))


def sequence_forecasts(context: DataFrame, samples: int = 32, steps: int = 1, seed: int = 0, model_id: str = "sequence", bins: int = 256, low: float = -15.0, high: float = 15.0, sector: str = "sector", value: str = "trafic_mbps", order: tuple[str, ...] = ("first_seq", "row_seq")) -> DataFrame:
    """model_id, sector, k, level (null), step, value: ``samples`` paths of ``steps`` points for every series of ``context``.

    ``context`` has a row for each point of a series but those to be forecast.
    Values are scaled by their series' mean, cut into ``bins``, and put back.
    The model is counted over all series. Points and laws are written in the
    shared folder; the series are dealt to several tasks a core before they
    become paths.
    """
    if not 1 < bins < BASE:
        raise ValueError(f"bins must be between 2 and {BASE - 1}")
    binned = tokens.quantize(tokens.mean_scale(context, value, sector), bins, low, high)
    rows = with_previous(binned.select(F.col(sector).alias("sector"), *order, "scale", "bin"), "sector", order)
    ends = F.lead(F.lit(True)).over(W.partitionBy("sector").orderBy(*order)).isNull()
    # both are read more than once: the points for the laws and for the starts, the laws three times a step
    rows = shared.stored(rows.select("sector", "scale", "bin", "one", "two", ends.alias("ends")), "grams")
    model = shared.stored(laws(count_grams(rows)), "laws")
    tasks = TASKS_A_CORE * rows.sparkSession.sparkContext.defaultParallelism
    last = rows.filter("ends").select("sector", "scale", F.col("bin").alias("one"), F.col("one").alias("two")).repartition(tasks, "sector")
    paths = sample_paths(last, model, samples, steps, seed, bins)
    made = tokens.dequantize(paths, bins, low, high, out="value")
    return made.select(F.lit(model_id).alias("model_id"), F.col("sector").alias(sector), "k", F.lit(None).cast("double").alias("level"), "step", "value")


def levels_of_samples(forecasts: DataFrame, keys: tuple[str, ...] = ("model_id", "sector")) -> DataFrame:
    """The forecasts with level, the share of a step's samples that a sample ends in the middle of, and k by value: quantiles from samples."""
    step = W.partitionBy(*keys, "step")
    rank = F.row_number().over(step.orderBy("value", "k"))
    ranked = forecasts.withColumn("_rank", rank).withColumn("_n", F.count("*").over(step))
    return ranked.withColumn("k", (F.col("_rank") - 1).cast("int")).withColumn("level", (F.col("_rank") - 0.5) / F.col("_n")).drop("_rank", "_n")
