"""The three jobs, as functions and as commands for spark-submit.

    python -m cellwave.plans.jobs examples HISTORY.csv OUT
    python -m cellwave.plans.jobs generate HISTORY.csv OUT
    python -m cellwave.plans.jobs compare SLOTS_PARQUET INSTANT_PARQUET OUT
"""

from __future__ import annotations

import argparse
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellwave.functions.dates import parse_french_date
from cellwave.functions.numbers import clean_decimal
from cellwave.operators import clean, compare, forecast, generate, score, sectors, series, traffic
from cellwave.sources import examples, reports, traffic as files


def examples_from_history(raw: DataFrame, max_context: int | None = None) -> DataFrame:
    """Examples of an export as it is read: clean, ordered as the file is, one row a sector."""
    return series.build_examples(clean.canonical(raw), max_context=max_context)


def evaluate(examples_: DataFrame, models: tuple[str, ...] | dict[str, str | Callable] = ("last", "mean", "median", "binned"), dataset: str = "original", max_context: int | None = None, seed: int = 0) -> DataFrame:
    """Scored forecasts of every model, built in or one's own by name, on every example, from all points before the last unless ``max_context`` says how many."""
    named = models if isinstance(models, dict) else {m: m for m in models}
    return score.evaluate_forecasters(examples_, named, seed=seed, max_context=max_context).withColumn("dataset", F.lit(dataset))


def slots_from_history(raw: DataFrame) -> DataFrame:
    """An export with its rows in slots of five minutes."""
    typed = clean.drop_blank_rows(raw, [c for c in raw.columns if c != "row_seq"])
    typed = typed.withColumn("tstamp", parse_french_date(F.col("tstamp"))).withColumn("trafic_mbps", clean_decimal(F.col("trafic_mbps")))
    return series.assign_slots(typed)


def instant_from_slots(slots: DataFrame, slot: int = 300, seed: int = 0) -> DataFrame:
    """Generated per-second traffic of every slot that has any traffic figure."""
    stats = traffic.fit_tau_zeta(sectors.sector_cv2(sectors.sector_stats(slots)), slot)
    params = traffic.arrival_params(traffic.slot_variance(slots, stats), slot)
    return generate.generate_seconds(params, slot, seed).select("secteur", "timestamp", "psi_instant")


def compare_with_history(slots: DataFrame, instant: DataFrame) -> DataFrame:
    """Both series per slot, each by its own maximum."""
    return compare.normalize_aligned(compare.align_slots(slots, compare.resample_sum(instant, "5 minutes")))


def main() -> None:
    parser = argparse.ArgumentParser(description=__doc__)
    parser.add_argument("job", choices=["examples", "generate", "compare"])
    parser.add_argument("paths", nargs="+")
    args = parser.parse_args()
    spark = SparkSession.builder.config("spark.sql.session.timeZone", "UTC").getOrCreate()
    *inputs, out = args.paths
    if args.job == "examples":
        examples.write_examples(examples_from_history(files.read_traffic_csv(spark, inputs[0])), f"{out}/examples")
        scored = evaluate(examples.read_examples(spark, f"{out}/examples"))
        reports.write_reports(reports.build_reports(scored), f"{out}/reports")
        summary = score.summary_table(scored).withColumn("parameters", F.lit(None).cast("string"))
        reports.write_summary(score.order_by_list(summary, list(forecast.FORECASTERS)), f"{out}/summary")
    elif args.job == "generate":
        slots = slots_from_history(files.read_traffic_csv(spark, inputs[0]))
        files.write_slots_csv(slots, f"{out}/slots_csv")
        slots.drop("row_seq").write.parquet(f"{out}/slots")
        files.write_instant(instant_from_slots(spark.read.parquet(f"{out}/slots")), f"{out}/instant")
    else:
        compare_with_history(spark.read.parquet(inputs[0]), spark.read.parquet(inputs[1])).write.parquet(out)


if __name__ == "__main__":
    main()
