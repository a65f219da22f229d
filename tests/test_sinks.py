import numpy as np
import pytest
from pyspark.sql import functions as F

from cellwave.operators import compare, score, sectors, series
from cellwave.plans import jobs
from cellwave.sources import examples, reports, traffic as files
from tests.test_traffic import history


def test_instant_is_sorted_within_files(spark, tmp_path):
    rows = [(f"s{i % 7}", i * 37 % 100) for i in range(500)]
    df = spark.createDataFrame(rows, "secteur string, s int").withColumn("timestamp", F.timestamp_seconds("s")).withColumn("psi_instant", F.lit(1.0))
    files.write_instant(df, str(tmp_path / "i"))
    back = spark.read.parquet(str(tmp_path / "i"))
    assert back.count() == 500
    for part in back.rdd.map(lambda r: (r["secteur"], r["timestamp"])).glom().collect():
        assert part == sorted(part)


def test_summary_file(spark, tmp_path):
    summary = spark.createDataFrame([("b", 2.0, "9M"), ("a", 1.0, None)], "model_id string, rmse double, parameters string")
    reports.write_summary(score.order_by_list(summary, ["b", "a"]), str(tmp_path / "s"))
    parts = list((tmp_path / "s").glob("*.csv"))
    assert len(parts) == 1 and parts[0].read_text().splitlines()[:2] == ["model_id,rmse,parameters", "b,2.0,9M"]


def test_slots_to_instant_files(spark, tmp_path):
    slots = history(spark, 2, 4).withColumn("tstamp", F.date_format("tstamp", "dd/MM/yyyy")).withColumn("trafic_mbps", F.col("trafic_mbps").cast("string"))
    made = jobs.slots_from_history(slots)
    files.write_instant(jobs.instant_from_slots(made, seed=3), str(tmp_path / "i"))
    assert spark.read.parquet(str(tmp_path / "i")).count() == 2 * 4 * 300


def test_no_examples_are_an_error(spark, tmp_path):
    empty = history(spark, 1, 3).limit(0)
    df = empty.withColumnRenamed("secteur", "sector").withColumn("timestamp_iso", F.lit("x")).withColumn("row_seq", F.lit(1))
    with pytest.raises(ValueError):
        examples.write_examples(series.build_examples(df), str(tmp_path / "e"))
    assert not (tmp_path / "e").exists()


def test_large_reports_come_in_parts(spark, tmp_path):
    rows = [("original", m, f"s{i}", "x", 1.0, 1.0 + i, float(i * i)) for m in "ab" for i in range(50)]
    scored = spark.createDataFrame(rows, "dataset string, model_id string, sector string, site string, target double, prediction double, squared_error double")
    made = reports.build_reports(scored, stamp="t", most_series=10)
    assert made.count() > 6 and {r["num_series"] for r in made.collect()} == {50}
    reports.write_reports(made, str(tmp_path / "r"))
    back = reports.read_reports(spark, str(tmp_path / "r"))
    assert back.count() == 100 and back.select("rmse").distinct().count() == 1 and {r["dataset"] for r in back.collect()} == {"original"}
    assert reports.build_reports(scored, stamp="t").count() == 2


def test_own_forecasters(spark):
    rows = [("a", "x", [1.0, 2.0, 3.0], 5.0), ("b", "x", [4.0], 4.0)]
    df = spark.createDataFrame(rows, "sector string, site string, context array<double>, target double")
    loaded = lambda: lambda contexts, samples, seed: np.array([[c.sum(), c.max()] for c in contexts])
    got = {(r["model_id"], r["sector"]): (r["prediction"], r["squared_error"]) for r in score.evaluate_forecasters(df, {"own": loaded, "last": "last"}).collect()}
    assert got == {("own", "a"): (4.5, 0.25), ("own", "b"): (4.0, 0.0), ("last", "a"): (3.0, 4.0), ("last", "b"): (4.0, 0.0)}
    assert {r["model_id"] for r in jobs.evaluate(df, {"own": loaded}).collect()} == {"own"}


def test_gaps_are_filled(spark):
    rows = [("a", "2025-01-01 00:01:00", 1.0), ("a", "2025-01-01 00:21:00", 2.0), ("a", "2025-01-01 00:22:00", None), ("b", "2025-01-01 00:00:00", None)]
    df = spark.createDataFrame(rows, "secteur string, timestamp string, psi_instant double").withColumn("timestamp", F.to_timestamp("timestamp"))
    assert compare.resample_sum(df).count() == 3
    filled = compare.resample_sum(df, fill=True).orderBy("secteur", "timestamp").collect()
    assert [r["psi_instant"] for r in filled] == [1.0, 0.0, 0.0, 0.0, 2.0, 0.0]


def test_choices(spark):
    h = history(spark, 3, 6)
    top = sectors.top_variable_sectors(h, 2)
    assert top.count() == 2 and sectors.subset_sectors(h, top).count() == 12
    assert [r["secteur"] for r in sectors.first_sectors(h, 2).collect()] == ["S0", "S1"]
    one = sectors.sector_stats(h.limit(1)).first()
    assert one["var"] is None and one["n"] == 1
