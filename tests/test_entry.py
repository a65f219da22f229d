import shutil
import subprocess
import sys
from pathlib import Path

import pytest

import __spark_entry__ as entry

ROOT = Path(entry.__file__).resolve().parent


@pytest.mark.parametrize("left", [[], ["corpus_pipeline.py"]])
def test_the_rest_stands_without_the_training_data_operators(tmp_path, left):
    shutil.copytree(ROOT / "cellwave", tmp_path / "cellwave", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    for name in ["__spark_entry__.py", *left]:
        if (ROOT / name).exists():
            shutil.copy(ROOT / name, tmp_path)
    told = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()), 'pipeline' in e.queries())"], cwd=tmp_path, capture_output=True, text=True, timeout=120)
    assert told.returncode == 0, told.stderr
    queries, sql, pipeline = told.stdout.split()
    assert int(queries) == int(sql) >= 60 and pipeline == "False"


def test_every_traffic_query_has_sql(spark):
    from cellwave.plans import registry

    assert set(registry.queries()) == set(registry.oracle_sql()) and len(registry.queries()) >= 60


def test_queries_can_be_listed():
    found = entry.queries()
    assert set(entry.oracle_sql()) <= set(found)


def test_flagship(spark):
    rows = entry.entry(spark).collect()
    assert rows and set(rows[0].asDict()) == {"dataset", "model_id", "rmse", "num_series"}


def test_forecasts_use_the_whole_history(spark, tmp_path):
    import datetime

    first = datetime.datetime(2000, 1, 3)
    rows = [(7, first + datetime.timedelta(weeks=k), float(1000 if k < 200 else 1)) for k in range(300)]
    spark.createDataFrame(rows, "l_suppkey long, l_shipdate timestamp, l_quantity double").write.parquet(f"{tmp_path}/lineitem.parquet")
    made = entry.queries()
    # 299 points before the last, in the order of the file, which mixes the weeks
    points = made["mean_scale"](spark, str(tmp_path)).collect()
    assert len(points) == 299 and made["last_context"](spark, str(tmp_path)).count() == 64
    target = made["score_series"](spark, str(tmp_path)).first()["target"]
    mean = (200 * 1000 + 100 - target) / 299
    assert abs(made["forecast_mean"](spark, str(tmp_path)).first()["prediction"] - mean) < 1e-6
    assert made["forecast_median"](spark, str(tmp_path)).first()["prediction"] == 1000
    assert made["batch_forecast"](spark, str(tmp_path)).first()["value"] == 1000
    got = {r["model_id"]: r["prediction"] for r in made["evaluate_models"](spark, str(tmp_path)).collect()}
    assert abs(got["mean"] - mean) < 1e-6 and got["median"] == 1000


def test_event_queries_use_whole_tables(spark, tmp_path):
    import datetime

    day = datetime.datetime(2025, 1, 3)
    # user 1 is aligned by rows early in the month; user 3 has outputs 5 and 21 of one step
    rows = [(k, 1, "click" if k == 1 else "view", day + datetime.timedelta(hours=k), float(k)) for k in range(1, 5)]
    rows += [(14 * 32 + 5, 3, "view", day, 2.0), (14 * 32 + 21, 3, "view", day, 6.0)]
    spark.createDataFrame(rows, "event_id long, user_id long, event_type string, ts timestamp, value double").write.parquet(f"{tmp_path}/events.parquet")
    made = entry.queries()
    assert made["unaligned_sectors"](spark, str(tmp_path)).count() == 0
    assert {r["prediction"] for r in made["point_mean_outputs"](spark, str(tmp_path)).collect() if r["sector"] == 3} == {4.0}


def test_unaligned_sectors_are_named(spark):
    from cellwave.operators import compare

    coarse = spark.createDataFrame([("a", 1), ("b", 1), ("b", 2), ("c", 3)], "secteur string, dates_5min int")
    fine = spark.createDataFrame([("a", 1), ("b", 2), ("c", 1)], "secteur string, timestamp int")
    assert [r["secteur"] for r in compare.unaligned_sectors(coarse, fine).collect()] == ["c"]
