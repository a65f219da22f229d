import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from cellwave.functions import search
from cellwave.functions.dates import parse_french_date
from cellwave.functions.freedates import parse_free_date
from cellwave.operators import compare, forecast, traffic
from cellwave.sources import shared, traffic as files

FREE = [
    "18 June 2018", "June 18, 2018", "Mon 18 Jun 2018 10:30", "18/06/18", "18.06.2018 07:05:09", "20180618", "2018/06/18", "2018/06/05", "18-Jun-2018 3:07 pm", "18th of June 2018",
    "Monday, June 18 2018 at 12:05 am", "2018 June 18", "5/13/2018", "1/2/03", "18 Jun 68", "18-Jun-99", "99-Jun-18", "June 2018 18", "201806181030", "20180618103045", "18 june 2018 3pm",
    "18 june 2018 7h05", "18 june 2018 07h", "2018-06-18T10:30:00.25", "29 feb 2020", "Sept 3 2018", "18 2018 june", "tue 5 june, 2018; 10:15:20,5",
]
NO_DATES = ["18 juin 2018", "45 June 2018", "29 feb 2019", "18 june 2018 13 pm", "18 june 2018 10:61", "18 june 2018 25:00", "18 june 2018 !", "june 2018", "", "abc", None, "x" * 100_000, "1 " * 10_000]


def test_free_dates_are_what_a_free_parser_reads(spark):
    parser = pytest.importorskip("dateutil.parser")
    df = spark.createDataFrame(list(enumerate(FREE + NO_DATES)), "i int, v string")
    got = {r["i"]: r["x"] for r in df.select("i", parse_free_date(F.col("v")).alias("x")).collect()}
    for i, text in enumerate(FREE):
        assert got[i] == parser.parse(text, dayfirst=True), text
    assert all(got[i] is None for i in range(len(FREE), len(got)))


def test_french_dates_fall_back_to_the_grammar(spark):
    df = spark.createDataFrame([("lundi 18 juin 2018",), ("Mon 18 Jun 2018 10:30",), ("18th of June 2018",)], "v string")
    got = [r["x"] for r in df.select(parse_french_date(F.col("v")).alias("x")).collect()]
    assert got == [datetime.datetime(2018, 6, 18), datetime.datetime(2018, 6, 18, 10, 30), datetime.datetime(2018, 6, 18)]


def test_years_of_two_digits(spark):
    df = spark.createDataFrame([("1 may 70",), ("1 may 71",)], "v string")
    assert [r["y"] for r in df.select(F.year(parse_free_date(F.col("v"), F.lit(2021))).alias("y")).collect()] == [2070, 1971]


def test_nearest_takes_the_first_of_equals(spark):
    values, ranks = [1.0, 1.0, 2.0, 4.0], [3, 1, 2, 0]
    xs = [0.0, 1.5, 2.9, 3.0, 9.0, 1e17, None]
    df = spark.createDataFrame(list(enumerate(xs)), "i int, x double")
    got = [r["r"] for r in df.orderBy("i").select(search.nearest(F.col("x"), values, ranks).alias("r")).collect()]
    assert got == [1, 1, 2, 0, 0, 0, None]


def test_fit_of_extreme_ratios_without_python(spark):
    axis = np.linspace(0.05, 1, 40)
    tau, zeta = np.repeat(axis, 40), np.tile(axis, 40)
    least = (2 * zeta) / (tau * 300 * (tau + zeta))
    xs = [1e-300, 1e-9, 1e3, 1e10, 1e15, 1e17, *least[::37].tolist()]
    fitted = traffic.fit_tau_zeta(spark.createDataFrame([(i, 1.0, x) for i, x in enumerate(xs)], "i int, mu double, var double"))
    for r in fitted.collect():
        k = int(np.abs(xs[r["i"]] - least).argmin())
        assert np.allclose((r["tau"], r["zeta"]), (tau[k], zeta[k]), atol=1e-12), xs[r["i"]]
    plan = fitted._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Join" not in plan


def test_files_of_several_dialects(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes('secteur;tstamp;trafic_mbps\nA;lundi 6 août 2018;1,5\n\n"B;x";t;"2 ""Mbps"""\n'.encode("latin-1"))
    (tmp_path / "b.csv").write_bytes('"sec;;;;teur",secteur,tstamp\n"u;v",C,"x, y"\n'.encode("latin-1"))
    (tmp_path / "c.csv").write_bytes(b"")
    (tmp_path / "d.csv").write_bytes(b"secteur;tstamp;trafic_mbps\r\nD;t\r\n")
    got = files.read_traffic_csv(spark, str(tmp_path)).orderBy("row_seq")
    assert got.columns == ["sec;;;;teur", "secteur", "tstamp", "trafic_mbps", "row_seq"] and dict(got.dtypes)["row_seq"] == "bigint"
    assert [tuple(r) for r in got.collect()] == [(None, "A", "lundi 6 août 2018", "1,5", 1), (None, "B;x", "t", '2 "Mbps"', 3), ("u;v", "C", "x, y", None, 5), (None, "D", "t", None, 7)]
    (tmp_path / "none").mkdir()
    (tmp_path / "none" / "x.csv").write_bytes(b"")
    with pytest.raises(ValueError):
        files.read_traffic_csv(spark, str(tmp_path / "none"))


def test_lines_are_numbered_over_blocks(spark, tmp_path):
    for name, n in (("a", 4000), ("b", 500)):
        (tmp_path / f"{name}.csv").write_text("secteur,tstamp\n" + "".join(f"{name}{i},t\n" for i in range(n)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        rows = files.read_traffic_csv(spark, str(tmp_path)).collect()
        blocks = files.numbered_lines(spark, str(tmp_path), "UTF-8")[1].count()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert blocks > 5
    assert {r["secteur"]: r["row_seq"] for r in rows} == {f"a{i}": i + 1 for i in range(4000)} | {f"b{i}": 4002 + i for i in range(500)}


def test_a_range_opens_only_its_files(spark, tmp_path):
    day = datetime.datetime(2025, 1, 1)
    rows = [(f"s{s}", day + datetime.timedelta(minutes=i), float(i)) for s in range(4) for i in range(2000)]
    df = spark.createDataFrame(rows, "secteur string, timestamp timestamp, psi_instant double")
    path, index = str(tmp_path / "i"), str(tmp_path / "index")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        files.write_instant(df, path)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    files.write_range_index(spark.read.parquet(path), index)
    a, b = day + datetime.timedelta(minutes=100), day + datetime.timedelta(minutes=130)
    bounds = spark.createDataFrame([("s1", a, b), ("none", a, b)], "secteur string, from timestamp, to timestamp")
    part = files.read_instant_range(spark, path, index, bounds)
    assert len(spark.read.parquet(path).inputFiles()) == 16 and 1 <= len(part.inputFiles()) <= 2
    coarse = bounds.select("secteur", F.explode(F.array("from", "to")).alias("dates_5min"))
    assert sorted(map(tuple, compare.clip_to_range(part, coarse).collect())) == sorted(map(tuple, compare.clip_to_range(df, coarse).collect())) != []
    assert files.read_instant_range(spark, path, index, bounds.limit(0)).count() == 0


def test_co_located_tables_are_joined_without_an_exchange(spark):
    rows = [(f"s{i % 9}", i % 50, float(i)) for i in range(300)]
    coarse = spark.createDataFrame(rows, "secteur string, dates_5min int, trafic_mbps double").dropDuplicates(["secteur", "dates_5min"])
    fine = coarse.select("secteur", F.col("dates_5min").alias("timestamp"), (F.col("trafic_mbps") + 1).alias("psi_instant"))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        left = files.write_co_located(coarse, "coarse", 4, time="dates_5min")
        right = files.write_co_located(fine, "fine", 4)
        made = compare.normalize_aligned(compare.align_slots(*files.read_co_located(spark, left, right)))
        got = sorted(map(tuple, made.collect()))
        plan = made._jdf.queryExecution().executedPlan().toString()
        plain = sorted(map(tuple, compare.normalize_aligned(compare.align_slots(coarse, fine)).collect()))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
        spark.conf.unset("spark.sql.requireAllClusterKeysForCoPartition")
    assert "Exchange" not in plan and "SortMergeJoin" in plan
    assert got == plain and len(got) == coarse.count()
    shared.clear_stored(spark)


def test_outputs_of_every_shape(spark):
    rng = np.random.default_rng(1)
    arrays = {"scalar": np.array(3.5), "one": rng.random(5), "two": rng.random((4, 3)), "three": rng.random((2, 4, 3)), "single": rng.random((1, 4, 3))}
    rows = [(name, "s", *[*at, None, None, None][:3], float(x)) for name, a in arrays.items() for at, x in np.ndenumerate(a)]
    df = spark.createDataFrame(rows, "model_id string, sector string, i0 int, i1 int, i2 int, value double")
    got = {r["model_id"]: r["prediction"] for r in forecast.point_from_outputs(df).collect()}
    want = {"scalar": 3.5, "one": arrays["one"][-1], "two": arrays["two"].mean(axis=0)[-1], "three": arrays["three"][0].mean(axis=0)[-1], "single": arrays["single"][0].mean(axis=0)[-1]}
    assert got == pytest.approx(want)


def test_csv_lines_are_not_shuffled(spark, tmp_path):
    for i in range(3):
        (tmp_path / f"{i}.csv").write_text("a;b\n" + "".join(f"{i};{j}\n" for j in range(50)))
    got = files.read_traffic_csv(spark, str(tmp_path))
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("SortMergeJoin", "SortAggregate", "Exchange hashpartitioning"))
    assert sorted((r["a"], r["b"], r["row_seq"]) for r in got.collect()) == sorted((str(i), str(j), 51 * i + j + 1) for i in range(3) for j in range(50))


def test_a_file_in_parts(spark, tmp_path):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        for name in ("x", "y"):
            rows = spark.range(400).select(F.concat(F.lit(name), F.col("id").cast("string")).alias("a"), F.lit('1, "2"').alias("b"), (-F.col("id")).alias("n"))
            files.write_file_in_parts(rows.repartition(5), str(tmp_path / name), "n", ",")
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    written = [sorted((tmp_path / name).glob("part-*")) for name in ("x", "y")]
    assert all(len(w) > 1 for w in written)  # no task writes it all
    assert "".join(p.read_text() for p in written[0]).splitlines()[:2] == ["a,b", 'x399,"1, ""2"""']
    got = files.read_traffic_csv(spark, str(tmp_path / "*"), parts=True).collect()
    assert sorted((r["row_seq"], r["a"], r["b"]) for r in got) == [(401 * k + i + 1, f"{name}{399 - i}", '1, "2"') for k, name in enumerate("xy") for i in range(400)]
