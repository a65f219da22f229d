import pytest
from pyspark.sql import functions as F

from cellwave.functions import dates, numbers
from cellwave.operators import clean
from cellwave.plans import jobs
from cellwave.sources import examples, reports, traffic as files


def column(spark, values, f):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r["x"] for r in df.select("i", f(F.col("v")).alias("x")).orderBy("i").collect()]


def test_french_date_to_iso(spark):
    given = ["lundi 18 juin 2018", "  mardi  13   FÉVRIER 2018", "lundi 6 aout 2018", "18 juin 2018", "lundi 45 juin 2018", "lundi 1 brumaire 2018", "lundi x juin 2018", None, "", "a b c lundi 7 août 2020"]
    assert column(spark, given, dates.french_date_to_iso) == ["2018-06-18", "2018-02-13", "2018-08-06", "18 juin 2018", "2018-06-45", "lundi 1 brumaire 2018", "lundi x juin 2018", None, "", "2020-08-07"]


def test_parse_french_date(spark):
    given = ["lundi 6 août 2018", "lundi 6 AOÛT 2018", "lundi 6 aout 2018", "lundi 31 février 2018", "13/01/2025", "02/01/2025 10:30", "2025-01-02", "abc", None, ""]
    got = [None if x is None else x.strftime("%Y-%m-%d %H:%M") for x in column(spark, given, dates.parse_french_date)]
    assert got == ["2018-08-06 00:00", "2018-08-06 00:00", None, None, "2025-01-13 00:00", "2025-01-02 10:30", "2025-01-02 00:00", None, None, None]


def test_normalize_timestamp(spark):
    given = ["lundi 18 juin 2018", "2025-01-01 00:00:00", "2025-01-01T00:00:00", "02/01/2025 00:00", "13/01/2025 00:00", "2025-01-01 00:00:00.5", "20250103", "99", None]
    assert column(spark, given, dates.normalize_timestamp) == ["2018-06-18", "2025-01-01T00:00:00", "2025-01-01T00:00:00", "2025-02-01T00:00:00", "2025-01-13T00:00:00", "2025-01-01T00:00:00.500000", "2025-01-03T00:00:00", "99", None]


def test_numbers(spark):
    given = ["12,5", "12.5", " 1.5 ", "1e3", "1.234,5", "1 234,5", "", "nan", "inf", "1d", "abc", None, "12,5 Mbps"]
    assert column(spark, given, numbers.clean_decimal) == [12.5, 12.5, 1.5, 1000.0, None, 1234.5, None, None, None, 1.0, None, None, 12.5]
    assert column(spark, given, numbers.to_number) == [None, 12.5, 1.5, 1000.0, None, None, None, None, float("inf"), None, None, None, None]


def test_standardize(spark):
    df = spark.createDataFrame([("a", "t", 1.0)], "secteur string, tstamp string, psi_instant double")
    assert clean.standardize_columns(df).first().asDict() == {"sector": "a", "timestamp": "t", "value": 1.0, "site": "a"}
    with pytest.raises(ValueError):
        clean.standardize_columns(df.drop("tstamp"))


CSV = """secteur;site;tstamp;trafic_mbps
X001A;X001;lundi 18 juin 2018;12.5
X001A;X001;lundi 25 juin 2018;13.25
X001B;X001;lundi 6 août 2018;7
X001B;X001;lundi 25 juin 2018;5
X001B;X001;mardi 13 FÉVRIER 2018;abc
;;;
X002A;X002;lundi 18 juin 2018;7.0
X001A;X001;lundi 6 août 2018;11.0
"""


def test_examples_from_csv(spark, tmp_path):
    path = tmp_path / "history.csv"
    path.write_bytes(CSV.encode("latin-1"))
    raw = files.read_traffic_csv(spark, str(path))
    assert files.sniff_separator(spark, str(path)) == ";"
    made = jobs.examples_from_history(raw)
    examples.write_examples(made, str(tmp_path / "e"))
    rows = {r["sector"]: r for r in examples.read_examples(spark, str(tmp_path / "e")).collect()}
    assert set(rows) == {"X001A", "X001B"}
    assert rows["X001A"]["context"] == [12.5, 13.25] and rows["X001A"]["target"] == 11.0 and rows["X001A"]["context_length"] == 2
    # the file shows 25 juin before 6 août
    assert rows["X001B"]["timestamps"] == ["2018-06-25", "2018-08-06"] and rows["X001B"]["target"] == 7.0
    (tmp_path / "none").mkdir()
    (tmp_path / "none" / "x.json").write_text("\n\n")
    with pytest.raises(ValueError):
        examples.read_examples(spark, str(tmp_path / "none"))
    scored = jobs.evaluate(made)
    table = reports.build_reports(scored, stamp="2025-01-01T00:00:00")
    reports.write_reports(table, str(tmp_path / "r"))
    back = reports.read_reports(spark, str(tmp_path / "r"))
    assert back.count() == 8 and {r["dataset"] for r in back.collect()} == {"original"}
    wrong = back.filter("abs(squared_error - (prediction - target) * (prediction - target)) > 1e-9").count()
    assert wrong == 0


def test_report_names(spark, tmp_path):
    for spelt, meant in (("orignal", "original"), ("intant_short", "instant_short"), ("instant", "instant"), ("instant_short", "instant_short")):
        folder = tmp_path / spelt
        folder.mkdir()
        (folder / f"eval_a__b_{spelt}.json").write_text('{\n"model_id": "a/b", "num_series": 1, "rmse": 2.0,\n "per_series": [{"sector": "s", "site": "t", "target": 0.0, "prediction": 2.0, "squared_error": 4.0}]\n}')
        rows = reports.read_reports(spark, str(folder)).collect()
        assert [r["dataset"] for r in rows] == [meant]
    with pytest.raises(ValueError):
        reports.normalize_dataset("other")


def test_slots_csv(spark, tmp_path):
    path = tmp_path / "history.csv"
    path.write_bytes(CSV.encode("latin-1"))
    slots = jobs.slots_from_history(files.read_traffic_csv(spark, str(path)))
    files.write_slots_csv(slots, str(tmp_path / "out"))
    back = spark.read.csv(str(tmp_path / "out"), sep=";", header=True)
    assert back.columns == files.SLOT_COLUMNS and back.count() == 7
    rows = {(r["secteur"], r["tstamp"]): r["dates_5min"] for r in back.collect()}
    assert rows["X001A", "06/08/2018"] == "01/01/2025 00:10"


def test_no_break_spaces(spark):
    given = ["lundi\u00a018 juin 2018", "\u202flundi 18\u202fjuin\u00a0 2018\u00a0", "lundi\u200918 juin 2018"]
    assert column(spark, given, dates.french_date_to_iso)[:2] == ["2018-06-18"] * 2
    assert [x and x.strftime("%Y-%m-%d") for x in column(spark, given, dates.parse_french_date)][:2] == ["2018-06-18"] * 2
