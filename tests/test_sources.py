"""Readers and writers on files with the awkward cases."""

import datetime as dt
import json

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyframe.operators import clean
from tallyframe.sources import schemas, tables


def test_csv_blank_nan_and_quotes(spark, tmp_path):
    path = tmp_path / "stores.csv"
    path.write_text(
        "Store_Number,AreaStore,Property,Type,Old/New,Checkout Number,Revenue\n"
        '1,10.5,"Owned, in part","Big ""B""",New,,100\n2,NaN,Rental,Small,Old,3,200\n'
    )
    a, b = tables.read_csv_table(spark, str(path), schemas.STORES).orderBy("Store_Number").collect()
    assert (a["Property"], a["Type"], a["Checkout Number"], a["AreaStore"]) == ("Owned, in part", 'Big "B"', None, 10.5)
    assert b["AreaStore"] is None and b["Checkout Number"] == 3


def test_csv_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1, 'a "quoted", text', 1.5), (2, None, None)], "k int, s string, v double")
    tables.write_csv_table(df, str(tmp_path / "out"))
    assert sorted(tables.read_csv_table(spark, str(tmp_path / "out"), df.schema).collect()) == sorted(df.collect())


def test_json_array_and_lines(spark, tmp_path):
    claims = [{"Dauna": "Broken glass"}, {"Dauna": None}, {"Other": 1}]
    (tmp_path / "a.json").write_text(json.dumps(claims, indent=1))
    (tmp_path / "b.json").write_text("\n".join(map(json.dumps, claims)))
    for name, lines in (("a.json", False), ("b.json", True)):
        rows = tables.read_json_records(spark, str(tmp_path / name), schemas.CLAIMS, lines=lines).collect()
        assert [r["Dauna"] for r in rows] == ["Broken glass", None, None]


def test_missing_path_is_refused(spark, tmp_path):
    with pytest.raises(AnalysisException, match="PATH_NOT_FOUND"):
        tables.read_csv_table(spark, str(tmp_path / "none.csv"), schemas.STORES)


def test_literal_rows_are_checked(spark):
    rows = [(1, "ann", ["pen", "book"], 30, "Finalizata"), (2, "bob", [], 5, "In curs")]
    df = tables.literal_table(spark, rows, schemas.ORDERS)
    assert df.select(F.size("items")).collect() == [(2,), (0,)]
    with pytest.raises(Exception):
        tables.literal_table(spark, [("x", "ann", [], 30, "F")], schemas.ORDERS)


def _accident(i, start, end):
    row = {f.name: None for f in schemas.ACCIDENTS.fields}
    return row | {"ID": f"A-{i}", "Severity": i % 4 + 1, "Start_Time": start, "End_Time": end}


def _write(spark, path, rows):
    import csv

    with open(path, "w", newline="") as f:
        out = csv.DictWriter(f, schemas.ACCIDENTS.names)
        out.writeheader()
        out.writerows(rows)


def test_load_events(spark, tmp_path):
    path = str(tmp_path / "events.csv")
    _write(spark, path, [_accident(0, "2020-01-01 00:00:00", "2020-01-01 01:30:15.5"), _accident(1, "bad", "2020-01-01")])
    df = tables.load_events(spark, path, null_label="nan")
    assert isinstance(df.schema["Start_Time"].dataType, T.TimestampNTZType)
    a, b = df.orderBy("ID").collect()
    assert a["Duration"] == pytest.approx(90 + 15.5 / 60) and a["City"] == "nan"
    assert b["Start_Time"] is None and b["Duration"] is None


def test_sample_job_follows_file_order(spark, tmp_path):
    rows = [_accident(i, f"{2016 + i % 3}-05-0{1 + i % 9} 10:00:00.000000000", None) for i in range(300, 0, -1)]
    _write(spark, tmp_path / "in.csv", rows)
    # Splits of a few hundred bytes, which Spark does not schedule in file order.
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    try:
        tables.sample_job(spark, str(tmp_path / "in.csv"), str(tmp_path / "out"), per_year=5)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    got = spark.read.csv(str(tmp_path / "out"), header=True).select("ID", "Start_Time").collect()
    want = {r["ID"] for y in range(3) for r in [r for r in rows if int(r["ID"][2:]) % 3 == y][:5]}
    assert {r["ID"] for r in got} == want and len(got) == 15


def test_strict_times(spark):
    df = spark.createDataFrame([("2020-02-03 04:05:06",), ("03/02/2020",), (None,)], "t string")
    got = [r["t"] for r in clean.parse_timestamp_strict(df, "t", ["dd/MM/yyyy"]).collect()]
    assert got == [dt.datetime(2020, 2, 3, 4, 5, 6), dt.datetime(2020, 2, 3), None]
    with pytest.raises(Exception, match="not a time"):
        clean.parse_timestamp_strict(spark.createDataFrame([("soon",)], "t string"), "t").collect()


def test_held_statistics_keep_zoned_times(spark):
    from tallyframe.plans.sizing import hold_small

    df = spark.sql("SELECT timestamp'2024-03-01 12:30:00' AS t, timestamp_ntz'2024-03-01 12:30:00' AS n, date'2024-03-01' AS d")
    held, bounded = hold_small(df)
    assert bounded and held.schema == df.schema
    assert held.join(df, ["t", "n", "d"]).count() == 1
    assert hold_small(spark.range(5).toDF("k"), 4)[1] is False
