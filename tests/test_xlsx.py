"""Workbooks: cells of every kind, sheets as partitions, filters and columns in the reader, sheet names."""

import datetime
import decimal
import zipfile

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from wordrate.sources import xlsx


@pytest.fixture(scope="module", autouse=True)
def source(spark):
    xlsx.register(spark)


def book(tmp_path, sheets, name="a.xlsx"):
    xlsx.write_workbook_sheets(str(tmp_path / name), sheets)
    return str(tmp_path)


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.characters(exclude_categories=["Cs"]), max_size=20) | st.sampled_from(["_x000D_", "__x0041_x0042_", "_x00", "\r\n", "\x0b", "", " a "]))
def test_any_text_survives(text):
    from xml.etree import ElementTree as ET
    cell = ET.fromstring(f'<c xmlns="{xlsx._NS["m"]}"' + xlsx._cell("A1", text)[2:])
    assert xlsx._value(cell, []) == text


def test_kinds_of_cells(spark, tmp_path):
    rows = [(2**62 + 1, "a\r\nb", True, 1.5, decimal.Decimal("12.340"), datetime.date(2024, 2, 29), datetime.datetime(2024, 1, 2, 3, 4, 5), ""),
            (None, None, None, None, None, None, None, None), (-3, "\x0b_x0041_", False, -0.0, decimal.Decimal("0.001"), datetime.date(1, 1, 1), datetime.datetime(1970, 1, 1), "é\U0001f600")]
    schema = "n long, t string, b boolean, d double, m decimal(9,3), day date, at timestamp_ntz, e string"
    df = spark.createDataFrame(rows, schema).coalesce(1)
    out = str(tmp_path / "out")
    df.write.format("xlsx").mode("append").save(out)
    back = spark.read.format("xlsx").schema(schema).load(out).collect()
    assert sorted(map(repr, map(tuple, back))) == sorted(map(repr, rows))


def test_a_task_per_workbook_and_sheet(spark, tmp_path):
    for name in ("a.xlsx", "b.xlsx"):
        book(tmp_path, [(f"s{i}", ["k", "v"], [(i, f"{name}{i}")] * 3) for i in range(5)], name)
    read = spark.read.format("xlsx").schema("k long, v string, sheet string").option("sheet", "*")
    assert read.load(str(tmp_path)).rdd.getNumPartitions() == 2 and read.load(str(tmp_path)).count() == 30  # small sheets go together
    df = read.option("partitionBytes", 1).load(str(tmp_path))
    assert df.withColumn("p", F.spark_partition_id()).agg(F.countDistinct("p"), F.count(F.lit(1))).first()[:] == (10, 30)
    some = spark.read.format("xlsx").schema("k long, v string, sheet string").option("sheet", "*").option("partitionBytes", 1).option("sheets", '["s3", "none"]').load(str(tmp_path))
    assert sorted(map(tuple, some.distinct().collect())) == [(3, "a.xlsx3", "s3"), (3, "b.xlsx3", "s3")]
    assert some.rdd.getNumPartitions() == 2  # other sheets are not planned


def test_filters_on_one_frame_do_not_meet(spark, tmp_path):
    rows = [(i, None if i % 5 == 0 else f"t{i % 4}", i / 4) for i in range(10000)]
    path = book(tmp_path, [("s", ["n", "t", "d"], rows)])
    df = spark.read.format("xlsx").schema("n long, t string, d double").load(path)
    for where in ("n = 7", "n > 9990", "t is null and n < 100", "t = 't2' and d > 100.5", "n >= 5 or t = 't1'", "true"):
        want = spark.createDataFrame(rows, "n long, t string, d double").where(where).collect()
        assert sorted(map(repr, df.where(where).collect())) == sorted(map(repr, want)), where


def test_columns_by_name_or_place(spark, tmp_path):
    path = book(tmp_path, [("s", ["a", "b", "c"], [(1, "x", 2.5), (2, None, 3.5)])])
    read = lambda ddl, **o: sorted(map(tuple, spark.read.format("xlsx").schema(ddl).options(**o).load(path).collect()))
    assert read("c double, a long") == [(2.5, 1), (3.5, 2)]
    assert read("p long, q string") == [(1, "x"), (2, None)]
    assert sorted(read("p string", header="false")) == [("1",), ("2",), ("a",)]


def test_sheet_names(spark, tmp_path):
    path = book(tmp_path, [('say "hi" & <go>', ["a"], [(1,)]), ("x" * 31, ["a"], [(2,)])])
    assert xlsx.sheet_names(path) == ['say "hi" & <go>', "x" * 31]
    df = spark.read.format("xlsx").schema("a long, sheet string").option("sheet", "*").load(path)
    assert sorted(map(tuple, df.collect())) == [(1, 'say "hi" & <go>'), (2, "x" * 31)]
    for bad in ("", "x" * 32, "a/b", "a[1]", "'q", "a\x0bb", "q:"):
        with pytest.raises(ValueError, match="cannot be the name of a sheet"):
            xlsx.write_workbook(str(tmp_path / "bad.xlsx"), bad, ["a"], [])
    with pytest.raises(ValueError, match="second sheet"):
        xlsx.write_workbook_sheets(str(tmp_path / "bad.xlsx"), [("a", ["a"], []), ("A", ["a"], [])])


def test_a_long_sheet_goes_on_in_numbered_ones(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(xlsx, "MAX_ROWS", 4)
    name = "y" * 31
    path = book(tmp_path, [(name, ["a"], [(i,) for i in range(8)])])
    assert xlsx.sheet_names(path) == [name, "y" * 29 + "_2", "y" * 29 + "_3"]
    df = spark.read.format("xlsx").schema("a long, sheet string").option("sheet", "*").load(path)
    assert sorted(r.a for r in df.collect()) == list(range(8))


def test_empty_sheets_and_empty_folders(spark, tmp_path):
    path = book(tmp_path, [("s", ["a"], [])])
    assert spark.read.format("xlsx").schema("a long").load(path).count() == 0
    with zipfile.ZipFile(tmp_path / "a.xlsx") as zf:
        assert "xl/worksheets/sheet1.xml" in zf.namelist()


def test_file_uris(spark, tmp_path):
    out = f"file://{tmp_path}/a%20b"
    for _ in range(2):
        spark.range(3).withColumnRenamed("id", "n").coalesce(1).write.format("xlsx").mode("overwrite").save(out)
        assert spark.read.format("xlsx").schema("n long").load(out).count() == 3
    assert [p.name for p in tmp_path.iterdir()] == ["a b"]
