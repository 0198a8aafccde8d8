import datetime

import pytest
from pyspark.sql import functions as F

from tallyframe.sources import (
    dictionary_layout, land, land_extract, landed_or, literal_table, malformed_fields, read_csv, read_dictionary,
    read_hierarchical, read_rectangular, read_table, text_labels, value_labels, write_csv,
)
from tests.conftest import rows

CODEBOOK = """<?xml version="1.0"?>
<codeBook><dataDscr>
<var ID="RECTYPE" name="RECTYPE" dcml="0" rectype="H P"><location StartPos="1" EndPos="1" width="1"/>
  <labl>Record type</labl><varFormat type="character"/></var>
<var ID="YEAR" name="YEAR" dcml="0" rectype="H P"><location StartPos="2" EndPos="5" width="4"/>
  <labl>Census year</labl><varFormat type="numeric"/></var>
<var ID="SERIAL" name="SERIAL" dcml="0" rectype="H P"><location StartPos="6" EndPos="15" width="10"/>
  <labl>Household</labl><varFormat type="numeric"/></var>
<var ID="GQ" name="GQ" dcml="0" rectype="H"><location StartPos="16" EndPos="16" width="1"/>
  <labl>Quarters</labl><catgry><catValu>0</catValu><labl>Vacant</labl></catgry>
  <catgry><catValu>1</catValu><labl>Household</labl></catgry><varFormat type="numeric"/></var>
<var ID="HHWT" name="HHWT" dcml="2" rectype="H"><location StartPos="17" EndPos="22" width="6"/>
  <labl>Weight</labl><varFormat type="numeric"/></var>
<var ID="AGE" name="AGE" dcml="0" rectype="P"><location StartPos="16" EndPos="18" width="3"/>
  <labl>Age</labl><varFormat type="numeric"/></var>
</dataDscr></codeBook>
"""
RECORDS = ["H200000000000011001250", "P20000000000001 34", "P20000000000001  7",
           "H200100000000020000300", "H200100000000031000475", "P20010000000003   "]


@pytest.fixture
def extract(tmp_path):
    (tmp_path / "book.xml").write_text(CODEBOOK)
    (tmp_path / "data.dat").write_text("\n".join(RECORDS) + "\n")
    return str(tmp_path / "book.xml"), str(tmp_path / "data.dat")


def test_dictionary_and_labels(spark, extract):
    d = read_dictionary(spark, extract[0])
    assert [f.name for f in dictionary_layout(d)] == ["RECTYPE", "YEAR", "SERIAL", "GQ", "HHWT", "AGE"]
    assert rows(value_labels(d, "GQ")) == [(0, "Vacant"), (1, "Household")]
    assert rows(value_labels(d, "AGE")) == []


def test_hierarchical_records(spark, extract):
    layout = dictionary_layout(read_dictionary(spark, extract[0]))
    h, p = read_hierarchical(spark, extract[1], layout)
    assert h.columns == ["RECTYPE", "YEAR", "SERIAL", "GQ", "HHWT"]
    assert rows(h) == [("H", 2000, 1, 1, 12.5), ("H", 2001, 2, 0, 3.0), ("H", 2001, 3, 1, 4.75)]
    assert rows(p) == [("P", 2000, 1, 7), ("P", 2000, 1, 34), ("P", 2001, 3, None)]


def test_rectangular_records(spark, extract):
    layout = [f for f in dictionary_layout(read_dictionary(spark, extract[0])) if f.name in ("YEAR", "SERIAL")]
    assert read_rectangular(spark, extract[1], layout).count() == 6


def test_landed_copy_is_used_when_there(spark, extract, tmp_path):
    layout = dictionary_layout(read_dictionary(spark, extract[0]))
    path, built = str(tmp_path / "land"), []

    def build():
        built.append(1)
        return read_hierarchical(spark, extract[1], layout)[0]

    first = rows(landed_or(spark, path, build).select("SERIAL", "YEAR"))
    assert rows(landed_or(spark, path, build).select("SERIAL", "YEAR")) == first and built == [1]


def test_interrupted_landing_is_written_again(spark, extract, tmp_path):
    layout = dictionary_layout(read_dictionary(spark, extract[0]))
    path = tmp_path / "half"
    land(read_hierarchical(spark, extract[1], layout)[0].limit(1), str(path))
    (path / "_SUCCESS").unlink()
    assert landed_or(spark, str(path), lambda: read_hierarchical(spark, extract[1], layout)[0]).count() == 3


def test_odd_fields_and_categories(spark, tmp_path):
    book = CODEBOOK.replace("<catValu>0</catValu>", "<catValu>1A</catValu>")
    (tmp_path / "book.xml").write_text(book)
    (tmp_path / "data.dat").write_text("\n".join([*RECORDS, "P2001000000000x 1x", "P20010000000004 9x"]) + "\n")
    d = read_dictionary(spark, str(tmp_path / "book.xml"))
    assert rows(value_labels(d, "GQ")) == [(1, "Household")]
    assert rows(text_labels(d, "GQ")) == [("1", "Household"), ("1A", "Vacant")]
    layout = dictionary_layout(d)
    persons = read_hierarchical(spark, str(tmp_path / "data.dat"), layout)[1]
    assert rows(persons.filter("YEAR = 2001").select("SERIAL", "AGE")) == [(3, None), (4, None), (None, None)]
    lines = spark.read.text(str(tmp_path / "data.dat")).filter("value like 'P%'")
    own = [f for f in layout if not f.rectypes or "P" in f.rectypes]
    assert {r.field: r.n for r in malformed_fields(lines, own).collect()} == {"YEAR": 0, "SERIAL": 1, "AGE": 2}


def test_extract_is_parsed_once(spark, extract, tmp_path):
    layout = dictionary_layout(read_dictionary(spark, extract[0]))
    h, p = land_extract(spark, extract[1], layout, str(tmp_path / "once"))
    assert h.columns == ["RECTYPE", "YEAR", "SERIAL", "GQ", "HHWT"] and p.columns == ["RECTYPE", "YEAR", "SERIAL", "AGE"]
    plan = p.filter("YEAR = 2001")._jdf.queryExecution().executedPlan().toString()
    assert "RECTYPE" in plan.split("PartitionFilters: ")[1].split("]")[0] and "text" not in plan


def test_extract_is_landed_whole(spark, extract, tmp_path):
    layout = dictionary_layout(read_dictionary(spark, extract[0]))
    folder = str(tmp_path / "extract")
    for _ in range(2):
        h, p = land_extract(spark, extract[1], layout, folder)
        assert rows(h.select("YEAR", "SERIAL", "HHWT")) == [(2000, 1, 12.5), (2001, 2, 3.0), (2001, 3, 4.75)]
        assert rows(p.select("SERIAL", "AGE")) == [(1, 7), (1, 34), (3, None)]


def test_landed_years_are_pruned(spark, tmp_path):
    path = str(tmp_path / "t")
    land(spark.range(100).select((F.col("id") % 4 + 2000).cast("int").alias("YEAR"), "id"), path)
    plan = spark.read.parquet(path).filter("YEAR = 2001")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(YEAR" in plan
    assert spark.read.parquet(path).count() == 100


def test_csv_round_trip_with_missing(spark, tmp_path):
    t = literal_table(spark, [(datetime.date(2020, 1, 1), 1.5, None), (datetime.date(2020, 2, 1), None, "x")],
                      "d date, v double, s string")
    path = str(tmp_path / "out")
    write_csv(t, path)
    assert rows(read_csv(spark, path)) == rows(t)
    assert rows(read_csv(spark, path, "d date, v double, s string")) == rows(t)
    text = "".join(p.read_text() for p in (tmp_path / "out").glob("part-*"))
    assert "d,v,s" in text and "NA" in text


def test_catalog_table(spark):
    spark.range(5).createOrReplaceTempView("five")
    assert read_table(spark, "five").filter("id > 2").count() == 2
