import gzip

import pytest
from pyspark.sql import functions as F

from cellwright.sources import delimited, fixed_width, tables
from cellwright.sources.fixed_width import Field


def test_fixed_width_offsets(spark, tmp_path):
    path = tmp_path / "cards.txt"
    path.write_text("AB 012  7\n   x1&  -\nCD\n")
    layout = [Field("name", 1, 3), Field("n", 4, 6, 1, "double"), Field("code", 8, 9), Field("k", 4, 6, 0, "int")]
    rows = [tuple(r) for r in fixed_width.read_fixed_width(spark, str(path), layout).collect()]
    assert rows == [("AB", 1.2, "7", 12), (None, None, "-", None), ("CD", None, None, None)]
    only = fixed_width.read_fixed_width(spark, str(path), layout, ["k", "name"])
    assert only.columns == ["k", "name"]
    with pytest.raises(ValueError):
        fixed_width.read_fixed_width(spark, str(path), layout, ["absent"])


def test_gzip_is_spread(spark, tmp_path):
    path = tmp_path / "data.txt.gz"
    with gzip.open(path, "wt") as out:
        out.writelines(f"{i:05d}\n" for i in range(1000))
    rows = fixed_width.read_fixed_width(spark, str(path), [Field("i", 1, 5, 0, "int")], partitions=4)
    assert rows.rdd.getNumPartitions() == 4
    assert rows.agg(F.sum("i")).first()[0] == sum(range(1000))


def test_layout_from_metadata(spark, tmp_path):
    path = tmp_path / "layout.xml"
    path.write_text(
        '<codeBook><dataDscr>'
        '<var ID="YEAR" name="YEAR" dcml="0"><location StartPos="1" EndPos="4" width="4"/><varFormat type="numeric"/></var>'
        '<var ID="WT" name="WT" dcml="2"><location StartPos="5" EndPos="9" width="5"/><varFormat type="numeric"/></var>'
        '<var ID="ID" name="ID" dcml="0"><location StartPos="10" EndPos="12" width="3"/><varFormat type="character"/></var>'
        "</dataDscr></codeBook>"
    )
    layout = fixed_width.layout_fields(fixed_width.read_ddi_layout(spark, str(path)))
    assert layout == [Field("YEAR", 1, 4, 0, "int"), Field("WT", 5, 9, 2, "double"), Field("ID", 10, 12, 0, "string")]
    data = tmp_path / "data.txt"
    data.write_text("19400012300A\n")
    assert tuple(fixed_width.read_fixed_width(spark, str(data), layout).first()) == (1940, 1.23, "00A")
    assert [r["value"] for r in fixed_width.peek_lines(spark, str(data)).collect()] == ["19400012300A"]


def test_separated_text_keeps_commas(spark, tmp_path):
    path = tmp_path / "m.txt"
    path.write_text("~DOJ~^~NAME~^~CITY~\n~1~^~Doe, J~^~~\n~2~^~Roe~^~X~\n")
    rows = {r["DOJ"]: (r["NAME"], r["CITY"]) for r in delimited.read_separated(spark, str(path)).collect()}
    assert rows == {"1": ("Doe, J", None), "2": ("Roe", "X")}


def test_csv_markers_and_padding(spark, tmp_path):
    path = tmp_path / "a.csv"
    path.write_text("k,v\n1,NA\n2,x\n")
    assert [tuple(r) for r in delimited.read_csv_table(spark, str(path), "k int, v string").collect()] == [(1, None), (2, "x")]
    padded = tmp_path / "p.csv"
    padded.write_text("state,      county,   Total, Male\nArizona,    Maricopa,    58,    34\nOregon,  Hood River,  ,  \n")
    rows = [tuple(r) for r in delimited.read_padded_csv(spark, str(padded), "state string, county string, Total int, Male int").collect()]
    assert rows == [("Arizona", "Maricopa", 58, 34), ("Oregon", "Hood River", None, None)]


def test_guarded_load(spark, tmp_path):
    path = str(tmp_path / "t")
    first = spark.range(10).withColumn("g", F.col("id") % 3)
    stored, written = tables.load_table(first, path, keep=[("g", [0, 1])])
    assert written == 7 and stored.count() == 7
    again, skipped = tables.load_table(spark.range(99), path)
    assert skipped is None and again.count() == 7
    replaced, written = tables.load_table(first, path, replace=True)
    assert written == 10 and replaced.count() == 10


def test_failed_load_leaves_no_table(spark, tmp_path):
    path = str(tmp_path / "broken")
    bad = spark.range(10).withColumn("x", F.when(F.col("id") == 5, F.raise_error(F.lit("stop")).cast("int")).otherwise(1))
    with pytest.raises(Exception):
        tables.load_table(bad, path)
    assert not tables.path_exists(spark, path)
    _, written = tables.load_table(spark.range(3), path)
    assert written == 3


def test_random_table_is_seeded(spark):
    a = tables.random_table(spark, 50, seed=3).collect()
    assert a == tables.random_table(spark, 50, seed=3).collect()
    assert {r["g"] for r in a} <= {1, 2, 3}


def test_views_and_labelled_csv(spark, tmp_path):
    df = spark.createDataFrame([(1, 5), (2, None), (3, 7)], "id int, RACE int")
    labels = spark.createDataFrame([("RACE", 5, "Japanese")], "variable string, code int, label string")
    path = str(tmp_path / "out")
    tables.write_labelled_csv(df, path, labels, ["RACE"])
    back = delimited.read_csv_table(spark, path, "id int, RACE string")
    assert sorted(tuple(r) for r in back.collect()) == [(1, "Japanese"), (2, None), (3, None)]
    assert tables.read_table(spark, "v1" if tables.as_view(df, "v1") is not None else "").count() == 3


def test_area_attributes(spark):
    rows = [("Alaska Territory", "First", "025", "0015", 2.5), ("Oregon", "Hood River", "410", "0270", 41027.0)]
    table = spark.createDataFrame(rows, "STATENAM string, NHGISNAM string, NHGISST string, NHGISCTY string, ICPSRFIP double")
    got = [(r["STATENAM"], r["STATEFIP"], r["COUNTYICP"]) for r in delimited.area_attributes(table).collect()]
    assert got == [("Alaska", 2, 15), ("Oregon", 41, 270)]
