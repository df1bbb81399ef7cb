"""Cases that earlier versions got wrong."""

import pytest

from cellwright.operators.design import Interact, expand_term
from cellwright.operators.filters import first_per_key
from cellwright.operators.joins import label_codes
from cellwright.plans.panel import PROPENSITIES
from cellwright.rules.census import AGE_COHORTS


def test_named_propensities_differ():
    sets = [frozenset(keys) for keys in PROPENSITIES.values()]
    assert len(set(sets)) == len(sets) == 4
    assert "RACE" not in PROPENSITIES["county_intprop"] and "SEX" not in PROPENSITIES["intprob_AB"]


def test_interaction_with_missing_factor_is_missing(spark):
    df = spark.createDataFrame([("a", 1.0), ("b", 2.0), (None, 3.0), ("a", None)], "f string, x double")
    [(_, column)] = expand_term(df, Interact("f", "x", ["a"]))
    assert [r[0] for r in df.select(column).collect()] == [1.0, 0.0, None, None]


def test_first_per_key_with_missing_order(spark):
    df = spark.createDataFrame([("a", None, "x"), ("b", None, "y"), ("b", 2, "z")], "k string, o int, v string")
    got = {(r["k"], r["o"], r["v"]) for r in first_per_key(df, ["k"], ["o"]).collect()}
    assert got == {("a", None, "x"), ("b", 2, "z")}


def test_age_bands_do_not_overlap():
    labels = [label for _, _, label in AGE_COHORTS]
    assert len(set(labels)) == len(labels)
    lows = [int(label.split("-")[0].rstrip("+")) for label in labels]
    highs = [int(label.split("-")[1]) for label in labels if "-" in label]
    assert lows[1:] == [h + 1 for h in highs]


def test_labels_with_a_code_that_is_no_number(spark):
    df = spark.createDataFrame([(1,), (2,)], "race int")
    labels = spark.createDataFrame([("race", "1", "one"), ("race", "x", "none")], "variable string, code string, label string")
    got = {r["race"]: r["race_label"] for r in label_codes(df, labels, ["race"]).collect()}
    assert got == {1: "one", 2: None}


def test_scratch_needs_a_shared_folder_off_the_driver():
    from cellwright import session

    class Fake:
        class conf:
            get = staticmethod(lambda *_: None)

        class sparkContext:
            master = "local-cluster[2,1,1024]"

    with pytest.raises(ValueError):
        session.scratch_root(Fake)


def test_every_level_of_a_crosstab_counts(spark):
    from cellwright.catalog.tabulations import QUERIES, SEGMENTS

    found = QUERIES["crosstab_total_topk"](spark, "/root/testdata/sf0.001").collect()
    assert found and all(sum(r[s] for s in SEGMENTS) == r["total"] for r in found)


def test_salt_spreads_a_key_that_came_in_one_partition(spark):
    from cellwright.operators import joins

    units = spark.range(4000).selectExpr("id", "1 AS k").repartition(8, "k")
    lookup = spark.createDataFrame([(1, "v")], "k int, v string")
    joined = joins.lookup_join(units, lookup, ["k"], hot_rows=20, use_estimate=False)
    assert joined.count() == 4000 and joined.where("v = 'v'").count() == 4000
    plan = joined._jdf.queryExecution().analyzed().toString()
    assert "xxhash64" in plan and joined.columns == ["id", "k", "v"]


def test_exploded_lookup_is_not_taken_for_small(spark):
    from cellwright.operators import joins

    grown = spark.createDataFrame([(1,)], "k int").selectExpr("explode(sequence(1, 50000)) AS k", "'x' AS v").where("k > 5")
    assert not joins.planned_small(grown)
    units = spark.range(100).selectExpr("id", "CAST(id AS INT) AS k")
    joined = joins.lookup_join(units, grown, ["k"], hot=None)
    assert joined.where("v = 'x'").count() == 94
    assert "BroadcastHashJoin" not in joined._jdf.queryExecution().executedPlan().toString()


def test_load_deletes_nothing_without_replace(spark, tmp_path):
    from cellwright.sources import tables

    path = tmp_path / "t"
    tables.load_table(spark.range(5), str(path))
    (path / "_SUCCESS").unlink()
    with pytest.raises(FileExistsError):
        tables.load_table(spark.range(3), str(path))
    assert spark.read.parquet(str(path)).count() == 5
    assert tables.load_table(spark.range(3), str(path), replace=True)[1] == 3


def test_fit_without_a_complete_row(spark):
    from cellwright.operators.estimate import ols

    df = spark.createDataFrame([(1.0, None), (None, 2.0)], "y double, x double")
    with pytest.raises(ValueError, match="complete"):
        ols(df, "y", ["x"])


def test_lines_of_two_files_keep_the_order_of_the_files(spark, tmp_path):
    from cellwright.plans.register import read_card_lines

    (tmp_path / "a.txt").write_text("a1\na2\n")
    (tmp_path / "b.txt").write_text("".join(f"b{i:04}\n" for i in range(5000)))
    lines = [r["value"] for r in read_card_lines(spark, str(tmp_path)).orderBy("card_order").collect()]
    assert lines == ["a1", "a2", *[f"b{i:04}" for i in range(5000)]]


def test_first_per_key_tells_keys_apart_as_grouping_does(spark):
    rows = spark.sql("""
        SELECT * FROM VALUES
          (1, timestamp'2020-01-01 00:00:00.123456', 0.0D, X'00', array(1.5D, -0.0D), named_struct('a', 'x', 'b', 'y:')),
          (2, timestamp'2020-01-01 00:00:00.123999', -0.0D, X'00', array(1.5D, 0.0D), named_struct('a', 'x', 'b', 'y:')),
          (3, timestamp'2020-01-01 00:00:00.123456', double('NaN'), X'0001', array(1.5D), named_struct('a', 'xy', 'b', ':')),
          (4, NULL, double('NaN'), NULL, NULL, named_struct('a', NULL, 'b', 'y:')),
          (5, timestamp'2020-01-01 00:00:00.123456', NULL, X'', array(), NULL),
          (6, NULL, 0.1D, NULL, array(NULL), NULL)
        AS t(o, at, x, b, l, s)""")
    assert rows.count() == 6
    for keys in (["at"], ["x"], ["b"], ["l"], ["s"], ["at", "x"], ["b", "l"]):
        wanted = {r["o"] for r in rows.groupBy(*keys).agg({"o": "min"}).withColumnRenamed("min(o)", "o").collect()}
        assert {r["o"] for r in first_per_key(rows, keys, ["o"]).collect()} == wanted, keys
    words = spark.createDataFrame([(1, "a", "bc"), (2, "ab", "c"), (3, "1:a", None), (4, "-", None), (5, None, "-")], "o int, k string, v string")
    assert first_per_key(words, ["k", "v"], ["o"]).count() == 5
    with pytest.raises(TypeError):
        first_per_key(spark.sql("SELECT 1 AS o, map(1, 2) AS m"), ["m"], ["o"])


def test_movers_by_pairs_found(spark):
    from pyspark.sql import functions as F

    from cellwright.operators.reshape import movers_table

    df = spark.createDataFrame([("g", "a b", "c"), ("g", "a b", "c"), ("g", None, "c"), (None, "c", None)], "k string, x string, y string")
    found = {r["k"]: r.asDict() for r in movers_table(df, ["k"], F.col("x"), F.col("y")).collect()}
    assert found["g"] == {"k": "g", "NA_c": 1, "a_b_c": 2, "c_NA": 0} and found[None]["c_NA"] == 1
    with pytest.raises(ValueError):
        movers_table(df, ["k"], F.col("x"), F.col("y"), most_pairs=2)
    alike = spark.createDataFrame([("g", "a b", "c"), ("g", "a_b", "c")], "k string, x string, y string")
    with pytest.raises(ValueError):
        movers_table(alike, ["k"], F.col("x"), F.col("y"))


def test_area_table_with_a_missing_area(spark):
    from cellwright.plans.areas import area_table, region_table

    cells = spark.createDataFrame(
        [(6, 10, 5, 2, 10), (6, 10, 1, 0, 30), (6, None, 5, 1, 1), (49, 30, 4, 0, 7), (4, 10, 5, 1, 2), (None, None, 1, 0, 3)],
        "STATEFIP int, COUNTYICP int, RACE int, n_treated long, n_population long",
    )
    areas = {(r["STATEFIP"], r["COUNTYICP"]): r for r in area_table(cells).collect()}
    alameda = areas[(6, 10)]
    assert (alameda["pop_japn"], alameda["pop_other"], alameda["pop_tot"], alameda["treated"], alameda["share_japn"]) == (10, 30, 40, 2, 0.2)
    assert alameda["region"] == "Alameda, CA" and alameda["zone"] == 1 and areas[(49, 30)]["region"] == "49" and areas[(49, 30)]["zone"] == 0
    assert areas[(49, 30)]["share_japn"] is None and areas[(None, None)]["region"] is None
    regions = {r["region"]: r for r in region_table(area_table(cells)).collect()}
    assert regions["Northern AZ"]["pop_tot"] == 2 and regions["49"]["zone"] == 0.0
