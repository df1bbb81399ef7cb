import pytest
from pyspark.sql import functions as F

from cellwright.functions.recode import equal_width_bin
from cellwright.functions.rules import birthplace_group
from cellwright.operators import cells, filters, order, tabulate
from cellwright.operators.moments import group_moments
from cellwright.operators.population import population_summary


@pytest.fixture
def people(spark):
    return spark.range(400).select(
        F.col("id"),
        F.when(F.col("id") % 11 == 0, None).otherwise(F.col("id") % 5).cast("int").alias("a"),
        (F.col("id") % 3).cast("int").alias("b"),
        (F.col("id") % 7 < 3).alias("t"),
        (F.col("id") % 13).cast("double").alias("x"),
    )


def test_counts_add_up(people):
    counted = cells.cell_counts(people, ["a", "b"])
    assert counted.agg(F.sum("n")).first()[0] == 400
    assert counted.where("a IS NULL").count() == 3


def test_propensity_matches_a_full_join(spark):
    treated = spark.createDataFrame([(1, 2), (None, 3), (9, 4)], "k int, n int")
    people = spark.createDataFrame([(1, 8), (None, 6), (2, 5), (3, 0)], "k int, n int")
    got = {r["k"]: (r["n_treated"], r["n_population"], r["prop"], r["no_population"]) for r in cells.cell_propensity(treated, people, ["k"]).collect()}
    assert got == {
        1: (2, 8, 0.25, False),
        None: (3, 6, 0.5, False),
        9: (4, 0, None, True),
        2: (0, 5, 0.0, False),
        3: (0, 0, None, True),
    }


def test_both_substitutions_apply(spark):
    table = spark.createDataFrame(
        [(6, 1900, 6, 3, 4), (6, 1901, 41, 1, 4), (6, 1910, 501, 1, 2), (None, 1900, 6, 1, 1)],
        "STATEFIP int, BIRTHYR int, BPL int, n_treated int, n_population int",
    )
    units = spark.createDataFrame([(1, 6, 1900, 53), (2, 6, 1910, 501), (3, 41, 1900, 6), (4, None, 1901, 4)], "id int, STATEFIP int, BIRTHYR int, BPL int")
    coarse = {"BIRTHYR": ("byr_grp", equal_width_bin(F.col("BIRTHYR"))), "BPL": ("bpl_grp", birthplace_group(F.col("BPL")))}
    got = cells.attach_propensity(units, table, ["STATEFIP", "BIRTHYR", "BPL"], coarse)
    rows = {r["id"]: (r["propensity"], r["exposed"]) for r in got.collect()}
    assert rows == {1: (0.5, False), 2: (0.5, False), 3: (None, None), 4: (1.0, True)}


def test_grouping_sets_equal_single_groups(people):
    table = cells.cell_propensity(cells.cell_counts(people.where("t"), ["a", "b"]), cells.cell_counts(people, ["a", "b"]), ["a", "b"])
    sets = {"by_a": ["a"], "by_b": ["b"], "by_ab": ["a", "b"]}
    together = cells.propensity_key_sets(table, sets)
    for name, keys in sets.items():
        one = {tuple(r[k] for k in keys): r["propensity"] for r in cells.propensity_by(table, keys).collect()}
        own = {tuple(r[k] for k in keys): r["propensity"] for r in together.where(F.col("key_set") == name).collect()}
        assert own == one
    attached = cells.attach_key_sets(people, table, sets)
    assert attached.count() == 400 and attached.where("by_ab IS NULL").count() == 0


def test_area_table_fills_absent_groups(spark):
    table = spark.createDataFrame([(1, 5, 3, 10), (1, 4, 0, 5), (2, 5, 1, 4)], "s int, RACE int, n_treated int, n_population int")
    group = F.when(F.col("RACE") == 5, "japn").when(F.col("RACE") == 4, "chin").otherwise("other")
    rows = {r["s"]: r for r in cells.area_demographics(table, ["s"], group, ["japn", "chin", "other"], share_of="japn").collect()}
    assert rows[2]["pop_chin"] == 0 and rows[2]["pop_tot"] == 4 and rows[2]["share_japn"] == 0.25
    assert rows[1]["pop_tot"] == 15 and rows[1]["share_tot"] == 0.2


def test_income_of_a_group_without_values(spark):
    df = spark.createDataFrame([(1940, 1, 100.0), (1940, 1, 999999.0), (1950, 1, 100.0), (1950, 2, 999998.0)], "YEAR int, g int, INCWAGE double")
    rows = {(r["YEAR"], r["g"]): (r["total_INCWAGE"], r["nwith_INCWAGE"], r["mean_INCWAGE"]) for r in cells.area_income(df, ["YEAR", "g"], ["INCWAGE"], "YEAR", 1940, 2.0).collect()}
    assert rows == {(1940, 1): (200.0, 1, 200.0), (1950, 1): (100.0, 1, 100.0), (1950, 2): (0.0, 0, None)}


def test_summary_pools_to_the_whole(people):
    table = cells.cell_propensity(cells.cell_counts(people.where("t"), ["a", "b"]), cells.cell_counts(people, ["a", "b"]), ["a", "b"])
    summary = population_summary(people, table, ["a", "b"], ["b"], {"odd": F.col("id") % 2 == 1}, ["x"], threshold=0.43)
    attached = cells.attach_propensity(people, table, ["a", "b"], threshold=0.43)
    direct = {(r["b"], r["exposed"]): r for r in group_moments(attached, ["b", "exposed"], ["x"]).collect()}
    for r in summary.collect():
        whole = direct[(r["b"], r["exposed"])]
        assert r["n"] == whole["n"]
        assert r["mean_x"] == pytest.approx(whole["mean_x"]) and r["var_x"] == pytest.approx(whole["var_x"])
    assert summary.agg(F.sum("n")).first()[0] == 400


def test_first_of_duplicates(spark):
    cards = spark.createDataFrame(
        [(3, "1", "A", "late"), (1, "1", "A", "early"), (2, "1", None, "x"), (5, "1", None, "y"), (4, "2", "A", "z")],
        "pos int, ind string, name string, note string",
    )
    got = {(r["ind"], r["name"]): (r["pos"], r["note"]) for r in filters.first_per_key(cards, ["ind", "name"], ["pos"]).collect()}
    assert got == {("1", "A"): (1, "early"), ("1", None): (2, "x"), ("2", "A"): (4, "z")}
    usable = filters.with_id_and_clean_name(
        spark.createDataFrame([("1", "DOE"), ("", "DOE"), (None, "DOE"), ("2", "D\\OE"), ("3", None)], "i string, n string"), "i", "n"
    )
    assert [r["i"] for r in usable.collect()] == ["1"]


def test_numbering_equals_a_window(spark):
    from pyspark.sql import Window as W

    df = spark.range(500).select("id", (F.col("id") * 37 % 11).alias("v")).repartition(4)
    order_by = [F.desc("v"), F.asc("id")]
    numbered = order.number_rows(df, order_by, "rank")
    expected = df.withColumn("rank", F.row_number().over(W.orderBy(*order_by)))
    assert sorted(map(tuple, numbered.select("id", "rank").collect())) == sorted(map(tuple, expected.select("id", "rank").collect()))


def test_running_sums_equal_a_window(spark):
    from pyspark.sql import Window as W

    df = spark.range(300).select("id", (F.col("id") % 3).alias("g"), F.col("id").cast("double").alias("v")).repartition(4)
    run = order.running_sums(df, ["id"], ["v"], ["g"])
    expected = df.withColumn("run_v", F.sum("v").over(W.partitionBy("g").orderBy("id")))
    assert sorted(map(tuple, run.select("id", "run_v").collect())) == sorted(map(tuple, expected.select("id", "run_v").collect()))


def test_crosstab_finds_its_levels(spark):
    rows = spark.createDataFrame([("a", "x"), ("a", "y"), ("b", "z"), ("b", None)], "k string, level string")
    got = {r["k"]: r.asDict() for r in tabulate.crosstab(rows, ["k"], "level", with_total=True).collect()}
    assert got["a"] == {"k": "a", "x": 1, "y": 1, "z": 0, "total": 2} and got["b"] == {"k": "b", "x": 0, "y": 0, "z": 1, "total": 2}


def test_first_of_duplicates_sorts_a_digest_and_not_the_text(spark):
    rows = spark.createDataFrame([("t", None, 2), ("t", None, 1), (None, "t", 3), ("t", "null", 4)], "a string, b string, o int")
    first = filters.first_per_key(rows, ["a", "b"], ["o"])
    assert {tuple(r) for r in first.collect()} == {("t", None, 1), (None, "t", 3), ("t", "null", 4)}
    exchanges = [line for line in first._jdf.queryExecution().executedPlan().toString().splitlines() if "Exchange hashpartitioning" in line]
    assert exchanges and not any(f"({key}#" in line for line in exchanges for key in ("a", "b"))


def test_lattice_sums_each_set_from_its_smallest_finer_set(spark):
    from itertools import combinations

    from cellwright.operators.cells import key_set_parents, propensity_key_sets, propensity_lattice

    cells = spark.range(400).selectExpr("id % 3 a", "nullif(id % 5, 0) b", "id % 7 c", "id % 40 d", "id % 4 n_treated", "id % 4 + 1 n_population")
    sets = {"+".join(k) or "all": list(k) for n in range(5) for k in combinations("abcd", n)}
    found = {tuple(r) for r in propensity_lattice(cells, sets).collect()}
    assert found == {tuple(r) for r in propensity_key_sets(cells, sets).collect()}
    few = {name: sets[name] for name in ("a", "a+b", "b+c+d")}
    assert {tuple(r) for r in propensity_lattice(cells, few).collect()} == {tuple(r) for r in propensity_key_sets(cells, few).collect()}
    parents = key_set_parents({frozenset("a"): 3, frozenset("ab"): 15, frozenset("ad"): 120}, frozenset("abd"))
    assert parents[frozenset("a")] == frozenset("ab") and parents[frozenset("ab")] == frozenset("abd")
