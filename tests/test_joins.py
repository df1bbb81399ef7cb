import pytest
from pyspark.sql import functions as F

from cellwright.operators import joins
from cellwright.session import cut


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.fixture
def skewed(spark):
    units = spark.range(600).select(
        "id", F.when(F.col("id") % 3 == 0, 1).when(F.col("id") % 7 == 0, None).otherwise(F.col("id") % 50).cast("int").alias("k")
    )
    lookup = spark.createDataFrame([(k, f"v{k}") for k in range(0, 40)] + [(None, "none")], "k int, v string")
    return units.repartition(4), lookup


@pytest.mark.parametrize("how", ["left", "inner"])
@pytest.mark.parametrize("null_safe", [True, False])
def test_every_route_gives_the_same_rows(spark, skewed, how, null_safe):
    units, lookup = skewed
    wide = joins.lookup_join(units, lookup, ["k"], how, null_safe)
    counted = joins.lookup_join(units, lookup, ["k"], how, null_safe, measure=True)
    plain = joins.lookup_join(units, lookup, ["k"], how, null_safe, use_estimate=False)
    salted = joins.lookup_join(units, lookup, ["k"], how, null_safe, hot_rows=20, use_estimate=False)
    assert rows(wide) == rows(counted) == rows(plain) == rows(salted)
    assert "_salt" in salted._jdf.queryExecution().analyzed().toString()


def test_salted_route_keeps_multiplicity(spark, skewed):
    units, lookup = skewed
    doubled = lookup.unionByName(lookup)
    plain = joins.lookup_join(units, doubled, ["k"], "inner", use_estimate=False)
    salted = joins.lookup_join(units, doubled, ["k"], "inner", hot_rows=20, use_estimate=False)
    assert rows(plain) == rows(salted) and plain.count() == 2 * joins.lookup_join(units, lookup, ["k"], "inner").count()


def test_hot_keys_are_found(spark, skewed):
    units, _ = skewed
    assert [r["k"] for r in joins.hot_keys(units, ["k"], 100).collect()] == [1]
    assert joins.hot_keys(units, ["k"], 10_000) is None


def test_size_check(spark):
    small = spark.createDataFrame([(1, "a")], "k int, v string")
    assert joins.within_broadcast(small) and joins.planned_small(spark.range(10))
    assert not joins.planned_small(spark.range(10_000_000))
    assert not joins.within_broadcast(spark.range(11), rows=10)
    assert not joins.within_broadcast(small.withColumn("v", F.repeat(F.lit("x"), 1000)), size=500)


def test_null_safe_full_join(spark):
    a = spark.createDataFrame([(1, 5), (None, 7), (2, 1)], "k int, n int")
    b = spark.createDataFrame([(1, 50), (None, 70), (3, 30)], "k int, n int")
    got = rows(joins.null_safe_join(a, b, ["k"]))
    assert got == sorted([(1, 5, 50), (None, 7, 70), (2, 1, None), (3, None, 30)], key=repr)


def test_unit_filter_uses_sql_nulls(spark):
    df = spark.createDataFrame([("a", 1), (None, 2), ("b", 3)], "HIK string, x int")
    units = spark.createDataFrame([("a",), ("a",), (None,)], "HIK string")
    assert rows(joins.keep_units(df, units, "HIK")) == [("a", 1)]


def test_bridge_operators(spark):
    bridge = spark.createDataFrame([("a", "x", 1), ("b", "y", 2), ("c", "z", 3), (None, "w", 1)], "id0 string, id1 string, step int")
    d0 = spark.createDataFrame([("a", 4), ("b", 5)], "HISTID string, RACE int")
    d1 = spark.createDataFrame([("x", 4), ("z", 5)], "HISTID string, RACE int")
    hit = joins.either_side_listed(bridge, "id0", d0.select("HISTID"), "id1", d1.select("HISTID"))
    assert rows(hit.select("id0")) == [("a",), ("b",), ("c",)]
    linked = joins.link_periods(bridge, d0, d1, ("id0", "id1"), "HISTID")
    assert rows(linked) == [("a", "x", 1, 4, 4)]
    loose = joins.link_periods(bridge, d0, d1, ("id0", "id1"), "HISTID", both=False)
    assert loose.count() == 4
    cover = {r["side"]: (r["n_rows"], r["n_missing"], r["share_missing"]) for r in joins.id_coverage(bridge.select("id0"), d0.select("HISTID"), ("bridge", "census")).collect()}
    assert cover == {"bridge": (4, 2, 0.5), "census": (2, 0, 0.0)}


def test_fold_full_join(spark):
    a = spark.createDataFrame([("1", "p"), ("2", "q")], "DOJ string, a string")
    b = spark.createDataFrame([("2", 5), ("3", 6)], "DOJ string, b int")
    c = spark.createDataFrame([("3", 1.5), (None, 2.5)], "DOJ string, c double")
    got = rows(joins.fold_full_join([a, b, c], "DOJ"))
    step = a.join(b, "DOJ", "full").join(c, "DOJ", "full")
    assert got == rows(step)
    with pytest.raises(Exception, match="repeats"):
        joins.fold_full_join([a.unionByName(a), b], "DOJ").collect()


def test_dictionary_over_columns(spark):
    df = spark.createDataFrame([("0-1", "x", 1), (None, "0-1", 2)], "q string, p string, id int")
    dictionary = spark.createDataFrame([("0-1", 1001)], "code string, value int")
    assert rows(joins.recode_columns(df, ["q", "p"], dictionary)) == sorted([(1001, None, 1), (None, 1001, 2)], key=repr)


def test_small_lookups_are_broadcast_and_stay_null_safe(spark, skewed):
    units, lookup = skewed
    plan = joins.lookup_join(units, lookup, ["k"], measure=True)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "NestedLoop" not in plan and "CartesianProduct" not in plan


def test_shared_columns_need_suffixes(spark):
    a = spark.createDataFrame([(1, 5)], "k int, n int")
    b = spark.createDataFrame([(1, 6)], "k int, n int")
    with pytest.raises(ValueError):
        joins.lookup_join(a, b, ["k"])
    joined = joins.lookup_join(a, b, ["k"], suffixes=("_mlp", "_reg"))
    assert joined.columns == ["k", "n_mlp", "n_reg"] and tuple(joined.first()) == (1, 5, 6)


@pytest.mark.parametrize("how", ["full", "left", "right", "inner"])
def test_heavy_null_key_is_spread_and_unmatched_rows_come_once(spark, how):
    # NULL is heavy on the left and there on the right; 'only' is heavy on the left alone, 'r' on the right alone.
    left = spark.range(6000).selectExpr("CASE WHEN id < 3000 THEN NULL WHEN id < 4000 THEN 'only' ELSE string(id % 300) END AS k", "id AS v", "id AS n")
    right = spark.range(900).selectExpr("CASE WHEN id < 3 THEN NULL WHEN id < 500 THEN 'r' ELSE string(id) END AS k", "id AS w", "id AS n")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", 16)
    try:
        plain = joins.null_safe_join(left, right, ["k"], how, hot=None)
        salted = joins.null_safe_join(left, right, ["k"], how, hot_rows=200)
        assert salted.columns == plain.columns
        assert sorted(map(str, salted.collect())) == sorted(map(str, plain.collect()))

        def largest(df):
            return df.where("v < 3000 AND w IS NOT NULL").groupBy(joins.F.spark_partition_id()).count().agg({"count": "max"}).first()[0]

        assert largest(plain) == 9000 and largest(salted) < 9000 / 5
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
        spark.conf.set("spark.sql.shuffle.partitions", 4)


def test_a_chain_looks_for_heavy_keys_in_one_scan(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "base")
    spark.range(4000).selectExpr("id", "id % 7 a", "IF(id < 2500, 1, id) b", "nullif(id % 3, 0) c", "id % 500 d").write.parquet(path)
    base = spark.read.parquet(path)
    sides = {k: cut(spark.range(4000).selectExpr(f"IF(id = 0, NULL, id) {k}", f"id * 2 v_{k}"), "side") for k in "abcd"}
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    labels = []
    monkeypatch.setattr(joins, "cut", lambda df, label="stage", *a: labels.append(label) or cut(df, label, *a))
    try:
        plain = base
        for k, side in sides.items():
            plain = joins.lookup_join(plain, side, [k], hot=None)
        chained = joins.lookup_chain(base, [joins.Lookup(side, [k]) for k, side in sides.items()], hot_rows=400)
        assert labels == ["hot-keys"]
        text = chained._jdf.queryExecution().optimizedPlan().toString()
        assert text.count("id#") and sum("Relation [id#" in line and "a#" in line for line in text.split("\n")) == 1
        assert sorted(map(str, chained.collect())) == sorted(map(str, plain.collect()))
        later = joins.lookup_chain(base, [joins.Lookup(sides["a"], ["a"]), joins.Lookup(sides["b"], {"v_a": "b"}, "inner")], hot_rows=400)
        # The side of a holds NULL in place of 0, which leaves v_a NULL there, and NULL meets NULL.
        assert later.count() == 4000 and later.where("v_a IS NULL AND v_b = 0").count() == base.where("a = 0").count()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    found = joins.chain_hot_keys(base, [["a"], ["b"], ["c"], ["b", "d"], ["a"]], hot_rows=1200)
    assert found[0] is None and found[3] is None and found[4] is None
    assert [r["b"] for r in found[1].collect()] == [1] and {r["c"] for r in found[2].collect()} == {None, 1, 2}
