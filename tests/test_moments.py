import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cellwright.functions.tails import f_upper, normal_two_sided, t_two_sided
from cellwright.operators import reshape
from cellwright.operators.moments import group_moments, pooled_moments, running_moments
from cellwright.operators.tabulate import balance_table, density_on_grid, histogram, shares

# Worked example: (chunk, group, mean, variance, n), and the pooled result after each part with n > 1.
PARTS = [
    (1, 1, -0.2075, 0.294091666666667, 4), (1, 2, 0.0725, 1.69989166666667, 4), (1, 3, -0.96, 3.645, 2),
    (2, 1, -0.03, 1.1452, 3), (2, 2, 0.534, 1.77428, 5), (2, 3, -0.595, 1.46205, 2),
    (3, 1, -1.44, None, 1), (3, 2, -0.246666666666667, 1.42698666666667, 6), (3, 3, 0.543333333333333, 0.0532333333333333, 3),
    (4, 1, -0.106, 3.36908, 5), (4, 2, 0.325, 0.29645, 2), (4, 3, 0.42, 1.1701, 3),
    (5, 1, -0.895, 2.33556666666667, 4), (5, 2, -0.0666666666666667, 2.18543333333333, 3), (5, 3, 0.0733333333333333, 0.202533333333333, 3),
    (6, 1, -0.123333333333333, 0.520946666666667, 6), (6, 2, -0.52, 1.445, 2), (6, 3, 0.07, 0.2178, 2),
    (7, 1, 0.44, 0.8263, 3), (7, 2, 0.646666666666667, 1.35403333333333, 3), (7, 3, 0.00749999999999999, 0.855825, 4),
    (8, 1, 0.052, 0.42517, 5), (8, 2, -0.53, None, 1), (8, 3, 0.19, 0.615266666666667, 4),
    (9, 1, -0.43, None, 1), (9, 2, 0.643333333333333, 1.58503333333333, 3), (9, 3, -0.24, 0.77168, 6),
    (10, 1, 0.0766666666666667, 0.181233333333333, 3), (10, 2, 0.166666666666667, 2.43363333333333, 3), (10, 3, -0.5025, 0.783358333333333, 4),
]
RUNNING = [
    (4, -0.2075, 0.294091666666667), (8, -0.0675, 0.876964285714286), (10, -0.246, 1.22869333333333),
    (13, -0.196153846153846, 1.12135897435897), (18, 0.00666666666666667, 1.32227058823529), (20, -0.0535, 1.29432921052632),
    (26, -0.0980769230769231, 1.27597615384615), (29, -0.0317241379310345, 1.18258620689655), (34, -0.0426470588235294, 1.41249278074866),
    (36, -0.0222222222222222, 1.34754349206349), (39, 0.0117948717948718, 1.31699406207827), (43, -0.0725581395348837, 1.42941949058693),
    (46, -0.0721739130434783, 1.43125739130435), (49, -0.063265306122449, 1.35148494897959), (55, -0.0698181818181818, 1.24991292929293),
    (57, -0.0856140350877193, 1.23806077694236), (59, -0.0803389830508475, 1.19993091759205), (62, -0.0551612903225807, 1.18068112109995),
    (65, -0.0227692307692308, 1.18967346153846), (69, -0.0210144927536232, 1.15750042625746), (74, -0.0160810810810811, 1.10185703443169),
    (78, -0.00551282051282052, 1.0706822011322), (81, 0.0185185185185185, 1.08536027777778), (87, 0.000689655172413781, 1.05884370489174),
    (90, 0.00322222222222221, 1.02741309612984), (93, 0.00849462365591397, 1.04765857877513), (97, -0.0125773195876289, 1.03891724656357),
]


@pytest.fixture
def parts(spark):
    return spark.createDataFrame(PARTS, "chunk int, g int, xbar double, var double, n int").repartition(4)


def test_worked_example(parts):
    end = pooled_moments(parts, [], "n", "xbar", "var", drop_singletons=True).first()
    assert end["n"] == 97 and end["mean"] == pytest.approx(-0.0125773195876289) and end["var"] == pytest.approx(1.03891724656357)
    kept = pooled_moments(parts, [], "n", "xbar", "var").first()
    assert kept["n"] == 100


def test_worked_example_step_by_step(parts):
    steps = running_moments(parts, ["chunk", "g"], "n", "xbar", "var", drop_singletons=True).orderBy("chunk", "g").collect()
    assert len(steps) == len(RUNNING)
    for row, (n, mean, var) in zip(steps, RUNNING):
        assert (row["n"], row["mean"], row["var"]) == (n, pytest.approx(mean, abs=1e-12), pytest.approx(var, abs=1e-12))


@settings(max_examples=5, deadline=None)
@given(st.integers(min_value=1, max_value=10_000))
def test_any_split_pools_to_the_whole(spark, seed):
    draw = random.Random(seed)
    rows = [(draw.randrange(3), draw.randrange(7), 1e6 + draw.gauss(0, 3)) for _ in range(60)]
    df = spark.createDataFrame(rows, "g int, part int, x double")
    parts = df.groupBy("g", "part").agg(F.count("x").alias("n"), F.avg("x").alias("m"), F.var_samp("x").alias("v"))
    pooled = {r["g"]: r for r in pooled_moments(parts, ["g"], "n", "m", "v", center=1e6).collect()}
    for r in group_moments(df, ["g"], ["x"]).collect():
        assert pooled[r["g"]]["n"] == r["n"] and pooled[r["g"]]["mean"] == pytest.approx(r["mean_x"])
        if r["n"] > 1:
            assert pooled[r["g"]]["var"] == pytest.approx(r["var_x"], rel=1e-6)


def test_wide_and_long_are_inverse(spark):
    df = spark.createDataFrame([(1, 1940, 5.0, "x"), (1, 1950, 6.0, None), (2, 1940, None, "y")], "id int, YEAR int, v double, s string")
    wide = reshape.to_wide(df, ["id"], "YEAR", [1940, 1950], ["v", "s"])
    assert wide.columns == ["id", "v_1940", "v_1950", "s_1940", "s_1950"]
    assert reshape.period_values(wide, [1940, 1950]) == ["v", "s"]
    back = reshape.to_long(wide, ["id"], ["v", "s"], [1940, 1950]).where("v IS NOT NULL OR s IS NOT NULL")
    assert sorted(map(tuple, back.collect()), key=repr) == sorted(map(tuple, df.collect()), key=repr)


def test_repeated_units_raise(spark):
    df = spark.createDataFrame([(1, 1940, 5.0), (1, 1940, 6.0)], "id int, YEAR int, v double")
    with pytest.raises(Exception, match="two rows"):
        reshape.to_wide(df, ["id"], "YEAR", [1940, 1950], ["v"]).collect()
    summed = reshape.to_wide(df, ["id"], "YEAR", [1940, 1950], ["v"], reduce="sum", absent_zero=True).first()
    assert tuple(summed) == (1, 11.0, 0.0)


def test_movers_and_stock(spark):
    df = spark.createDataFrame([("J", 6, 36), ("J", 6, 53), ("C", 36, 6), ("C", 36, 36)], "race string, s0 int, s1 int")
    from cellwright.functions.rules import west_coast

    table = reshape.movers_table(df, ["race"], west_coast(F.col("s0")), west_coast(F.col("s1")), ["West Coast", "Other"])
    got = {r["race"]: r.asDict() for r in table.collect()}
    assert got["J"]["West_Coast_West_Coast"] == 1 and got["J"]["West_Coast_Other"] == 1 and got["C"]["Other_West_Coast"] == 1
    stock = spark.createDataFrame([(1, 1940), (1, 1950), (1, 1950), (2, 1950), (None, 1940)], "s int, y int")
    rows = {r["s"]: tuple(r)[1:] for r in reshape.stock_ratio(stock, ["s"], "y", 1940, 1950).collect()}
    assert rows == {1: (1, 2, 2.0), 2: (None, 1, None), None: (1, None, None)}


def test_shares_and_bins(spark):
    df = spark.createDataFrame([("a", 0.0), ("a", 0.1), ("b", 0.25), (None, None)], "k string, x double")
    assert {r["k"]: r["share"] for r in shares(df, ["k"]).collect()} == {"a": 0.5, "b": 0.25, None: 0.25}
    assert sorted((r["bin"], r["n"]) for r in histogram(df, "x", 0.1).collect()) == [(0, 1), (1, 1), (2, 1)]
    grid = density_on_grid(df, "x", -2.0, 2.0, 401, 0.2, 0.05)
    assert grid.agg(F.sum("density") * 0.01).first()[0] == pytest.approx(1.0, abs=1e-3)


def test_balance(spark):
    df = spark.createDataFrame([("A", 1.0), ("A", 3.0), ("B", 2.0), ("B", 6.0), ("C", 99.0), ("B", None)], "g string, x double")
    r = balance_table(df, "g", ("A", "B"), ["x"]).first()
    assert (r["n0"], r["n1"], r["mean0"], r["mean1"], r["difference"]) == (2, 2, 2.0, 4.0, 2.0)
    assert r["std_error"] == pytest.approx((2 / 2 + 8 / 2) ** 0.5)


def test_tails():
    assert t_two_sided(2.0, 10) == pytest.approx(0.07338803, abs=1e-7)
    assert t_two_sided(0.0, 5) == pytest.approx(1.0)
    assert f_upper(4.0, 2, 20) == pytest.approx((1 + 2 * 4 / 20) ** -10, rel=1e-10)
    assert f_upper(147.534201619195, 1, 8062) == pytest.approx(1.1789224050631e-33, rel=1e-6)
    assert normal_two_sided(1.959963984540054) == pytest.approx(0.05)
