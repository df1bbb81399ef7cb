"""Absorbed factors by conjugate gradients, connected parts, segments as a table, and errors asked for later."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellwright.operators import absorb
from cellwright.operators.absorb import connected_parts, dependent_levels, factor_cells
from cellwright.operators.design import Square
from cellwright.operators.estimate import linear_models, logit, ols, segment_models, segment_table, wald, with_errors
from cellwright.operators.levels import ols_with_levels


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(11)
    n = 1500
    pdf = pd.DataFrame({"x": rng.normal(0, 1, n), "w": rng.normal(5, 3, n), "f": rng.integers(0, 60, n), "h": rng.integers(0, 40, n), "k": rng.integers(0, 6, n), "c": rng.integers(0, 30, n)})
    # Levels that go together make plain sweeps slow.
    pdf["h"] = np.where(rng.uniform(size=n) < 0.6, (pdf.f * 2 // 3 + rng.integers(0, 2, n)) % 40, pdf.h)
    pdf["x"] += 0.1 * pdf.f
    pdf["y"] = 2 * pdf.x - pdf.w + 0.3 * pdf.f - 0.1 * pdf.h + pdf.k + rng.normal(0, 1, n)
    pdf["name"] = "level " + pdf.k.astype(str)
    return spark.createDataFrame(pdf).repartition(4).cache(), pdf


def dummies(pdf, factors):
    return np.column_stack([np.asarray(pd.get_dummies(pdf[f]), dtype=float) for f in factors])


@pytest.mark.parametrize("small", [0, 50_000])
def test_three_factors_equal_dummies(data, small):
    df, pdf = data
    factors = ["f", "h", "name"]
    fit = ols(df, "y", ["x", "w"], absorb=factors, vcov="cluster", cluster="c", small_cells=small)
    D = dummies(pdf, factors)
    left = lambda v: v - D @ np.linalg.lstsq(D, v, rcond=None)[0]
    X, y = np.column_stack([left(pdf.x.values), left(pdf.w.values)]), left(pdf.y.values)
    b = np.linalg.lstsq(X, y, rcond=None)[0]
    assert np.allclose(fit.coef, b, atol=1e-8)
    e, bread, n = y - X @ b, np.linalg.inv(X.T @ X), len(y)
    s = np.array([(X * e[:, None])[pdf.c == g].sum(0) for g in sorted(pdf.c.unique())])
    K = 2 + sum(pdf[f].nunique() for f in factors) - 2
    v = bread @ (s.T @ s) @ bread * len(s) / (len(s) - 1) * (n - 1) / (n - K)
    assert np.allclose(fit.std_error, np.sqrt(np.diag(v)), rtol=1e-6)
    assert fit.stats["rounds"] > 1


def test_rounds_are_fewer_than_those_of_plain_sweeps(spark):
    rng = np.random.default_rng(4)
    f = rng.integers(0, 60, 1500)
    h = np.where(rng.uniform(size=1500) < 0.9, (f * 2 // 3 + rng.integers(0, 2, 1500)) % 40, rng.integers(0, 40, 1500))
    pdf = pd.DataFrame({"f": f, "h": h, "x": rng.normal(0, 1, 1500) + 0.1 * f, "y": rng.normal(0, 1, 1500)})
    plain, rounds, moved = pdf.x.values.copy(), 0, 1.0
    while moved > 1e-9:
        before = plain.copy()
        for codes in (f, h):
            plain = plain - (np.bincount(codes, plain) / np.bincount(codes))[codes]
        rounds, moved = rounds + 1, abs(plain - before).max()
    assert ols(spark.createDataFrame(pdf), "y", ["x"], absorb=["f", "h"]).stats["rounds"] < rounds / 2


def test_too_few_rounds_are_an_error(data):
    for small in (0, 50_000):
        with pytest.raises(RuntimeError):
            ols(data[0], "y", ["x"], absorb=["f", "h"], most_rounds=2, small_cells=small)


@pytest.mark.parametrize("small", [0, 50_000])
def test_a_factor_that_refines_another_leaves_nothing_to_do(data, small):
    df, _ = data
    finer = df.withColumn("fk", F.concat_ws("-", "f", "k"))
    fit = ols(finer, "y", ["x"], absorb=["f", "fk"], degrees="components", small_cells=small)
    alone = ols(finer, "y", ["x"], absorb=["fk"])
    assert fit.stats["rounds"] == 0 and fit.coef == pytest.approx(alone.coef) and fit.std_error == pytest.approx(alone.std_error)


def test_a_level_for_almost_every_row(spark):
    rows = spark.range(4000).select((F.col("id") / 2).cast("long").alias("o"), F.rand(1).alias("x"), (F.col("id") % 13).alias("c")).withColumn("y", 3 * F.col("x") + F.col("o") + F.randn(2))
    fit = ols(rows, "y", ["x"], absorb=["o"], vcov="cluster", cluster="c")
    pdf = rows.toPandas()
    x, y = (pdf[v] - pdf.groupby("o")[v].transform("mean") for v in "xy")
    assert fit["x"] == pytest.approx((x * y).sum() / (x * x).sum()) and fit.n_params == 2001


def test_connected_parts(spark):
    rng = np.random.default_rng(2)
    edges = [(int(a), 1000 + int(b)) for a, b in rng.integers(0, 300, (220, 2))] + [(5000 + i, 9000 + i + d) for i in range(40) for d in (0, 1)]
    parts = {r["v"]: r["part"] for r in connected_parts(spark.createDataFrame(edges * 2, "a long, b long").repartition(3), "a", "b").collect()}
    root = {v: v for e in edges for v in e}

    def find(v):
        while root[v] != v:
            v = root[v]
        return v

    for a, b in edges:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    assert parts == {v: find(v) for v in root}


def test_connected_parts_of_no_edges(spark):
    assert connected_parts(spark.createDataFrame([], "a long, b long"), "a", "b").count() == 0


def test_dependent_levels_are_what_the_rank_lacks(spark):
    rows = [(s, f, 100 * s + f // 3 + (f + k) % 2) for s in (0, 1) for f in range(12 + s) for k in range(2)]
    df = spark.createDataFrame([(*r, float(i % 7), float(i % 5)) for i, r in enumerate(rows)], "s int, f int, h int, x double, y double")
    found = {r["s"]: r["dependent"] for r in dependent_levels(factor_cells(df, ["s", "f", "h"], ["x"]), ["s"], ["f", "h"]).collect()}
    for s in (0, 1):
        D = dummies(pd.DataFrame([r for r in rows if r[0] == s], columns=["s", "f", "h"]), ["f", "h"])
        assert found[s] == D.shape[1] - np.linalg.matrix_rank(D)
    D = dummies(pd.DataFrame(rows, columns=["s", "f", "h"]), ["f", "h"])
    fit = ols(df, "y", ["x"], absorb=["f", "h"], degrees="components")
    assert fit.n_params == 1 + np.linalg.matrix_rank(D)


def test_segments_stay_a_table(spark, data, monkeypatch):
    rows = spark.range(60_000).select((F.col("id") % 20_000).alias("s"), F.rand(3).alias("x"), (F.col("id") % 7).cast("double").alias("y"), (F.col("id") % 5).alias("c"))
    rows = rows.persist()
    collected = []
    whole, several = DataFrame.collect, DataFrame.toLocalIterator
    monkeypatch.setattr(DataFrame, "collect", lambda self: collected.append(self) or whole(self))
    monkeypatch.setattr(DataFrame, "toLocalIterator", lambda self, *a: collected.append(self) or several(self, *a))
    fits = {kind: segment_models(rows, {"m": ("y", ["x"])}, ["s"], vcov=kind) for kind in ("iid", "hc1")}
    assert all(f.count() == 20_000 for f in fits.values()) and not collected
    monkeypatch.undo()
    one = ols(rows.where("s = 77"), "y", ["x"], vcov="hc1")
    assert fits["hc1"].where("s = 77").first()["std_error"] == pytest.approx(list(one.std_error))
    assert segment_table(fits["iid"]).where("s = 5").count() == 2
    df, _ = data
    swept = segment_models(df, {"m": ("y", ["x"])}, ["k"], absorb=["f", "h"], vcov="cluster", cluster="c", degrees="components", small_cells=0)
    alone = ols(df.where("k = 3"), "y", ["x"], absorb=["f", "h"], vcov="cluster", cluster="c", degrees="components")
    row = swept.where("k = 3").first()
    assert row["coef"] == pytest.approx(list(alone.coef)) and row["std_error"] == pytest.approx(list(alone.std_error)) and row["n_params"] == alone.n_params


def test_errors_named_later(data):
    df, _ = data
    fit = ols(df, "y", ["x", "w"], absorb=["f", "k"], keep=["c"])
    for options in ({"vcov": "cluster", "cluster": "c"}, {"vcov": "hc1"}, {"vcov": "cluster", "cluster": "f"}):
        direct = ols(df, "y", ["x", "w"], absorb=["f", "k"], **options)
        assert with_errors(fit, **options).vcov == pytest.approx(direct.vcov)
        assert wald(fit, "x|w", **options)["stat"] == pytest.approx(wald(direct, "x|w")["stat"])
    assert wald(fit, "x", cluster="c")["vcov"] == "cluster" and wald(fit, "x")["vcov"] == "iid"
    with pytest.raises(ValueError):
        wald(fit, "x", cluster="h")
    holes = ols(df.withColumn("g", F.when(F.col("c") > 3, F.col("c"))), "y", ["x"], keep=["g"])
    assert holes.n == 1500
    with pytest.raises(ValueError):
        wald(holes, "x", cluster="g")


def test_logit_on_cells(spark, data):
    df, pdf = data
    rows = df.select((F.col("y") > 0).cast("int").alias("hit"), F.round("w").alias("w"), "name", "c", F.explode(F.sequence(F.lit(1), F.lit(3))).alias("copy"))
    once = logit(rows.where("copy = 1"), "hit", ["w", Square("w"), "name"])
    thrice = logit(rows, "hit", ["w", Square("w"), "name"], cluster="c")
    assert thrice.n == 3 * once.n and thrice.coef == pytest.approx(once.coef, rel=1e-6)
    assert thrice.stats["loglik"] == pytest.approx(3 * once.stats["loglik"])
    holes = rows.withColumn("name", F.when(F.col("name") != "level 2", F.col("name")))
    fit = logit(holes, "hit", ["name"])
    assert fit.n_missing == rows.where("name = 'level 2'").count() and "nameLevel 2" not in fit.terms
    with pytest.raises(ValueError):
        logit(rows.where("copy > 9"), "hit", ["w"])


def test_models_with_other_rows_get_their_own_pass(data):
    df, _ = data
    holes = df.withColumn("x2", F.when(F.col("k") > 2, F.col("x")))
    fits = linear_models(holes, {"a": ("y", ["x"]), "b": ("y", ["x2"])}, absorb=["f"])
    assert fits["a"][0].n == 1500 and fits["b"][0].n == holes.where("k > 2").count()
    table = segment_models(holes, {"a": ("y", ["x"]), "b": ("y", ["x2"])}, ["k"])
    assert table.where("fit = 'a'").count() == 6 and table.where("fit = 'b'").count() == 3




def test_a_text_with_5000_levels(spark, data):
    df, _ = data
    alike = ols(df, "y", ["x", "w", "name"])
    found = {r["term"]: r for r in ols_with_levels(df, "y", ["x", "w"], "name").collect()}
    assert set(found) == set(alike.terms)
    for row in alike.rows():
        assert [found[row[1]][c] for c in ("estimate", "std_error", "statistic", "p_value")] == pytest.approx(row[2:6], rel=1e-6, abs=1e-9)
    many = spark.range(15_000).select(F.format_string("%05d", F.col("id") % 5000).alias("t"), F.rand(1).alias("x")).withColumn("y", F.col("t").cast("double") / 100 + F.col("x") + F.randn(2) / 1000)
    table = ols_with_levels(many, "y", ["x"], "t")
    assert table.count() == 5001
    assert table.where("term = 't04999'").first()["estimate"] == pytest.approx(49.99, abs=0.02)


def same_fit(one, other):
    assert one.coef == pytest.approx(other.coef, abs=1e-8) and one.std_error == pytest.approx(other.std_error, rel=1e-6) and one.n_params == other.n_params


def test_rounds_read_packed_cells_and_shuffle_none(data, monkeypatch):
    df, _ = data
    read, written = [], []
    in_tasks, cut = absorb.in_tasks, absorb.cut
    monkeypatch.setattr(absorb, "in_tasks", lambda df, *a: read.append(df._jdf.queryExecution().executedPlan().toString()) or in_tasks(df, *a))
    monkeypatch.setattr(absorb, "cut", lambda df, label, *a: written.append(label) or cut(df, label, *a))
    fit = ols(df, "y", ["x", "w"], absorb=["f", "h", "name"], vcov="cluster", cluster="c", small_cells=0)
    assert len(read) == fit.stats["rounds"] + 2 > 5 and not any("Exchange" in plan or "Join" in plan for plan in read)
    assert sorted(written) == ["numbers", "numbers", "packed"]
    same_fit(fit, ols(df, "y", ["x", "w"], absorb=["f", "h", "name"], vcov="cluster", cluster="c"))


@pytest.mark.parametrize("copies, setting", [(1, {"HOT_CELLS": 20}), (1, {"LEVEL_NUMBERS": 0}), (3, {}), (3, {"HOT_CELLS": 1})])
def test_every_way_to_the_effects_is_the_same(data, monkeypatch, copies, setting):
    df = data[0].withColumn("copy", F.explode(F.sequence(F.lit(1), F.lit(copies))))
    options = {"absorb": ["f", "h", "name"], "vcov": "cluster", "cluster": "c"}
    wanted = ols(df, "y", ["x", "w"], **options)
    for name, value in setting.items():
        monkeypatch.setattr(absorb, name, value)
    same_fit(ols(df, "y", ["x", "w"], small_cells=0, **options), wanted)


def test_kept_columns_come_through_packed_rows(data):
    df, _ = data
    factors = ["f", "h", "k"]
    odd = df.select("x", "y", *factors, F.col("c").alias("n"), F.when(F.col("k") > 2, F.col("name")).alias("a b"), F.timestamp_seconds(F.col("c") * 86400).alias("day"))
    fit = ols(odd, "y", ["x"], absorb=factors, keep=["n", "a b", "day"], small_cells=0)
    rows = fit.source[0].rows
    for c in (*factors, "n", "a b", "day"):
        assert {r[0]: r[1] for r in rows.groupBy(f"`{c}`").count().collect()} == {r[0]: r[1] for r in odd.groupBy(f"`{c}`").count().collect()}
    assert with_errors(fit, "cluster", "day").std_error == pytest.approx(ols(odd, "y", ["x"], absorb=factors, vcov="cluster", cluster="day").std_error)


def test_long_packed_rows_are_taken_few_at_a_time(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(absorb, "PIECE_CELLS", 10)
    for lengths in ([], [30], [4, 4, 4, 4, 25, 1, 1], [10, 10, 10], [1] * 35):
        batch = pa.RecordBatch.from_pydict({"n": pa.array([[float(i)] * k for i, k in enumerate(lengths)], pa.list_(pa.float64()))})
        pieces = list(absorb._pieces([batch]))
        assert [v for piece in pieces for v in piece.column("n").to_pylist()] == batch.column("n").to_pylist()
        assert all(piece.num_rows == 1 or len(piece.column("n").flatten()) <= 10 + max(lengths) for piece in pieces)
