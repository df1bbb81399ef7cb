import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from cellwright.operators.design import Interact, Square
from cellwright.operators.estimate import (
    fit_subsets,
    fit_table,
    independent_columns,
    linear_models,
    logit,
    multi_outcome,
    ols,
    ols_by_segment,
    sweep,
    wald,
)


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(5)
    n = 600
    pdf = pd.DataFrame(
        {
            "x": rng.normal(3, 2, n),
            "age": rng.integers(20, 60, n).astype(float) + 1900,
            "sex": rng.choice(["Female", "Male"], n),
            "f": rng.integers(0, 8, n),
            "h": rng.integers(0, 5, n),
            "c": rng.integers(0, 25, n),
        }
    )
    pdf["h"] = (pdf.h + pdf.f // 3) % 5
    pdf["y"] = 1 + 0.5 * pdf.x + 0.01 * (pdf.age - 1930) ** 2 + (pdf.sex == "Male") + 0.3 * pdf.f - 0.2 * pdf.h + rng.normal(0, 1 + 0.2 * abs(pdf.x), n)
    pdf["hit"] = (rng.uniform(size=n) < 1 / (1 + np.exp(-(pdf.x - 3)))).astype(int)
    return spark.createDataFrame(pdf).repartition(4).cache(), pdf


def reference(X, y, k_extra=0):
    b = np.linalg.lstsq(X, y, rcond=None)[0]
    e = y - X @ b
    bread = np.linalg.pinv(X.T @ X)
    return b, e, bread, len(y) - X.shape[1] - k_extra


def basic(pdf):
    return np.column_stack([np.ones(len(pdf)), pdf.x, pdf.age, pdf.age**2, pdf.sex == "Male"]).astype(float)


TERMS = ["x", "age", Square("age"), "sex"]


def test_ols_iid_hc1_and_cluster(data):
    df, pdf = data
    X, y = basic(pdf), pdf.y.values
    Xc = X.copy()
    Xc[:, 3] = (X[:, 2] - 1930) ** 2
    b, e, bread, dof = reference(X, y)
    fit = ols(df, "y", TERMS)
    assert fit.terms == ["(Intercept)", "x", "age", "age square", "sexMale"]
    fitted = X @ fit.coef
    assert np.allclose(fitted, y - e, atol=1e-4)
    slopes = [1, 4]
    sigma2 = e @ e / dof
    bread_c = np.linalg.inv(np.column_stack([Xc[:, 0], Xc[:, 1], Xc[:, 2] - 1930, Xc[:, 3], Xc[:, 4]]).T @ np.column_stack([Xc[:, 0], Xc[:, 1], Xc[:, 2] - 1930, Xc[:, 3], Xc[:, 4]]))
    Z = np.column_stack([Xc[:, 0], Xc[:, 1], Xc[:, 2] - 1930, Xc[:, 3], Xc[:, 4]])
    assert np.allclose(fit.std_error[slopes], np.sqrt(sigma2 * np.diag(bread_c))[slopes], rtol=1e-6)
    hc = bread_c @ (Z.T @ (Z * (e**2)[:, None])) @ bread_c * len(y) / dof
    assert np.allclose(ols(df, "y", TERMS, vcov="hc1").std_error[slopes], np.sqrt(np.diag(hc))[slopes], rtol=1e-6)
    groups = pdf.c.nunique()
    scores = np.array([(Z * e[:, None])[pdf.c == g].sum(0) for g in sorted(pdf.c.unique())])
    cl = bread_c @ (scores.T @ scores) @ bread_c * groups / (groups - 1) * (len(y) - 1) / dof
    clustered = ols(df, "y", TERMS, vcov="cluster", cluster="c")
    assert np.allclose(clustered.std_error[slopes], np.sqrt(np.diag(cl))[slopes], rtol=1e-6)
    assert clustered.df_t == groups - 1
    assert fit.stats["r2"] == pytest.approx(1 - e @ e / ((y - y.mean()) @ (y - y.mean())))
    assert fit.stats["rmse"] == pytest.approx(math.sqrt(e @ e / len(y)))


@pytest.mark.parametrize("factors", [["f"], ["f", "h"]])
def test_absorbed_factors_equal_dummies(data, factors):
    df, pdf = data
    dummies = [np.asarray(pd.get_dummies(pdf[f], drop_first=bool(i)), dtype=float) for i, f in enumerate(factors)]
    X = np.column_stack([pdf.x, pdf.sex == "Male", *dummies]).astype(float)
    y = pdf.y.values
    b, e, bread, dof = reference(X, y)
    fit = ols(df, "y", ["x", "sex"], absorb=factors)
    assert np.allclose(fit.coef, b[:2], atol=1e-7)
    assert np.allclose(fit.std_error, np.sqrt(e @ e / dof * np.diag(bread))[:2], rtol=1e-6)
    hc = bread @ (X.T @ (X * (e**2)[:, None])) @ bread * len(y) / dof
    assert np.allclose(ols(df, "y", ["x", "sex"], absorb=factors, vcov="hc1").std_error, np.sqrt(np.diag(hc))[:2], rtol=1e-6)
    scores = np.array([(X * e[:, None])[pdf.c == g].sum(0) for g in sorted(pdf.c.unique())])
    groups = len(scores)
    cl = bread @ (scores.T @ scores) @ bread * groups / (groups - 1) * (len(y) - 1) / dof
    clustered = ols(df, "y", ["x", "sex"], absorb=factors, vcov="cluster", cluster="c")
    assert np.allclose(clustered.std_error, np.sqrt(np.diag(cl))[:2], rtol=1e-6)
    assert 0 < fit.stats["within_r2"] < fit.stats["r2"] < 1


def test_nested_factor_is_not_counted(data):
    df, _ = data
    fit = ols(df, "y", ["x"], absorb=["c"], vcov="cluster", cluster="c")
    free = ols(df, "y", ["x"], absorb=["c"])
    n, k = free.n, 1
    assert fit.coef == pytest.approx(free.coef)
    finer = df.withColumn("cc", F.concat_ws("-", "c", F.col("f") % 2))
    nested = ols(finer, "y", ["x"], absorb=["cc"], vcov="cluster", cluster="c")
    assert nested.df_t == fit.df_t and n > k


def test_segments_subsets_and_outcomes(data):
    df, pdf = data
    by = {f.segment["sex"]: f for f in ols_by_segment(df, "y", ["x"], ["sex"])}
    male = ols(df.where("sex = 'Male'"), "y", ["x"])
    assert by["Male"].coef == pytest.approx(male.coef) and by["Male"].vcov == pytest.approx(male.vcov)
    clustered = {f.segment["sex"]: f for f in ols_by_segment(df, "y", ["x"], ["sex"], absorb=["f"], vcov="cluster", cluster="c")}
    alone = ols(df.where("sex = 'Male'"), "y", ["x"], absorb=["f"], vcov="cluster", cluster="c")
    assert clustered["Male"].std_error == pytest.approx(alone.std_error)
    fits = fit_subsets(df, {"all": None, "male": F.col("sex") == "Male"}, "y", ["x"])
    assert fits["male"].coef == pytest.approx(male.coef)
    gappy = df.withColumn("y2", F.when(F.col("f") > 1, F.col("y") * 2))
    both = multi_outcome(gappy, ["y", "y2"], ["x"])
    assert both["y"].n == 600 and both["y2"].n == int((pdf.f > 1).sum())
    whole = multi_outcome(df.withColumn("y2", F.col("y") * 2), ["y", "y2"], ["x"], absorb=["f"])
    assert whole["y2"]["x"] == pytest.approx(2 * whole["y"]["x"])


@pytest.mark.parametrize("options", [{"vcov": "hc1"}, {"vcov": "cluster", "cluster": "c"}])
def test_errors_of_segments_take_one_job(data, options):
    df, _ = data
    flat = df.withColumn("x", F.when(F.col("h") == 4, 1.0).otherwise(F.col("x")))  # one segment loses its regressor
    by = {f.segment["h"]: f for f in ols_by_segment(flat, "y", ["x", "age"], ["h"], **options)}
    for h, fit in by.items():
        one = ols(flat.where(F.col("h") == h), "y", ["x", "age"], **options)
        assert fit.terms == one.terms and fit.coef == pytest.approx(one.coef) and fit.std_error == pytest.approx(one.std_error, rel=1e-6)
    assert by[4].dropped == ["x"]


def test_many_segments(spark):
    rows = spark.range(60_000).select((F.col("id") % 20_000).alias("s"), F.rand(3).alias("x"), (F.col("id") % 7).cast("double").alias("y"))
    fits = ols_by_segment(rows, "y", ["x"], ["s"], vcov="hc1")
    assert len(fits) == 20_000 and {f.n for f in fits} == {3}


def test_sweep_equals_single_fits(data):
    df, _ = data
    fits = sweep(df, "y", ["x", "age"], ["sex"], absorb=["f"])
    for name, fit in fits.items():
        one = ols(df, "y", [name, "sex"], absorb=["f"])
        assert fit.coef == pytest.approx(one.coef) and fit.vcov == pytest.approx(one.vcov)


def test_collinear_and_missing(data):
    df, _ = data
    more = df.withColumn("twice", F.col("x") * 2 + 1).withColumn("flat", F.lit(3.0))
    fit = ols(more, "y", ["x", "twice", "flat", "age"])
    assert fit.terms == ["(Intercept)", "x", "age"] and fit.dropped == ["twice", "flat"]
    within = ols(more.withColumn("ff", F.col("f") * 1.5), "y", ["ff", "x"], absorb=["f"])
    assert within.terms == ["x"] and within.dropped == ["ff"]
    holes = df.withColumn("x", F.when(F.col("f") != 2, F.col("x")))
    assert ols(holes, "y", ["x"]).n_missing == holes.where("x IS NULL").count() > 0
    assert independent_columns(np.array([[1.0, 1.0], [1.0, 1.0]])) == [0]


def test_period_interactions(spark, data):
    df, pdf = data
    panel = df.withColumn("YEAR", F.when(F.col("h") > 2, 1950).otherwise(1940))
    fit = ols(panel, "y", [Interact("YEAR", "x", (1940, 1950))], absorb=["f"], vcov="cluster", cluster="c")
    late = (pdf.h > 2).astype(float)
    X = np.column_stack([pdf.x * (1 - late), pdf.x * late, np.asarray(pd.get_dummies(pdf.f), dtype=float)]).astype(float)
    assert np.allclose(fit.coef, reference(X, pdf.y.values)[0][:2], atol=1e-8)
    assert fit.terms == ["YEAR1940:x", "YEAR1950:x"]


def test_logit_against_ml(spark, data):
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler

    df, pdf = data
    fit = logit(df, "hit", ["x", "sex"])
    frame = VectorAssembler(inputCols=["x", "m"], outputCol="v").transform(df.withColumn("m", (F.col("sex") == "Male").cast("double")))
    model = LogisticRegression(featuresCol="v", labelCol="hit", tol=1e-12, maxIter=200, standardization=False).fit(frame)
    assert np.allclose(fit.coef, [model.intercept, *model.coefficients], atol=1e-5)
    X = np.column_stack([np.ones(len(pdf)), pdf.x, pdf.sex == "Male"]).astype(float)
    p = 1 / (1 + np.exp(-X @ fit.coef))
    bread = np.linalg.inv(X.T @ (X * (p * (1 - p))[:, None]))
    assert np.allclose(fit.std_error, np.sqrt(np.diag(bread)), rtol=1e-6)
    s = np.array([(X * (pdf.hit - p).values[:, None])[pdf.c == g].sum(0) for g in sorted(pdf.c.unique())])
    g, n = len(s), len(pdf)
    v = bread @ (s.T @ s) @ bread * g / (g - 1) * (n - 1) / (n - 3)
    assert np.allclose(logit(df, "hit", ["x", "sex"], cluster="c").std_error, np.sqrt(np.diag(v)), rtol=1e-6)
    ll = float((pdf.hit * np.log(p) + (1 - pdf.hit) * np.log(1 - p)).sum())
    assert fit.stats["loglik"] == pytest.approx(ll) and fit.stats["aic"] == pytest.approx(-2 * ll + 6)


def test_separation_is_reported(spark):
    df = spark.createDataFrame([(float(i), int(i >= 10)) for i in range(20)], "x double, y int")
    with pytest.raises(RuntimeError):
        logit(df, "y", ["x"])


def test_wald(data):
    df, _ = data
    fit = ols(df, "y", TERMS)
    one = wald(fit, "^sexMale$")
    assert one["stat"] == pytest.approx((fit["sexMale"] / fit.std_error[4]) ** 2)
    assert one["p"] == pytest.approx(fit.p_values()[4]) and one["df1"] == 1 and one["df2"] == 595
    assert wald(fit, "age")["df1"] == 2
    with pytest.raises(ValueError):
        wald(fit, "nothing")


def test_tables(spark, data):
    df, _ = data
    out = fit_table(spark, ols_by_segment(df, "y", ["x"], ["sex"]))
    assert out.columns[:3] == ["sex", "outcome", "term"] and out.count() == 4
    named = linear_models(df, {"m": ("y", ["x"])})
    assert fit_table(spark, {"m": named["m"][0]}).count() == 2
