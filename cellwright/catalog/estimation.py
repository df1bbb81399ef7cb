"""Queries for regressions and streaming statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellwright.catalog.base import rounded, table
from cellwright.catalog.recodes import yearly_orders
from cellwright.operators.design import Interact, Square
from cellwright.operators.estimate import (
    fit_table,
    logit,
    multi_outcome,
    ols,
    segment_models,
    segment_table,
    stats_table,
    subset_models,
    sweep,
    wald,
)
from cellwright.operators.joins import lookup_join
from cellwright.streaming.group_stats import stream_group_stats

PRICE, TERMS = "l_extendedprice", ["l_quantity", "l_discount"]


def coefficients(spark: SparkSession, fits, digits: int = 4) -> DataFrame:
    out = fit_table(spark, fits)
    return rounded(out, ["estimate", "std_error"], digits).drop("statistic", "p_value")


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem")


def ols_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return coefficients(spark, [ols(lines(spark, sf_dir), PRICE, TERMS)], 3)


def ols_dummies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A text regressor as dummies, and a square."""
    rows = lines(spark, sf_dir)
    fit = ols(rows, PRICE, ["l_quantity", Square("l_quantity"), "l_discount", "l_returnflag"])
    return coefficients(spark, [fit], 3).drop("std_error")


def ols_robust(spark: SparkSession, sf_dir: str) -> DataFrame:
    return coefficients(spark, [ols(lines(spark, sf_dir), PRICE, TERMS, vcov="hc1")], 3).where(
        F.col("term") != "(Intercept)"
    )


def ols_clustered(spark: SparkSession, sf_dir: str) -> DataFrame:
    fit = ols(lines(spark, sf_dir), PRICE, TERMS, vcov="cluster", cluster="l_suppkey")
    return coefficients(spark, [fit], 3).where(F.col("term") != "(Intercept)")


def ols_by_segment_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    fits = segment_models(lines(spark, sf_dir), {PRICE: (PRICE, TERMS)}, ["l_returnflag"])
    return rounded(segment_table(fits), ["estimate", "std_error"], 3).drop("fit", "statistic", "p_value")


def ols_subsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    subsets = {"all": None, "many": F.col("l_quantity") > 25, "few returned": (F.col("l_quantity") <= 25) & (F.col("l_returnflag") == "R")}
    fits = subset_models(lines(spark, sf_dir), subsets, PRICE, TERMS)
    return rounded(segment_table(fits), ["estimate", "std_error"], 3).drop("statistic", "p_value")


def multi_outcome_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = lines(spark, sf_dir).withColumn("net", F.col(PRICE) * (1 - F.col("l_tax")))
    return coefficients(spark, multi_outcome(rows, [PRICE, "net"], TERMS), 3)


def fit_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    fit = ols(lines(spark, sf_dir), PRICE, TERMS)
    return rounded(stats_table(spark, {"ols": fit}), ["value"], 6).where(
        F.col("stat").isin("n", "r2", "adj_r2", "rmse", "loglik", "aic", "bic")
    )


def fe_ols_clustered(spark: SparkSession, sf_dir: str) -> DataFrame:
    fit = ols(lines(spark, sf_dir), PRICE, ["l_quantity"], absorb=["l_linenumber"], vcov="cluster", cluster="l_suppkey")
    return coefficients(spark, [fit])


def fe_ols_two_way(spark: SparkSession, sf_dir: str) -> DataFrame:
    fit = ols(lines(spark, sf_dir), PRICE, ["l_quantity"], absorb=["l_linenumber", "l_returnflag"])
    return coefficients(spark, [fit])


def fe_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One absorbed-factor fit per candidate regressor, in one pass."""
    fits = sweep(lines(spark, sf_dir), PRICE, ["l_quantity", "l_discount", "l_tax"], [], absorb=["l_linenumber"])
    return coefficients(spark, fits, 3)


def did_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    panel = yearly_orders(spark, sf_dir, (1996, 1997))
    people = table(spark, sf_dir, "customer").select(
        "c_custkey", F.col("c_nationkey").alias("nation"), (F.col("c_acctbal") / 10000).alias("exposure")
    )
    return lookup_join(panel, people, {"id": "c_custkey"}, "inner", null_safe=False)


def did_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exposure by period on the long panel, nation absorbed, errors clustered by nation."""
    term = Interact("year", "exposure", (1996, 1997))
    fit = ols(did_rows(spark, sf_dir), "spent", [term], absorb=["nation"], vcov="cluster", cluster="nation")
    return coefficients(spark, [fit], 2)


def did_robust(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same model with errors robust to unequal spread."""
    term = Interact("year", "exposure", (1996, 1997))
    return coefficients(spark, [ols(did_rows(spark, sf_dir), "spent", [term], absorb=["nation"], vcov="hc1")], 2)


def returned_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines(spark, sf_dir).withColumn("returned", (F.col("l_returnflag") == "R").cast("int"))


def logit_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return coefficients(spark, [logit(returned_rows(spark, sf_dir), "returned", ["l_quantity"])], 6)


def logit_clustered(spark: SparkSession, sf_dir: str) -> DataFrame:
    fit = logit(returned_rows(spark, sf_dir), "returned", ["l_quantity"], cluster="l_suppkey")
    return coefficients(spark, [fit], 6)


def wald_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    test = wald(ols(lines(spark, sf_dir), PRICE, TERMS), "l_quantity|l_discount")
    row = (float(test["stat"]), float(test["p"]), int(test["df1"]), int(test["df2"]), str(test["vcov"]))
    found = spark.createDataFrame([row], "stat double, p double, df1 int, df2 bigint, vcov string")
    return rounded(found, ["stat", "p"], 6)


def stream_group_stats_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = table(spark, sf_dir, "events").schema
    stats = stream_group_stats(spark, sf_dir, schema, ["event_type"], "value", pattern="events.parquet")
    return rounded(stats, ["total", "mean", "var"])


QUERIES = {
    "ols": ols_query,
    "ols_dummies": ols_dummies,
    "ols_robust": ols_robust,
    "ols_clustered": ols_clustered,
    "ols_by_segment": ols_by_segment_query,
    "ols_subsets": ols_subsets,
    "multi_outcome": multi_outcome_query,
    "fit_statistics": fit_statistics,
    "fe_ols_clustered": fe_ols_clustered,
    "fe_ols_two_way": fe_ols_two_way,
    "fe_sweep": fe_sweep,
    "did_panel": did_panel,
    "did_robust": did_robust,
    "logit": logit_query,
    "logit_clustered": logit_clustered,
    "wald": wald_query,
    "stream_group_stats": stream_group_stats_query,
}


def _sums(rows: str, group: str = "") -> str:
    """Centred sums of y, x and z of the rows, by group."""
    head, tail, part = (f"{group}, ", f"GROUP BY {group}", f"PARTITION BY {group}") if group else ("", "", "")
    return f"""
        r AS ({rows}),
        c AS (SELECT *, y - avg(y) OVER ({part}) AS dy, x - avg(x) OVER ({part}) AS dx, z - avg(z) OVER ({part}) AS dz FROM r),
        s AS (SELECT {head} count(*)::DOUBLE AS n, avg(y) AS my, avg(x) AS mx, avg(z) AS mz, sum(dx * dx) AS xx,
                     sum(dz * dz) AS zz, sum(dx * dz) AS xz, sum(dx * dy) AS xy, sum(dz * dy) AS zy, sum(dy * dy) AS yy
              FROM c {tail}),
        b AS (SELECT *, (xy * zz - zy * xz) / (xx * zz - xz * xz) AS b1, (zy * xx - xy * xz) / (xx * zz - xz * xz) AS b2 FROM s),
        f AS (SELECT *, yy - b1 * xy - b2 * zy AS rss, (yy - b1 * xy - b2 * zy) / (n - 3) AS s2, xx * zz - xz * xz AS d FROM b)"""


def _terms(outcome: str, names: tuple[str, str], head: str = "", digits: int = 3, source: str = "f") -> str:
    """Three coefficient rows with plain standard errors."""
    x, z = names
    nudge = f"{float(f'1.73e-{digits + 2}'):.{digits + 4}f}"
    return f"""
        SELECT {head} '{outcome}' AS outcome, '(Intercept)' AS term, round(my - b1 * mx - b2 * mz + {nudge}, {digits}) AS estimate,
               round(sqrt(s2 * (1 / n + (mx * mx * zz + mz * mz * xx - 2 * mx * mz * xz) / d)) + {nudge}, {digits}) AS std_error, n::BIGINT AS n FROM {source}
        UNION ALL SELECT {head} '{outcome}', '{x}', round(b1 + {nudge}, {digits}), round(sqrt(s2 * zz / d) + {nudge}, {digits}), n::BIGINT FROM {source}
        UNION ALL SELECT {head} '{outcome}', '{z}', round(b2 + {nudge}, {digits}), round(sqrt(s2 * xx / d) + {nudge}, {digits}), n::BIGINT FROM {source}"""


_LINES = "SELECT l_extendedprice AS y, l_quantity AS x, l_discount AS z, l_returnflag, l_suppkey, l_tax FROM lineitem"
_NAMES = ("l_quantity", "l_discount")

# Parts of each regressor that the other one and the constant do not explain, with the residual.
_PARTIALLED = f"""
        {_sums(_LINES)},
        e AS (SELECT c.*, f.n, f.b1, f.b2, f.xx - f.xz * f.xz / f.zz AS vx, f.zz - f.xz * f.xz / f.xx AS vz,
                     dx - f.xz / f.zz * dz AS tx, dz - f.xz / f.xx * dx AS tz, dy - f.b1 * dx - f.b2 * dz AS u FROM c, f)"""


def _robust(meat_x: str, meat_z: str, factor: str, source: str) -> str:
    return f"""
        SELECT 'l_extendedprice' AS outcome, 'l_quantity' AS term, round(max(b1) + 0.0000173, 3) AS estimate,
               round(sqrt({meat_x} / pow(max(vx), 2) * {factor}) + 0.0000173, 3) AS std_error, max(n)::BIGINT AS n FROM {source}
        UNION ALL
        SELECT 'l_extendedprice', 'l_discount', round(max(b2) + 0.0000173, 3), round(sqrt({meat_z} / pow(max(vz), 2) * {factor}) + 0.0000173, 3),
               max(n)::BIGINT FROM {source}"""


def _two_way(rounds: int) -> str:
    """Means by two factors taken out of cell sums in turn."""
    steps = ["k0 AS (SELECT l_linenumber AS f, l_returnflag AS g, count(*)::DOUBLE AS n, sum(l_quantity) AS x, sum(l_extendedprice) AS y FROM lineitem GROUP BY ALL)"]
    for i in range(rounds):
        key = "f" if i % 2 == 0 else "g"
        over = f"OVER (PARTITION BY {key})"
        steps.append(
            f"k{i + 1} AS MATERIALIZED (SELECT f, g, n, x - n * sum(x) {over} / sum(n) {over} AS x, y - n * sum(y) {over} / sum(n) {over} AS y FROM k{i})"
        )
    return f"""
        WITH {", ".join(steps)},
        t AS (SELECT k0.f, k0.g, (k0.x - k.x) / k.n AS tx, (k0.y - k.y) / k.n AS ty FROM k0 JOIN k{rounds} k USING (f, g)),
        w AS (SELECT l_quantity - tx AS x, l_extendedprice - ty AS y FROM lineitem JOIN t ON l_linenumber = f AND l_returnflag = g),
        s AS (SELECT count(*)::DOUBLE AS n, sum(x * x) AS xx, sum(x * y) AS xy, sum(y * y) AS yy FROM w),
        l AS (SELECT (SELECT count(DISTINCT f) FROM k0) + (SELECT count(DISTINCT g) FROM k0) - 1 + 1 AS k)
        SELECT 'l_extendedprice' AS outcome, 'l_quantity' AS term, round(xy / xx + 0.00000173, 4) AS estimate,
               round(sqrt((yy - xy * xy / xx) / (n - k) / xx) + 0.00000173, 4) AS std_error, n::BIGINT AS n
        FROM s, l"""


def _newton(steps: int) -> str:
    """Newton steps of a logit on a centred regressor, then the sums at the last point."""
    parts = [
        "d AS MATERIALIZED (SELECT (l_returnflag = 'R')::INT::DOUBLE AS y, l_quantity AS x, l_quantity - (SELECT avg(l_quantity) FROM lineitem) AS c, l_suppkey AS g FROM lineitem)",
        "b0 AS (SELECT 0.0::DOUBLE AS a, 0.0::DOUBLE AS b)",
    ]
    for i in range(steps):
        p = "1 / (1 + exp(-(a + b * c)))"
        parts.append(
            f"""s{i} AS MATERIALIZED (SELECT max(a) AS a, max(b) AS b, sum(y - {p}) AS ga, sum(c * (y - {p})) AS gb, sum({p} * (1 - {p})) AS h,
                sum(c * {p} * (1 - {p})) AS hc, sum(c * c * {p} * (1 - {p})) AS hcc FROM d, b{i}),
            b{i + 1} AS MATERIALIZED (SELECT a + (hcc * ga - hc * gb) / (h * hcc - hc * hc) AS a, b + (h * gb - hc * ga) / (h * hcc - hc * hc) AS b FROM s{i})"""
        )
    last = steps - 1
    return f"""{", ".join(parts)},
        m AS (SELECT avg(l_quantity) AS mx, count(*) AS n FROM lineitem),
        e AS (SELECT b - 0 AS slope, a - b * mx AS intercept, hcc / (h * hcc - hc * hc) AS va, h / (h * hcc - hc * hc) AS vb,
                     -hc / (h * hcc - hc * hc) AS vab, mx, n, a, b FROM s{last}, m)"""


_DID = """
        y AS (SELECT o_custkey AS id, year(o_orderdate)::INT AS year, sum(o_totalprice) AS spent FROM orders
              WHERE year(o_orderdate) IN (1996, 1997) GROUP BY ALL),
        r AS (SELECT spent AS y, c_nationkey AS g, CASE WHEN year = 1996 THEN c_acctbal / 10000 ELSE 0.0::DOUBLE END AS x,
                     CASE WHEN year = 1997 THEN c_acctbal / 10000 ELSE 0.0::DOUBLE END AS z
              FROM y JOIN customer ON id = c_custkey),
        c AS (SELECT g, y - avg(y) OVER (PARTITION BY g) AS dy, x - avg(x) OVER (PARTITION BY g) AS dx,
                     z - avg(z) OVER (PARTITION BY g) AS dz FROM r),
        s AS (SELECT count(*)::DOUBLE AS n, sum(dx * dx) AS xx, sum(dz * dz) AS zz, sum(dx * dz) AS xz, sum(dx * dy) AS xy,
                     sum(dz * dy) AS zy, count(DISTINCT g)::DOUBLE AS gs FROM c),
        b AS (SELECT *, (xy * zz - zy * xz) / (xx * zz - xz * xz) AS b1, (zy * xx - xy * xz) / (xx * zz - xz * xz) AS b2,
                     xx - xz * xz / zz AS vx, zz - xz * xz / xx AS vz FROM s),
        e AS (SELECT g, n, gs, b1, b2, vx, vz, dx - xz / zz * dz AS tx, dz - xz / xx * dx AS tz, dy - b1 * dx - b2 * dz AS u FROM c, b)"""

ORACLE = {
    "ols": f"WITH {_sums(_LINES)} {_terms(PRICE, _NAMES)}",
    "ols_dummies": """
        WITH r AS (SELECT l_returnflag AS g, l_extendedprice AS y, l_quantity - 25 AS x, pow(l_quantity - 25, 2) AS q, l_discount AS z FROM lineitem),
        m AS (SELECT g, avg(y) AS my, avg(x) AS mx, avg(q) AS mq, avg(z) AS mz FROM r GROUP BY g),
        c AS (SELECT y - my AS y, x - mx AS x, q - mq AS q, z - mz AS z FROM r JOIN m USING (g)),
        s AS (SELECT sum(x * x) AS xx, sum(x * q) AS xq, sum(x * z) AS xz, sum(q * q) AS qq, sum(q * z) AS qz, sum(z * z) AS zz,
                     sum(x * y) AS xy, sum(q * y) AS qy, sum(z * y) AS zy FROM c),
        d AS (SELECT *, xx * (qq * zz - qz * qz) - xq * (xq * zz - qz * xz) + xz * (xq * qz - qq * xz) AS det FROM s),
        b AS (SELECT (xy * (qq * zz - qz * qz) - xq * (qy * zz - qz * zy) + xz * (qy * qz - qq * zy)) / det AS bx,
                     (xx * (qy * zz - zy * qz) - xy * (xq * zz - qz * xz) + xz * (xq * zy - qy * xz)) / det AS bq,
                     (xx * (qq * zy - qz * qy) - xq * (xq * zy - xz * qy) + xy * (xq * qz - qq * xz)) / det AS bz FROM d),
        a AS (SELECT g, my - bx * mx - bq * mq - bz * mz AS level FROM m, b),
        l AS (SELECT max(level) FILTER (g = 'A') AS a, max(level) FILTER (g = 'N') AS n, max(level) FILTER (g = 'R') AS r FROM a),
        t AS (SELECT unnest([{'term': '(Intercept)', 'v': a - 25 * bx + 625 * bq}, {'term': 'l_quantity', 'v': bx - 50 * bq},
                {'term': 'l_quantity square', 'v': bq}, {'term': 'l_discount', 'v': bz}, {'term': 'l_returnflagN', 'v': n - a},
                {'term': 'l_returnflagR', 'v': r - a}]) AS k FROM l, b)
        SELECT 'l_extendedprice' AS outcome, k.term AS term, round(k.v + 0.0000173, 3) AS estimate,
               (SELECT count(*) FROM lineitem) AS n
        FROM t""",
    "ols_robust": f"""
        WITH {_PARTIALLED}
        {_robust("sum(tx * tx * u * u)", "sum(tz * tz * u * u)", "max(n) / (max(n) - 3)", "e")}""",
    "ols_clustered": f"""
        WITH {_PARTIALLED},
        k AS (SELECT l_suppkey, sum(tx * u) AS sx, sum(tz * u) AS sz, max(b1) AS b1, max(b2) AS b2, max(vx) AS vx,
                     max(vz) AS vz, max(n) AS n FROM e GROUP BY l_suppkey)
        {_robust("sum(sx * sx)", "sum(sz * sz)", "count(*) / (count(*) - 1)::DOUBLE * (max(n) - 1) / (max(n) - 3)", "k")}""",
    "ols_by_segment": f"WITH {_sums(_LINES, 'l_returnflag')} {_terms(PRICE, _NAMES, 'l_returnflag, ')}",
    "ols_subsets": "\nUNION ALL\n".join(
        f"SELECT '{name}' AS fit, * FROM (WITH {_sums(_LINES + where)} {_terms(PRICE, _NAMES)})"
        for name, where in (
            ("all", ""),
            ("many", " WHERE l_quantity > 25"),
            ("few returned", " WHERE l_quantity <= 25 AND l_returnflag = 'R'"),
        )
    ),
    "multi_outcome": "\nUNION ALL\n".join(
        f"SELECT '{name}' AS fit, * FROM (WITH {_sums(f'SELECT {y} AS y, l_quantity AS x, l_discount AS z FROM lineitem')} {_terms(name, _NAMES)})"
        for name, y in ((PRICE, "l_extendedprice"), ("net", "l_extendedprice * (1 - l_tax)"))
    ),
    "fit_statistics": f"""
        WITH {_sums(_LINES)},
        v AS (SELECT *, -0.5 * n * (ln(2 * pi()) + ln(rss / n) + 1) AS ll FROM f),
        p AS (SELECT unnest([{{'stat': 'n', 'value': n}}, {{'stat': 'r2', 'value': 1 - rss / yy}},
                {{'stat': 'adj_r2', 'value': 1 - (rss / (n - 3)) / (yy / (n - 1))}}, {{'stat': 'rmse', 'value': sqrt(rss / n)}},
                {{'stat': 'loglik', 'value': ll}}, {{'stat': 'aic', 'value': -2 * ll + 6}},
                {{'stat': 'bic', 'value': -2 * ll + 3 * ln(n)}}]) AS q FROM v)
        SELECT 'ols' AS fit, 'l_extendedprice' AS outcome, q.stat AS stat, round(q.value + 0.0000000173, 6) AS value FROM p""",
    "fe_ols_clustered": """
        WITH c AS (SELECT l_suppkey AS g, l_extendedprice - avg(l_extendedprice) OVER (PARTITION BY l_linenumber) AS y,
                          l_quantity - avg(l_quantity) OVER (PARTITION BY l_linenumber) AS x FROM lineitem),
        s AS (SELECT count(*)::DOUBLE AS n, sum(x * x) AS xx, sum(x * y) AS xy, sum(x * y) / sum(x * x) AS b FROM c),
        k AS (SELECT g, sum(x * (y - b * x)) AS u FROM c, s GROUP BY g),
        m AS (SELECT sum(u * u) AS meat, count(*)::DOUBLE AS gs FROM k),
        l AS (SELECT count(DISTINCT l_linenumber) AS levels FROM lineitem)
        SELECT 'l_extendedprice' AS outcome, 'l_quantity' AS term, round(b + 0.00000173, 4) AS estimate,
               round(sqrt(meat / (xx * xx) * gs / (gs - 1) * (n - 1) / (n - 1 - levels)) + 0.00000173, 4) AS std_error, n::BIGINT AS n
        FROM s, m, l""",
    "fe_ols_two_way": _two_way(16),
    "fe_sweep": "\nUNION ALL\n".join(
        f"""SELECT * FROM (
        WITH c AS (SELECT l_extendedprice - avg(l_extendedprice) OVER (PARTITION BY l_linenumber) AS y,
                          {x} - avg({x}) OVER (PARTITION BY l_linenumber) AS x FROM lineitem),
        s AS (SELECT count(*)::DOUBLE AS n, sum(x * x) AS xx, sum(x * y) AS xy, sum(y * y) AS yy FROM c),
        l AS (SELECT count(DISTINCT l_linenumber) AS levels FROM lineitem)
        SELECT '{x}' AS fit, 'l_extendedprice' AS outcome, '{x}' AS term, round(xy / xx + 0.0000173, 3) AS estimate,
               round(sqrt((yy - xy * xy / xx) / (n - 1 - levels) / xx) + 0.0000173, 3) AS std_error, n::BIGINT AS n FROM s, l)"""
        for x in ("l_quantity", "l_discount", "l_tax")
    ),
    "did_panel": f"""
        WITH {_DID},
        k AS (SELECT g, sum(tx * u) AS sx, sum(tz * u) AS sz, max(b1) AS b1, max(b2) AS b2, max(vx) AS vx, max(vz) AS vz,
                     max(n) AS n, max(gs) AS gs FROM e GROUP BY g),
        m AS (SELECT max(b1) AS b1, max(b2) AS b2, sum(sx * sx) / pow(max(vx), 2) AS v1, sum(sz * sz) / pow(max(vz), 2) AS v2,
                     max(n) AS n, max(gs) / (max(gs) - 1) * (max(n) - 1) / (max(n) - 3) AS f FROM k)
        SELECT 'spent' AS outcome, 'year1996:exposure' AS term, round(b1 + 0.000173, 2) AS estimate, round(sqrt(v1 * f) + 0.000173, 2) AS std_error, n::BIGINT AS n FROM m
        UNION ALL SELECT 'spent', 'year1997:exposure', round(b2 + 0.000173, 2), round(sqrt(v2 * f) + 0.000173, 2), n::BIGINT FROM m""",
    "did_robust": f"""
        WITH {_DID},
        m AS (SELECT max(b1) AS b1, max(b2) AS b2, sum(tx * tx * u * u) / pow(max(vx), 2) AS v1, sum(tz * tz * u * u) / pow(max(vz), 2) AS v2,
                     max(n) AS n, max(n) / (max(n) - 2 - max(gs)) AS f FROM e)
        SELECT 'spent' AS outcome, 'year1996:exposure' AS term, round(b1 + 0.000173, 2) AS estimate, round(sqrt(v1 * f) + 0.000173, 2) AS std_error, n::BIGINT AS n FROM m
        UNION ALL SELECT 'spent', 'year1997:exposure', round(b2 + 0.000173, 2), round(sqrt(v2 * f) + 0.000173, 2), n::BIGINT FROM m""",
    "logit": f"""
        WITH {_newton(8)}
        SELECT 'returned' AS outcome, '(Intercept)' AS term, round(intercept + 0.0000000173, 6) AS estimate,
               round(sqrt(va - 2 * mx * vab + mx * mx * vb) + 0.0000000173, 6) AS std_error, n FROM e
        UNION ALL SELECT 'returned', 'l_quantity', round(slope + 0.0000000173, 6), round(sqrt(vb) + 0.0000000173, 6), n FROM e""",
    "logit_clustered": f"""
        WITH {_newton(8)},
        k AS (SELECT g, sum(y - 1 / (1 + exp(-(a + b * c)))) AS sa, sum(c * (y - 1 / (1 + exp(-(a + b * c))))) AS sb FROM d, e GROUP BY g),
        q AS (SELECT sum(sa * sa) AS maa, sum(sa * sb) AS mab, sum(sb * sb) AS mbb,
                     count(*) / (count(*) - 1)::DOUBLE AS gf FROM k),
        v AS (SELECT e.*, gf * (n - 1) / (n - 2)::DOUBLE AS f,
                     va * va * maa + 2 * va * vab * mab + vab * vab * mbb AS waa,
                     vab * vab * maa + 2 * vab * vb * mab + vb * vb * mbb AS wbb,
                     va * vab * maa + (va * vb + vab * vab) * mab + vab * vb * mbb AS wab FROM e, q)
        SELECT 'returned' AS outcome, '(Intercept)' AS term, round(intercept + 0.0000000173, 6) AS estimate,
               round(sqrt(f * (waa - 2 * mx * wab + mx * mx * wbb)) + 0.0000000173, 6) AS std_error, n FROM v
        UNION ALL SELECT 'returned', 'l_quantity', round(slope + 0.0000000173, 6), round(sqrt(f * wbb) + 0.0000000173, 6), n FROM v""",
    "wald": f"""
        WITH {_sums(_LINES)},
        t AS (SELECT ((yy - rss) / 2) / s2 AS stat, n - 3 AS df2 FROM f)
        SELECT round(stat + 0.0000000173, 6) AS stat, round(pow(1 + 2 * stat / df2, -df2 / 2) + 0.0000000173, 6) AS p, 2::INT AS df1, df2::BIGINT AS df2, 'iid' AS vcov
        FROM t""",
    "stream_group_stats": """
        SELECT event_type, count(value) AS n, round(sum(value) + 0.00000173, 4) AS total, round(avg(value) + 0.00000173, 4) AS mean,
               round(var_samp(value) + 0.00000173, 4) AS var
        FROM events GROUP BY event_type""",
}
