"""Queries for regressions with several absorbed factors, many segments, later errors and cells of covariates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellwright.catalog.base import near, rounded, table
from cellwright.catalog.estimation import PRICE, coefficients
from cellwright.operators.design import Square
from cellwright.operators.estimate import fit_table, logit, ols, segment_models, segment_table, stats_table, wald
from cellwright.operators.levels import ols_with_levels

TERMS = ["l_quantity", "l_discount", "l_tax"]


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem")


def fe_three_way(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three absorbed factors, of which two have many levels; errors clustered by one of them."""
    fit = ols(lines(spark, sf_dir), PRICE, TERMS, absorb=["l_suppkey", "l_partkey", "l_linenumber"], vcov="cluster", cluster="l_suppkey")
    return with_statistic(spark, fit)


def fe_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A factor with about as many levels as rows, clustered by another."""
    return with_statistic(spark, ols(lines(spark, sf_dir), PRICE, TERMS, absorb=["l_orderkey"], vcov="cluster", cluster="l_suppkey"))


def fe_orders_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    fit = ols(lines(spark, sf_dir), PRICE, TERMS, absorb=["l_orderkey"])
    return rounded(stats_table(spark, {"orders": fit}), ["value"], 5).where(F.col("stat").isin("n", "r2", "adj_r2", "within_r2", "rmse", "loglik", "aic", "bic"))


def fe_connected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two factors whose levels fall apart: suppliers by nation against nations by flag; parts are counted for the errors."""
    suppliers = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), "s_nationkey")
    rows = lines(spark, sf_dir).join(suppliers, "l_suppkey").withColumn("spell", F.concat_ws("-", "s_nationkey", "l_returnflag"))
    return with_statistic(spark, ols(rows, PRICE, ["l_quantity"], absorb=["l_suppkey", "spell"], degrees="components"))


def wald_clustered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A joint test under errors that are named after the fit, which has two absorbed factors."""
    fit = ols(lines(spark, sf_dir), PRICE, TERMS, absorb=["l_linenumber", "l_returnflag"], keep=["l_suppkey"])
    rows = []
    for name, test in (("plain", wald(fit, "discount|tax")), ("supplier", wald(fit, "discount|tax", cluster="l_suppkey")), ("robust", wald(fit, "discount|tax", vcov="hc1"))):
        rows.append((name, float(test["stat"]), float(test["p"]), int(test["df1"]), int(test["df2"]), str(test["vcov"])))
    return rounded(spark.createDataFrame(rows, "errors string, stat double, p double, df1 int, df2 bigint, vcov string"), ["stat", "p"], 6)


def segment_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same model for every supplier with robust errors; fits stay a table."""
    fits = segment_models(lines(spark, sf_dir), {"price": (PRICE, ["l_quantity", "l_discount"])}, ["l_suppkey"], vcov="hc1")
    rows = segment_table(fits).withColumns({c: near(F.col(c), 3) for c in ("estimate", "std_error", "statistic")})
    return rows.drop("p_value")


def segment_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same model for every line number with an absorbed factor and clustered errors."""
    model = {"price": (PRICE, ["l_quantity", "l_discount"])}
    fits = segment_models(lines(spark, sf_dir), model, ["l_linenumber"], absorb=["l_partkey"], vcov="cluster", cluster="l_suppkey")
    rows = segment_table(fits).withColumns({c: near(F.col(c), 3) for c in ("estimate", "std_error", "statistic")})
    return rows.drop("p_value")


def ols_long_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every part as a level of a text regressor, beside two numbers; the coefficients stay a table."""
    rows = lines(spark, sf_dir).withColumn("part", F.concat(F.lit("p"), F.col("l_partkey").cast("string")))
    found = ols_with_levels(rows, PRICE, ["l_quantity", "l_discount"], "part")
    return rounded(found, ["estimate", "std_error", "statistic"], 3).drop("p_value")


def logit_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A number, its square, another number and a text, with clustered errors; the table is read once."""
    rows = lines(spark, sf_dir).withColumn("cheap", (F.col("l_discount") > 0.05).cast("int"))
    fit = logit(rows, "cheap", ["l_quantity", Square("l_quantity"), "l_tax", "l_returnflag"], cluster="l_suppkey")
    return coefficients(spark, [fit], 5)


def with_statistic(spark: SparkSession, fit) -> DataFrame:
    return rounded(fit_table(spark, [fit]), ["estimate", "std_error", "statistic"], 3).drop("p_value")


QUERIES = {
    "fe_three_way": fe_three_way,
    "fe_orders": fe_orders,
    "fe_orders_statistics": fe_orders_statistics,
    "fe_connected": fe_connected,
    "wald_clustered": wald_clustered,
    "segment_errors": segment_errors,
    "segment_clusters": segment_clusters,
    "ols_long_text": ols_long_text,
    "logit_terms": logit_terms,
}


# SQL for the same. A symmetric matrix a is inverted by the columns of its Cholesky factor, written out.


def inverse(name: str, source: str, k: int) -> str:
    """Steps from a table with a matrix in ``a_i_j`` (i <= j) to ``name``, which adds the inverse ``v_i_j``.

    Every step is a table of its own, as the engine would write out names of one step again wherever they are used.
    """
    steps: list[list[str]] = []

    def minus(head: str, parts: Sequence[str]) -> str:
        return " - ".join([head, *parts])

    for j in range(k):
        steps.append([f"sqrt({minus(f'a_{j}_{j}', [f'l_{j}_{m} * l_{j}_{m}' for m in range(j)])}) AS l_{j}_{j}"])
        steps.append([f"({minus(f'a_{j}_{i}', [f'l_{i}_{m} * l_{j}_{m}' for m in range(j)])}) / l_{j}_{j} AS l_{i}_{j}" for i in range(j + 1, k)])
    for i in range(k):
        below = [f"-({' + '.join(f'l_{i}_{t} * w_{t}_{j}' for t in range(j, i))}) / l_{i}_{i} AS w_{i}_{j}" for j in range(i)]
        steps.append([*below, f"1 / l_{i}_{i} AS w_{i}_{i}"])
    steps.append([f"{' + '.join(f'w_{t}_{i} * w_{t}_{j}' for t in range(j, k))} AS v_{i}_{j}" for i in range(k) for j in range(i, k)])
    steps = [step for step in steps if step]
    out = []
    for number, step in enumerate(steps):
        table = name if number == len(steps) - 1 else f"{name}_{number}"
        out.append(f"{table} AS MATERIALIZED (SELECT *, {', '.join(step)} FROM {source})")
        source = table
    return ", ".join(out)


def pair(name: str, i: int, j: int) -> str:
    return f"{name}_{min(i, j)}_{max(i, j)}"


def swept(factors: Sequence[str], columns: Sequence[str], source: str, rounds: int, keep: Sequence[str] = ()) -> str:
    """Steps that take the factors' means out of the columns of a table in turn; the last one is ``swept``."""
    steps, before, kept = [], source, [*factors, *keep]
    for step in range(rounds * len(factors) if len(factors) > 1 else 1):
        factor = factors[step % len(factors)]
        taken = ", ".join(f"{c} - avg({c}) OVER (PARTITION BY {factor}) AS {c}" for c in columns)
        steps.append(f"w{step} AS MATERIALIZED (SELECT {', '.join(dict.fromkeys(kept))}, {taken} FROM {before})")
        before = f"w{step}"
    return f"{', '.join(steps)}, swept AS (SELECT * FROM {before})"


def solution(rows: str, k: int, group: str = "") -> str:
    """Steps ``sums`` to ``beta`` for y on x0 to x(k-1): coefficients b_i, the inverse v_i_j, rss, n and yy."""
    products = [f"sum(x{i} * x{j}) AS a_{i}_{j}" for i in range(k) for j in range(i, k)] + [f"sum(x{i} * y) AS c_{i}" for i in range(k)]
    head, tail = (f"{group}, ", f"GROUP BY {group}") if group else ("", "")
    b = [f"{' + '.join(f'{pair("v", i, j)} * c_{j}' for j in range(k))} AS b_{i}" for i in range(k)]
    return f"""
        sums AS MATERIALIZED (SELECT {head}count(*)::DOUBLE AS n, sum(y * y) AS yy, {", ".join(products)} FROM {rows} {tail}),
        {inverse("inverted", "sums", k)},
        beta AS MATERIALIZED (SELECT *, {", ".join(b)}, yy - ({" + ".join(f"b_{i} * c_{i}" for i in range(k))}) AS rss FROM inverted)"""


def sandwich(rows: str, k: int, cluster: str | None, group: str = "") -> str:
    """Steps ``scores`` to ``errors``: the covariances e_i_j before any factor, from clusters or from single rows."""
    residual = "y - " + " - ".join(f"b_{i} * x{i}" for i in range(k))
    joined = f"{rows} JOIN beta USING ({group})" if group else f"{rows}, beta"
    head = f"{group}, " if group else ""
    products = ", ".join(f"sum(u_{i} * u_{j}) AS m_{i}_{j}" for i in range(k) for j in range(i, k))
    if cluster:
        u = ", ".join(f"sum(x{i} * ({residual})) AS u_{i}" for i in range(k))
        first = f"scores AS (SELECT {head}{cluster}, {u} FROM {joined} GROUP BY {head}{cluster})"
    else:
        first = f"scores AS (SELECT {head}{', '.join(f'x{i} * ({residual}) AS u_{i}' for i in range(k))} FROM {joined})"
    cells = [
        f"{' + '.join(f'{pair("v", i, p)} * {pair("m", p, q)} * {pair("v", q, j)}' for p in range(k) for q in range(k))} AS e_{i}_{j}"
        for i in range(k)
        for j in range(i, k)
    ]
    middle = f"SELECT {head}count(*)::DOUBLE AS groups, {products} FROM scores {f'GROUP BY {group}' if group else ''}"
    joined = f"beta JOIN meat USING ({group})" if group else "beta, meat"
    return f"{first}, meat AS ({middle}), errors AS MATERIALIZED (SELECT *, {', '.join(cells)} FROM {joined})"


def listed(terms: Sequence[str], outcome: str, error: str, source: str, digits: int = 3, statistic: bool = True, head: str = "") -> str:
    """Coefficient rows; ``error`` is the variance of coefficient i."""
    nudge = f"{float(f'1.73e-{digits + 2}'):.{digits + 4}f}"

    def shown(value: str, name: str) -> str:
        return f"round({value} + {nudge}, {digits}) AS {name}"

    parts = []
    for i, term in enumerate(terms):
        spread = f"sqrt({error.format(i=i)})"
        ratio = f", {shown(f'b_{i} / {spread}', 'statistic')}" if statistic else ""
        parts.append(f"SELECT {head}'{outcome}' AS outcome, '{term}' AS term, {shown(f'b_{i}', 'estimate')}, {shown(spread, 'std_error')}{ratio}, n::BIGINT AS n FROM {source}")
    return "\nUNION ALL ".join(parts)


_X = ", ".join(f"{t} AS x{i}" for i, t in enumerate(TERMS))
_KEYS = "l_orderkey, l_suppkey, l_partkey, l_linenumber, l_returnflag"
_ROWS = f"r AS (SELECT {_KEYS}, l_extendedprice AS y, {_X} FROM lineitem)"
_FOUR = ["y", "x0", "x1", "x2"]


def _logit(steps: int, k: int) -> str:
    """Newton steps of a logit on cells with n rows and s ones; the last inverse and coefficients are in ``last``."""
    eta = " + ".join(f"b_{i} * x{i}" for i in range(k))
    parts = [f"b0 AS (SELECT {', '.join(f'0.0::DOUBLE AS b_{i}' for i in range(k))})"]
    for step in range(steps):
        sums = [f"sum(n * p * (1 - p) * x{i} * x{j}) AS a_{i}_{j}" for i in range(k) for j in range(i, k)] + [f"sum(x{i} * (s - n * p)) AS c_{i}" for i in range(k)]
        old = ", ".join(f"max(b_{i}) AS o_{i}" for i in range(k))
        new = ", ".join(f"o_{i} + {' + '.join(f'{pair("v", i, j)} * c_{j}' for j in range(k))} AS b_{i}" for i in range(k))
        parts.append(f"s{step} AS MATERIALIZED (SELECT {old}, {', '.join(sums)} FROM (SELECT *, 1 / (1 + exp(-({eta}))) AS p FROM cells, b{step}))")
        parts.append(inverse(f"i{step}", f"s{step}", k))
        parts.append(f"b{step + 1} AS MATERIALIZED (SELECT {new} FROM i{step})")
    inverted = ", ".join(f"v_{i}_{j}" for i in range(k) for j in range(i, k))
    return f"{', '.join(parts)}, beta AS MATERIALIZED (SELECT b{steps}.*, {inverted} FROM b{steps}, i{steps - 1})"


def _logit_terms() -> str:
    k, names = 6, ["l_quantity", "l_quantity square", "l_tax", "l_returnflagN", "l_returnflagR"]
    # Regressors: constant, (quantity - 25) / 10, its square, tax * 10, and two flags.
    cells = """
        cells AS MATERIALIZED (SELECT l_suppkey AS g, 1.0::DOUBLE AS x0, (l_quantity - 25) / 10 AS x1, pow((l_quantity - 25) / 10, 2) AS x2, l_tax * 10 AS x3,
            (l_returnflag = 'N')::INT::DOUBLE AS x4, (l_returnflag = 'R')::INT::DOUBLE AS x5, count(*)::DOUBLE AS n, sum((l_discount > 0.05)::INT)::DOUBLE AS s
            FROM lineitem GROUP BY ALL)"""
    eta = " + ".join(f"b_{i} * x{i}" for i in range(k))
    u = ", ".join(f"sum(x{i} * (s - n / (1 + exp(-({eta}))))) AS u_{i}" for i in range(k))
    products = ", ".join(f"sum(u_{i} * u_{j}) AS m_{i}_{j}" for i in range(k) for j in range(i, k))
    e = [
        f"f * ({' + '.join(f'{pair("v", i, p)} * {pair("m", p, q)} * {pair("v", q, j)}' for p in range(k) for q in range(k))}) AS e_{i}_{j}"
        for i in range(k)
        for j in range(i, k)
    ]
    # Back to the terms' own units, as weights of the regressors above.
    weights = {
        "(Intercept)": {0: 1.0, 1: -2.5, 2: 6.25},
        names[0]: {1: 0.1, 2: -0.5},
        names[1]: {2: 0.01},
        names[2]: {3: 10.0},
        names[3]: {4: 1.0},
        names[4]: {5: 1.0},
    }
    rows = []
    for term, w in weights.items():
        estimate = " + ".join(f"({x}) * b_{i}" for i, x in w.items())
        variance = " + ".join(f"({x * y}) * {pair('e', i, j)}" for i, x in w.items() for j, y in w.items())
        rows.append(
            f"SELECT 'cheap' AS outcome, '{term}' AS term, round({estimate} + 0.000000173, 5) AS estimate, round(sqrt({variance}) + 0.000000173, 5) AS std_error, rows::BIGINT AS n FROM e"
        )
    return f"""
        WITH {cells}, {_logit(7, k)},
        scores AS (SELECT g, {u} FROM cells, beta GROUP BY g),
        m AS (SELECT {products}, count(*)::DOUBLE AS gs, (SELECT sum(n) FROM cells) AS rows FROM scores),
        e AS MATERIALIZED (SELECT *, gs / (gs - 1) * (rows - 1) / (rows - {k}) AS f, {", ".join(e)} FROM beta, m)
        {" UNION ALL ".join(rows)}"""


def _wald() -> str:
    levels = "(SELECT count(DISTINCT l_linenumber) + count(DISTINCT l_returnflag) - 1 FROM lineitem)"

    def stat(name: str, factor: str, source: str, kind: str) -> str:
        # b' E^-1 b / 2 for the second and third coefficient.
        e = [f"({factor}) * {source}.{pair('e' if kind != 'iid' else 'v', i, j)}" for i, j in ((1, 1), (1, 2), (2, 2))]
        value = f"(b_1 * b_1 * {e[2]} - 2 * b_1 * b_2 * {e[1]} + b_2 * b_2 * {e[0]}) / ({e[0]} * {e[2]} - {e[1]} * {e[1]}) / 2"
        return f"SELECT '{name}' AS errors, {value} AS stat, n - k AS df2, '{kind}' AS vcov FROM {source}, counted"

    residual = "y - b_0 * x0 - b_1 * x1 - b_2 * x2"
    hc = ", ".join(f"sum(x{i} * x{j} * pow({residual}, 2)) AS m_{i}_{j}" for i in range(3) for j in range(i, 3))
    cells = [f"{' + '.join(f'{pair("v", i, p)} * {pair("m", p, q)} * {pair("v", q, j)}' for p in range(3) for q in range(3))} AS e_{i}_{j}" for i in range(3) for j in range(i, 3)]
    return f"""
        WITH {_ROWS}, {swept(["l_linenumber", "l_returnflag"], _FOUR, "r", 12, ["l_suppkey"])}, {solution("swept", 3)}, {sandwich("swept", 3, "l_suppkey")},
        loose AS (SELECT {hc} FROM swept, beta), robust AS (SELECT *, {", ".join(cells)} FROM beta, loose),
        counted AS (SELECT 3 + {levels} AS k),
        found AS (
          {stat("plain", "rss / (n - k)", "beta", "iid")}
          UNION ALL {stat("supplier", "groups / (groups - 1) * (n - 1) / (n - k)", "errors", "cluster")}
          UNION ALL {stat("robust", "n / (n - k)", "robust", "hc1")})
        SELECT errors, round(stat + 0.0000000173, 6) AS stat, round(pow(1 + 2 * stat / df2, -df2 / 2) + 0.0000000173, 6) AS p, 2::INT AS df1, df2::BIGINT AS df2, vcov FROM found"""


ORACLE = {
    "fe_three_way": f"""
        WITH {_ROWS}, {swept(["l_suppkey", "l_partkey", "l_linenumber"], _FOUR, "r", 14)}, {solution("swept", 3)}, {sandwich("swept", 3, "l_suppkey")},
        counted AS (SELECT *, groups / (groups - 1) * (n - 1) / (n - 3 - (SELECT count(DISTINCT l_partkey) + count(DISTINCT l_linenumber) - 1 FROM lineitem)) AS f FROM errors)
        {listed(TERMS, PRICE, "f * e_{i}_{i}", "counted")}""",
    "fe_orders": f"""
        WITH {_ROWS}, {swept(["l_orderkey"], _FOUR, "r", 1, ["l_suppkey"])}, {solution("swept", 3)}, {sandwich("swept", 3, "l_suppkey")},
        counted AS (SELECT *, groups / (groups - 1) * (n - 1) / (n - 3 - (SELECT count(DISTINCT l_orderkey) FROM lineitem)) AS f FROM errors)
        {listed(TERMS, PRICE, "f * e_{i}_{i}", "counted")}""",
    "fe_orders_statistics": f"""
        WITH {_ROWS}, {swept(["l_orderkey"], _FOUR, "r", 1)}, {solution("swept", 3)},
        t AS (SELECT *, (SELECT var_pop(y) * count(*) FROM r) AS tss, 3 + (SELECT count(DISTINCT l_orderkey) FROM lineitem) AS k,
                     -0.5 * n * (ln(2 * pi()) + ln(rss / n) + 1) AS ll FROM beta),
        p AS (SELECT unnest([{{'stat': 'n', 'value': n}}, {{'stat': 'r2', 'value': 1 - rss / tss}}, {{'stat': 'adj_r2', 'value': 1 - (rss / (n - k)) / (tss / (n - 1))}},
                {{'stat': 'within_r2', 'value': 1 - rss / yy}}, {{'stat': 'rmse', 'value': sqrt(rss / n)}}, {{'stat': 'loglik', 'value': ll}},
                {{'stat': 'aic', 'value': -2 * ll + 2 * k}}, {{'stat': 'bic', 'value': -2 * ll + k * ln(n)}}]) AS q FROM t)
        SELECT 'orders' AS fit, '{PRICE}' AS outcome, q.stat AS stat, round(q.value + 0.000000173, 5) AS value FROM p""",
    "fe_connected": f"""
        WITH r AS (SELECT l_suppkey, s_nationkey, s_nationkey::VARCHAR || '-' || l_returnflag AS spell, l_extendedprice AS y, l_quantity AS x0
                   FROM lineitem JOIN supplier ON l_suppkey = s_suppkey),
        {swept(["l_suppkey", "spell"], ["y", "x0"], "r", 14)}, {solution("swept", 1)},
        counted AS (SELECT *, rss / (n - 1 - (SELECT count(DISTINCT l_suppkey) + count(DISTINCT spell) - count(DISTINCT s_nationkey) FROM r)) AS f FROM beta)
        {listed(["l_quantity"], PRICE, "f * v_{i}_{i}", "counted")}""",
    "wald_clustered": _wald(),
    "segment_errors": f"""
        WITH m AS (SELECT l_suppkey, avg(l_quantity) AS mq, avg(l_discount) AS md FROM lineitem GROUP BY l_suppkey),
        r AS (SELECT l_suppkey, l_extendedprice AS y, 1.0::DOUBLE AS x0, l_quantity - mq AS x1, l_discount - md AS x2 FROM lineitem JOIN m USING (l_suppkey)),
        {solution("r", 3, "l_suppkey")}, {sandwich("r", 3, None, "l_suppkey")},
        back AS (SELECT l_suppkey, n, b_0 - mq * b_1 - md * b_2 AS b_0, b_1, b_2, n / (n - 3) AS f,
                 e_0_0 + mq * mq * e_1_1 + md * md * e_2_2 - 2 * mq * e_0_1 - 2 * md * e_0_2 + 2 * mq * md * e_1_2 AS e_0_0, e_1_1, e_2_2 FROM errors JOIN m USING (l_suppkey))
        {listed(["(Intercept)", "l_quantity", "l_discount"], PRICE, "f * e_{i}_{i}", "back", head="l_suppkey, 'price' AS fit, ")}""",
    "segment_clusters": f"""
        WITH {_ROWS}, c AS (SELECT l_linenumber, l_suppkey, y - avg(y) OVER w AS y, x0 - avg(x0) OVER w AS x0, x1 - avg(x1) OVER w AS x1 FROM r
             WINDOW w AS (PARTITION BY l_linenumber, l_partkey)),
        {solution("c", 2, "l_linenumber")}, {sandwich("c", 2, "l_suppkey", "l_linenumber")},
        levels AS (SELECT l_linenumber, count(DISTINCT l_partkey) AS k FROM lineitem GROUP BY l_linenumber),
        counted AS (SELECT errors.*, groups / (groups - 1) * (n - 1) / (n - 2 - k) AS f FROM errors JOIN levels USING (l_linenumber))
        {listed(["l_quantity", "l_discount"], PRICE, "f * e_{i}_{i}", "counted", head="l_linenumber, 'price' AS fit, ")}""",
    "ols_long_text": f"""
        WITH r AS (SELECT 'p' || l_partkey AS part, l_extendedprice AS y, l_quantity AS x0, l_discount AS x1 FROM lineitem),
        {swept(["part"], ["y", "x0", "x1"], "r", 1)}, {solution("swept", 2)},
        levels AS (SELECT part, count(*)::DOUBLE AS k, avg(y) AS my, avg(x0) AS m0, avg(x1) AS m1 FROM r GROUP BY part),
        f AS (SELECT k AS k1, my - b_0 * m0 - b_1 * m1 AS a1, m0 AS f0, m1 AS f1, part AS p1, beta.*, rss / (n - 2 - (SELECT count(*) FROM levels)) AS s2
              FROM levels, beta WHERE part = (SELECT min(part) FROM levels)),
        d AS (SELECT part, n, my - b_0 * m0 - b_1 * m1 - CASE WHEN part = p1 THEN 0 ELSE a1 END AS b, m0 - CASE WHEN part = p1 THEN 0 ELSE f0 END AS d0,
                     m1 - CASE WHEN part = p1 THEN 0 ELSE f1 END AS d1, 1 / k + CASE WHEN part = p1 THEN 0 ELSE 1 / k1 END AS w, part = p1 AS head, s2, v_0_0, v_0_1, v_1_1 FROM levels, f),
        t AS (SELECT CASE WHEN head THEN '(Intercept)' ELSE 'part' || part END AS term, b, sqrt(s2 * (w + d0 * d0 * v_0_0 + 2 * d0 * d1 * v_0_1 + d1 * d1 * v_1_1)) AS s, n FROM d
              UNION ALL SELECT 'l_quantity', b_0, sqrt(s2 * v_0_0), n FROM f UNION ALL SELECT 'l_discount', b_1, sqrt(s2 * v_1_1), n FROM f)
        SELECT '{PRICE}' AS outcome, term, round(b + 0.0000173, 3) AS estimate, round(s + 0.0000173, 3) AS std_error, round(b / s + 0.0000173, 3) AS statistic, n::BIGINT AS n FROM t""",
    "logit_terms": _logit_terms(),
}
