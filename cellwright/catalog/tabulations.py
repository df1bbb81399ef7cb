"""Queries for statistics and report tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellwright.catalog.base import UNITS_SQL, near, order_units, rounded, table
from cellwright.functions.numeric import count_where, share_where
from cellwright.operators.moments import group_moments, mean_band, pooled_moments, running_moments, weighted_mean
from cellwright.operators.order import last_null, top_rows
from cellwright.operators.tabulate import (
    balance_table,
    compare_sources,
    conditional_totals,
    crosstab,
    density_on_grid,
    fitted_line,
    histogram,
    level_table,
    shares,
    stack_sources,
)

SEGMENTS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]


def group_moments_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").withColumn("year", F.year("l_shipdate"))
    stats = mean_band(group_moments(lines, ["l_returnflag", "year"], ["l_extendedprice"]), "l_extendedprice")
    v = "l_extendedprice"
    return rounded(rounded(stats, [f"mean_{v}", f"sd_{v}", f"low_{v}", f"high_{v}"], 4), [f"var_{v}"], 1)


def conditional_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem")
    known = F.when(F.col("l_linenumber") > 1, F.col("l_returnflag"))
    return lines.groupBy("l_linestatus").agg(
        F.count("*").alias("n"),
        count_where(known == "R").alias("returned"),
        count_where(F.col("l_discount") > 0.05).alias("discounted"),
        near(share_where(known == "R"), 6).alias("share_returned"),
        near(F.stddev_samp("l_quantity"), 6).alias("sd_quantity"),
        near(F.lit(1942) - F.avg("l_quantity"), 6).alias("mean_age"),
    )


def conditional_totals_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    conditions = {"high": F.col("value") > 50, "early": F.dayofmonth("ts") <= 10, "odd_user": F.col("user_id") % 2 == 1}
    return conditional_totals(events, ["event_type"], conditions)


def price_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    return orders.groupBy("o_orderpriority", (F.col("o_orderkey") % 10).alias("chunk")).agg(
        F.count("*").alias("n"), F.avg("o_totalprice").alias("xbar"), F.var_samp("o_totalprice").alias("v")
    )


def pooled_variance(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = price_parts(spark, sf_dir)
    pooled = pooled_moments(parts, ["o_orderpriority"], "n", "xbar", "v", center=250_000)
    return rounded(rounded(pooled, ["mean", "sd"]), ["var"], 1)


def weighted_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = price_parts(spark, sf_dir)
    mean = weighted_mean(F.col("n"), F.when(F.col("chunk") > 0, F.col("xbar")))
    return parts.groupBy("o_orderpriority").agg(near(mean).alias("weighted"))


def running_moments_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    parts = orders.groupBy("o_orderpriority", F.to_date("o_orderdate").alias("day")).agg(
        F.count("*").alias("k"), F.avg("o_totalprice").alias("xbar"), F.var_samp("o_totalprice").alias("v")
    )
    running = running_moments(parts, ["day"], "k", "xbar", "v", ["o_orderpriority"], center=250_000)
    return rounded(running, ["mean", "sd"], 3).drop("var")


def crosstab_total_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers = table(spark, sf_dir, "customer").withColumn("nation", F.nullif("c_nationkey", F.lit(0)))
    counted = crosstab(customers, ["nation"], "c_mktsegment", SEGMENTS, with_total=True)
    return top_rows(counted, [last_null("total", descending=True), last_null("nation")], 20)


def two_source_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers = table(spark, sf_dir, "customer").where(F.col("c_nationkey") != 7)
    customers = customers.select(F.nullif("c_nationkey", F.lit(0)).alias("nation"))
    suppliers = table(spark, sf_dir, "supplier").where(F.col("s_nationkey") != 3)
    suppliers = suppliers.select(F.nullif("s_nationkey", F.lit(0)).alias("nation"))
    return rounded(compare_sources(customers, suppliers, ["nation"], ("customers", "suppliers")), ["ratio"], 6)


def stacked_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two tables stacked by column name; a column that one lacks is NULL there."""
    customers = table(spark, sf_dir, "customer").select(
        F.col("c_nationkey").alias("nation"), F.col("c_acctbal").alias("balance"), F.col("c_mktsegment").alias("segment")
    )
    suppliers = table(spark, sf_dir, "supplier").select(
        F.col("s_acctbal").alias("balance"), F.col("s_nationkey").alias("nation")
    )
    both = stack_sources({"customers": customers, "suppliers": suppliers}, "kind")
    return both.groupBy("kind", "segment").agg(F.count("*").alias("n"), near(F.sum("balance"), 2).alias("balance"))


def share_of_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(shares(table(spark, sf_dir, "events"), ["event_type"]), ["share"], 6)


def balance_table_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    measured = orders.select(
        "o_orderstatus",
        F.col("o_totalprice").alias("price"),
        F.year("o_orderdate").alias("year"),
        (F.col("o_orderpriority") == "1-URGENT").cast("int").alias("urgent"),
        F.when(F.col("o_custkey") % 3 > 0, F.col("o_custkey") % 100).alias("gappy"),
    )
    measures = ["price", "year", "urgent", "gappy"]
    return rounded(
        balance_table(measured, "o_orderstatus", ("F", "O"), measures),
        ["mean0", "sd0", "mean1", "sd1", "difference", "std_error"],
    )


def categorical_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").withColumn("year", F.year("o_orderdate"))
    return rounded(level_table(orders, ["o_orderpriority", "year"], ["o_orderstatus"]), ["pct"])


def histogram_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return histogram(table(spark, sf_dir, "events"), "value", 10.0, keys=["event_type"])


def density_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    density = density_on_grid(table(spark, sf_dir, "events"), "value", 0.0, 200.0, 41, 5.0, 0.01, ["event_type"])
    return rounded(density, ["x", "density"], 8)


def facet_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem")
    fit = fitted_line(lines, "l_extendedprice", "l_quantity", ["l_returnflag"])
    return rounded(rounded(fit, ["slope", "intercept"]), ["r2"], 8)


QUERIES = {
    "group_moments": group_moments_query,
    "conditional_shares": conditional_shares,
    "conditional_totals": conditional_totals_query,
    "pooled_variance": pooled_variance,
    "weighted_means": weighted_means,
    "running_moments": running_moments_query,
    "crosstab_total_topk": crosstab_total_topk,
    "two_source_compare": two_source_compare,
    "stacked_sources": stacked_sources,
    "share_of_total": share_of_total,
    "balance_table": balance_table_query,
    "categorical_summary": categorical_summary,
    "histogram": histogram_query,
    "density_grid": density_grid,
    "facet_fit": facet_fit,
}

_BALANCE = "\nUNION ALL\n".join(
    f"""SELECT '{m}' AS measure, count({m}) FILTER (s = 'F') AS n0, round(avg({m}) FILTER (s = 'F') + 0.00000173, 4) AS mean0,
        round(stddev_samp({m}) FILTER (s = 'F') + 0.00000173, 4) AS sd0, count({m}) FILTER (s = 'O') AS n1,
        round(avg({m}) FILTER (s = 'O') + 0.00000173, 4) AS mean1, round(stddev_samp({m}) FILTER (s = 'O') + 0.00000173, 4) AS sd1,
        round(avg({m}) FILTER (s = 'O') - avg({m}) FILTER (s = 'F') + 0.00000173, 4) AS difference,
        round(sqrt(var_samp({m}) FILTER (s = 'F') / count({m}) FILTER (s = 'F')
             + var_samp({m}) FILTER (s = 'O') / count({m}) FILTER (s = 'O')) + 0.00000173, 4) AS std_error FROM m"""
    for m in ("price", "year", "urgent", "gappy")
)

ORACLE = {
    "group_moments": """
        SELECT l_returnflag, year(l_shipdate)::INT AS year, count(*) AS n, count(l_extendedprice) AS "n_l_extendedprice",
               round(avg(l_extendedprice) + 0.00000173, 4) AS "mean_l_extendedprice", round(var_samp(l_extendedprice) + 0.00173, 1) AS "var_l_extendedprice",
               round(stddev_samp(l_extendedprice) + 0.00000173, 4) AS "sd_l_extendedprice",
               round(avg(l_extendedprice) - stddev_samp(l_extendedprice) + 0.00000173, 4) AS "low_l_extendedprice",
               round(avg(l_extendedprice) + stddev_samp(l_extendedprice) + 0.00000173, 4) AS "high_l_extendedprice"
        FROM lineitem GROUP BY 1, 2""",
    "conditional_shares": """
        WITH k AS (SELECT *, CASE WHEN l_linenumber > 1 THEN l_returnflag END AS known FROM lineitem)
        SELECT l_linestatus, count(*) AS n, count(*) FILTER (known = 'R') AS returned,
               count(*) FILTER (l_discount > 0.05::DOUBLE) AS discounted,
               round(avg((known = 'R')::INT::DOUBLE) + 0.0000000173, 6) AS share_returned,
               round(stddev_samp(l_quantity) + 0.0000000173, 6) AS sd_quantity, round(1942 - avg(l_quantity) + 0.0000000173, 6) AS mean_age
        FROM k GROUP BY l_linestatus""",
    "conditional_totals": """
        SELECT event_type, count(*) AS n, count(*) FILTER (value > 50) AS high, count(*) FILTER (day(ts) <= 10) AS early,
               count(*) FILTER (user_id % 2 = 1) AS odd_user
        FROM events GROUP BY event_type""",
    "pooled_variance": """
        SELECT o_orderpriority, count(*) AS n, round(avg(o_totalprice) + 0.00000173, 4) AS mean, round(var_samp(o_totalprice) + 0.00173, 1) AS var,
               round(stddev_samp(o_totalprice) + 0.00000173, 4) AS sd
        FROM orders GROUP BY o_orderpriority""",
    "weighted_means": """
        SELECT o_orderpriority, round(avg(o_totalprice) + 0.00000173, 4) AS weighted FROM orders WHERE o_orderkey % 10 > 0
        GROUP BY o_orderpriority""",
    "running_moments": """
        WITH p AS (
          SELECT o_orderpriority, o_orderdate::DATE AS day, count(*) AS k, sum(o_totalprice - 250000) AS s,
                 sum((o_totalprice - 250000) * (o_totalprice - 250000)) AS q
          FROM orders GROUP BY 1, 2),
        r AS (
          SELECT o_orderpriority, day, sum(k) OVER w AS n, sum(s) OVER w AS s, sum(q) OVER w AS q
          FROM p WINDOW w AS (PARTITION BY o_orderpriority ORDER BY day))
        SELECT o_orderpriority, day, n::BIGINT AS n, round(250000 + s / n + 0.0000173, 3) AS mean,
               CASE WHEN n > 1 THEN round(sqrt((q - s * s / n) / (n - 1)) + 0.0000173, 3) END AS sd
        FROM r""",
    "crosstab_total_topk": """
        SELECT nullif(c_nationkey, 0) AS nation, count(*) FILTER (c_mktsegment = 'AUTOMOBILE') AS "AUTOMOBILE",
               count(*) FILTER (c_mktsegment = 'BUILDING') AS "BUILDING", count(*) FILTER (c_mktsegment = 'FURNITURE') AS "FURNITURE",
               count(*) FILTER (c_mktsegment = 'HOUSEHOLD') AS "HOUSEHOLD", count(*) FILTER (c_mktsegment = 'MACHINERY') AS "MACHINERY",
               count(*) AS total
        FROM customer GROUP BY 1 ORDER BY total DESC NULLS LAST, nation NULLS LAST LIMIT 20""",
    "two_source_compare": """
        WITH c AS (SELECT nullif(c_nationkey, 0) AS nation, count(*) AS n FROM customer WHERE c_nationkey <> 7 GROUP BY 1),
        s AS (SELECT nullif(s_nationkey, 0) AS nation, count(*) AS n FROM supplier WHERE s_nationkey <> 3 GROUP BY 1)
        SELECT coalesce(c.nation, s.nation) AS nation, c.n AS customers, s.n AS suppliers, c.n - s.n AS difference,
               round(c.n::DOUBLE / s.n::DOUBLE + 0.0000000173, 6) AS ratio
        FROM c FULL JOIN s ON c.nation IS NOT DISTINCT FROM s.nation""",
    "stacked_sources": """
        SELECT 'customers' AS kind, c_mktsegment AS segment, count(*) AS n, round(sum(c_acctbal) + 0.000173, 2) AS balance
        FROM customer GROUP BY ALL
        UNION ALL SELECT 'suppliers', NULL, count(*), round(sum(s_acctbal) + 0.000173, 2) FROM supplier""",
    "share_of_total": """
        SELECT event_type, count(*) AS n, round(count(*)::DOUBLE / (SELECT count(*) FROM events)::DOUBLE + 0.0000000173, 6) AS share
        FROM events GROUP BY event_type""",
    "balance_table": f"""
        WITH m AS (
          SELECT o_orderstatus AS s, o_totalprice AS price, year(o_orderdate)::DOUBLE AS year,
                 (o_orderpriority = '1-URGENT')::INT::DOUBLE AS urgent,
                 CASE WHEN o_custkey % 3 > 0 THEN (o_custkey % 100)::DOUBLE END AS gappy
          FROM orders)
        {_BALANCE}""",
    "categorical_summary": """
        WITH l AS (
          SELECT o_orderstatus, 'o_orderpriority' AS variable, o_orderpriority AS level FROM orders
          UNION ALL SELECT o_orderstatus, 'year', year(o_orderdate)::VARCHAR FROM orders),
        c AS (SELECT o_orderstatus, variable, level, count(*) AS n FROM l GROUP BY ALL)
        SELECT *, round(n::DOUBLE / (sum(n) OVER (PARTITION BY o_orderstatus, variable))::DOUBLE * 100 + 0.00000173, 4) AS pct FROM c""",
    "histogram": """
        SELECT event_type, floor(value / 10)::BIGINT AS bin, count(*) AS n, floor(value / 10) * 10.0::DOUBLE AS low
        FROM events GROUP BY ALL""",
    "density_grid": """
        SELECT event_type, point::INT AS point, round(point * 5.0::DOUBLE + 0.000000000173, 8) AS x, count(*) AS n,
               round(sum(exp(-0.5::DOUBLE * pow((point * 5.0::DOUBLE - value) / 5.0::DOUBLE, 2))) / (5.0::DOUBLE * sqrt(2 * pi())) / count(*) + 0.000000000173, 8) AS density
        FROM events, range(0, 41) AS g(point) GROUP BY event_type, point""",
    "facet_fit": """
        SELECT l_returnflag, regr_count(l_extendedprice, l_quantity)::BIGINT AS n,
               round(regr_slope(l_extendedprice, l_quantity) + 0.00000173, 4) AS slope,
               round(regr_intercept(l_extendedprice, l_quantity) + 0.00000173, 4) AS intercept,
               round(regr_r2(l_extendedprice, l_quantity) + 0.000000000173, 8) AS r2
        FROM lineitem GROUP BY l_returnflag""",
}
