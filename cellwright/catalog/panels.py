"""Queries for joins, linkage, reshaping and moves."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellwright.catalog.base import near, rounded, table
from cellwright.catalog.recodes import YEARLY_SQL, yearly_orders, yearly_wide
from cellwright.functions.numeric import fill_zero, ratio
from cellwright.operators.joins import (
    either_side_listed,
    fold_full_join,
    id_coverage,
    keep_units,
    keyed_inner,
    link_periods,
    lookup_join,
)
from cellwright.operators.order import last_null, top_rows
from cellwright.operators.reshape import (
    melt,
    movers_table,
    pair_column,
    stock_ratio,
    to_long,
    to_wide,
    transition_shares,
    transitions,
)
from cellwright.operators.tabulate import match_rate
from cellwright.session import cut


def lookup_joins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Supplier to nation to region over renamed keys, with a suffix on what both sides have."""
    suppliers = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey", F.col("s_acctbal").alias("balance"))
    nations = table(spark, sf_dir, "nation").where(F.col("n_nationkey") > 2)
    regions = table(spark, sf_dir, "region")
    spending = table(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.sum("c_acctbal").alias("balance_area"))
    named = lookup_join(suppliers, nations, {"s_nationkey": "n_nationkey"})
    placed = lookup_join(named, regions, {"n_regionkey": "r_regionkey"})
    return rounded(lookup_join(placed, spending, {"s_nationkey": "c_nationkey"}), ["balance", "balance_area"], 2)


def suffixed_left_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of two sources by the same keys, the second joined to the first with suffixes."""
    orders = table(spark, sf_dir, "orders").withColumn("year", F.year("o_orderdate"))
    keys = ["o_orderpriority", "year"]
    everybody = orders.groupBy(*keys).agg(F.count("*").alias("n"))
    partial = orders.where((F.col("o_orderstatus") == "P") & (F.col("year") > 1995)).groupBy(*keys).agg(F.count("*").alias("n"))
    joined = lookup_join(everybody, cut(partial, "counts"), keys, suffixes=("_all", "_part"))
    return rounded(joined.withColumn("share", ratio(F.col("n_part"), F.col("n_all"))), ["share"], 6)


def keyed_inner_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_quantity")
    parts = table(spark, sf_dir, "part").where(F.col("p_size") < 10).select("p_partkey", "p_brand")
    joined = keyed_inner(lines, parts, {"l_partkey": "p_partkey"})
    return joined.groupBy("p_brand").agg(F.count("*").alias("n"), near(F.sum("l_quantity"), 2).alias("quantity"))


def chained_granularities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rates of two granularities joined to the same units; a missing rate counts zero."""
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_mktsegment", "c_acctbal")
    high = customers.where(F.col("c_acctbal") > 9000)
    fine = high.groupBy("c_nationkey", "c_mktsegment").agg(F.count("*").alias("n_fine"))
    wide = high.groupBy("c_nationkey").agg(F.count("*").alias("n_coarse"))
    joined = lookup_join(lookup_join(customers, fine, ["c_nationkey", "c_mktsegment"]), wide, ["c_nationkey"])
    return joined.select(
        "c_custkey", fill_zero(F.col("n_fine")).alias("n_fine"), fill_zero(F.col("n_coarse")).alias("n_coarse")
    )


def semi_join_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderpriority")
    heavy = table(spark, sf_dir, "lineitem").where(F.col("l_quantity") >= 50).select(F.col("l_orderkey").alias("o_orderkey"))
    return keep_units(orders, heavy, "o_orderkey", unique=True)


def coverage_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("o_orderkey")
    lines = table(spark, sf_dir, "lineitem").where(F.col("l_quantity") > 10).select("l_orderkey")
    return rounded(id_coverage(orders, lines, ("orders", "lines")), ["share_missing"], 6)


def match_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority")
    returned = table(spark, sf_dir, "lineitem").where(F.col("l_returnflag") == "A").select(F.col("l_orderkey").alias("o_orderkey"))
    linked = keep_units(orders, returned, "o_orderkey", unique=True)
    return rounded(match_rate(linked, orders, ["o_orderpriority"]), ["match_rate"], 6)


def order_bridge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each customer's last order of one year bridged to the first of the next."""
    orders = table(spark, sf_dir, "orders")
    per_unit = orders.groupBy("o_custkey").agg(
        F.max(F.when(F.year("o_orderdate") == 1996, F.col("o_orderkey"))).alias("id_1996"),
        F.min(F.when(F.year("o_orderdate") == 1997, F.col("o_orderkey"))).alias("id_1997"),
    )
    known = per_unit.where(F.col("id_1996").isNotNull() | F.col("id_1997").isNotNull())
    return cut(known.select("id_1996", "id_1997"), "bridge")


BRIDGE_SQL = """
bridge AS (
  SELECT * FROM (
    SELECT max(o_orderkey) FILTER (year(o_orderdate) = 1996) AS id_1996,
           min(o_orderkey) FILTER (year(o_orderdate) = 1997) AS id_1997
    FROM orders GROUP BY o_custkey)
  WHERE id_1996 IS NOT NULL OR id_1997 IS NOT NULL)"""


def bridge_either_side(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    first = orders.where(F.col("o_orderpriority") == "1-URGENT").select("o_orderkey")
    second = orders.where(F.col("o_orderpriority") == "5-LOW").select("o_orderkey")
    return either_side_listed(order_bridge(spark, sf_dir), "id_1996", first, "id_1997", second)


def bridge_link(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", "o_orderpriority", F.year("o_orderdate").alias("year"))
    return link_periods(
        order_bridge(spark, sf_dir),
        orders.where(F.col("year") == 1996),
        orders.where(F.col("year") == 1997),
        ("id_1996", "id_1997"),
        "o_orderkey",
        ("_1996", "_1997"),
    )


def fold_full_joins(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers = table(spark, sf_dir, "customer").where(F.col("c_nationkey") != 3).groupBy(F.col("c_nationkey").alias("nation"))
    suppliers = table(spark, sf_dir, "supplier").where(F.col("s_nationkey") != 5).groupBy(F.col("s_nationkey").alias("nation"))
    names = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("nation"), "n_name")
    frames = [
        customers.agg(F.count("*").alias("n_customers")),
        suppliers.agg(F.count("*").alias("n_suppliers"), near(F.sum("s_acctbal"), 2).alias("balance")),
        names.where(F.col("nation") > 1),
    ]
    return fold_full_join(frames, "nation")


def panel_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(yearly_wide(spark, sf_dir), ["spent_1996", "spent_1997"], 2)


def panel_wide_reduced(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wide with repeated rows added up."""
    orders = table(spark, sf_dir, "orders").select("o_orderpriority", "o_totalprice", F.year("o_orderdate").alias("year"))
    wide = to_wide(orders, ["o_orderpriority"], "year", [1996, 1997, 1998], ["o_totalprice"], "sum", "total_{period}")
    return rounded(wide, ["total_1996", "total_1997", "total_1998"], 2)


def panel_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide = yearly_wide(spark, sf_dir).withColumn("status_1998", F.lit(None).cast("string"))
    return rounded(to_long(wide, ["id"], ["spent", "status"], ["1996", "1997", "1998"], "year"), ["spent"], 2)


def panel_melt(spark: SparkSession, sf_dir: str) -> DataFrame:
    return melt(yearly_wide(spark, sf_dir), ["id"], ["orders_1996", "orders_1997"], "which", "orders")


def transitions_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = transitions(yearly_wide(spark, sf_dir), "priority_1996", "priority_1997")
    order = [last_null("n", descending=True), F.asc("priority_1996"), F.asc("priority_1997")]
    return top_rows(transition_shares(counts), order, 12)


def movers(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide = yearly_wide(spark, sf_dir).where(F.col("status_1996") != F.col("status_1997"))
    before = F.when(F.col("orders_1996") > 1, "many").otherwise("one")
    after = F.when(F.col("orders_1997") > 1, "many").otherwise("one")
    return movers_table(wide, ["status_1996"], before, after, ["many", "one"])


def movers_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with the pairs that the data hold: order counts of two years, of all customers that ordered in either."""
    wide = yearly_wide(spark, sf_dir)
    counts = [F.when(F.col(c) > 4, 4).otherwise(F.col(c)) for c in ("orders_1996", "orders_1997")]
    return movers_table(wide, ["status_1996"], *counts)


def move_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pair of states before and after as one key."""
    wide = yearly_wide(spark, sf_dir)
    keyed = wide.select(pair_column(["status_1996", "status_1997"]).alias("pair"))
    return keyed.groupBy("pair").agg(F.count("*").alias("n"))


def stock_ratio_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("o_custkey", F.year("o_orderdate").alias("year"))
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    placed = lookup_join(orders, customers, {"o_custkey": "c_custkey"}, "inner", null_safe=False)
    placed = placed.where(~((F.col("c_nationkey") == 4) & (F.col("year") == 1996)))
    return rounded(stock_ratio(placed, ["c_nationkey"], "year", 1996, 1997), ["stock_ratio"], 6)


QUERIES = {
    "lookup_joins": lookup_joins,
    "suffixed_left_join": suffixed_left_join,
    "keyed_inner_join": keyed_inner_join,
    "chained_granularities": chained_granularities,
    "semi_join_units": semi_join_units,
    "coverage_shares": coverage_shares,
    "match_rates": match_rates,
    "bridge_either_side": bridge_either_side,
    "bridge_link": bridge_link,
    "fold_full_join": fold_full_joins,
    "panel_wide": panel_wide,
    "panel_wide_reduced": panel_wide_reduced,
    "panel_long": panel_long,
    "panel_melt": panel_melt,
    "transitions_topk": transitions_topk,
    "movers": movers,
    "movers_found": movers_found,
    "move_pairs": move_pairs,
    "stock_ratio": stock_ratio_query,
}

ORACLE = {
    "lookup_joins": """
        WITH area AS (SELECT c_nationkey, sum(c_acctbal) AS balance_area FROM customer GROUP BY 1)
        SELECT s_suppkey, s_nationkey, round(s_acctbal + 0.000173, 2) AS balance, n_name, n_regionkey, r_name,
               round(balance_area + 0.000173, 2) AS balance_area
        FROM supplier LEFT JOIN (SELECT * FROM nation WHERE n_nationkey > 2) ON s_nationkey = n_nationkey
        LEFT JOIN region ON n_regionkey = r_regionkey LEFT JOIN area ON s_nationkey = c_nationkey""",
    "suffixed_left_join": """
        WITH o AS (SELECT o_orderpriority, o_orderstatus, year(o_orderdate)::INT AS year FROM orders),
        a AS (SELECT o_orderpriority, year, count(*) AS n FROM o GROUP BY ALL),
        p AS (SELECT o_orderpriority, year, count(*) AS n FROM o WHERE o_orderstatus = 'P' AND year > 1995 GROUP BY ALL)
        SELECT a.o_orderpriority, a.year, a.n AS n_all, p.n AS n_part, round(p.n / a.n::DOUBLE + 0.0000000173, 6) AS share
        FROM a LEFT JOIN p ON a.o_orderpriority = p.o_orderpriority AND a.year = p.year""",
    "keyed_inner_join": """
        SELECT p_brand, count(*) AS n, round(sum(l_quantity) + 0.000173, 2) AS quantity
        FROM lineitem JOIN part ON l_partkey = p_partkey WHERE p_size < 10 GROUP BY p_brand""",
    "chained_granularities": """
        WITH h AS (SELECT * FROM customer WHERE c_acctbal > 9000),
        f AS (SELECT c_nationkey, c_mktsegment, count(*) AS n FROM h GROUP BY ALL),
        w AS (SELECT c_nationkey, count(*) AS n FROM h GROUP BY ALL)
        SELECT c.c_custkey, coalesce(f.n, 0) AS n_fine, coalesce(w.n, 0) AS n_coarse
        FROM customer c LEFT JOIN f ON c.c_nationkey = f.c_nationkey AND c.c_mktsegment = f.c_mktsegment
        LEFT JOIN w ON c.c_nationkey = w.c_nationkey""",
    "semi_join_units": """
        SELECT o_orderkey, o_custkey, o_orderpriority FROM orders
        WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_quantity >= 50)""",
    "coverage_shares": """
        WITH l AS (SELECT l_orderkey FROM lineitem WHERE l_quantity > 10)
        SELECT 'orders' AS side, count(*) AS n_rows, count(*) FILTER (o_orderkey NOT IN (SELECT l_orderkey FROM l)) AS n_missing,
               round(count(*) FILTER (o_orderkey NOT IN (SELECT l_orderkey FROM l)) / count(*)::DOUBLE + 0.0000000173, 6) AS share_missing
        FROM orders
        UNION ALL
        SELECT 'lines', count(*), count(*) FILTER (l_orderkey NOT IN (SELECT o_orderkey FROM orders)),
               round(count(*) FILTER (l_orderkey NOT IN (SELECT o_orderkey FROM orders)) / count(*)::DOUBLE + 0.0000000173, 6)
        FROM l""",
    "match_rates": """
        WITH m AS (SELECT *, o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'A') AS hit FROM orders)
        SELECT o_orderpriority, count(*) FILTER (hit) AS n_linked, count(*) AS n_population,
               round(count(*) FILTER (hit) / count(*)::DOUBLE + 0.0000000173, 6) AS match_rate
        FROM m GROUP BY o_orderpriority""",
    "bridge_either_side": f"""
        WITH {BRIDGE_SQL}
        SELECT id_1996, id_1997 FROM bridge
        WHERE id_1996 IN (SELECT o_orderkey FROM orders WHERE o_orderpriority = '1-URGENT')
           OR id_1997 IN (SELECT o_orderkey FROM orders WHERE o_orderpriority = '5-LOW')""",
    "bridge_link": f"""
        WITH {BRIDGE_SQL}
        SELECT id_1996, id_1997, a.o_totalprice AS "o_totalprice_1996", a.o_orderpriority AS "o_orderpriority_1996",
               year(a.o_orderdate)::INT AS year_1996, b.o_totalprice AS "o_totalprice_1997",
               b.o_orderpriority AS "o_orderpriority_1997", year(b.o_orderdate)::INT AS year_1997
        FROM bridge JOIN orders a ON id_1996 = a.o_orderkey JOIN orders b ON id_1997 = b.o_orderkey""",
    "fold_full_join": """
        WITH c AS (SELECT c_nationkey AS nation, count(*) AS n_customers FROM customer WHERE c_nationkey <> 3 GROUP BY 1),
        s AS (SELECT s_nationkey AS nation, count(*) AS n_suppliers, round(sum(s_acctbal) + 0.000173, 2) AS balance FROM supplier
              WHERE s_nationkey <> 5 GROUP BY 1),
        n AS (SELECT n_nationkey AS nation, n_name FROM nation WHERE n_nationkey > 1)
        SELECT coalesce(cs.nation, n.nation) AS nation, n_customers, n_suppliers, balance, n_name
        FROM (SELECT coalesce(c.nation, s.nation) AS nation, n_customers, n_suppliers, balance
              FROM c FULL JOIN s ON c.nation = s.nation) cs FULL JOIN n ON cs.nation = n.nation""",
    "panel_wide": f"""
        WITH {YEARLY_SQL}
        SELECT * REPLACE (round(spent_1996 + 0.000173, 2) AS spent_1996, round(spent_1997 + 0.000173, 2) AS spent_1997) FROM wide""",
    "panel_wide_reduced": """
        SELECT o_orderpriority, round(sum(o_totalprice) FILTER (year(o_orderdate) = 1996) + 0.000173, 2) AS total_1996,
               round(sum(o_totalprice) FILTER (year(o_orderdate) = 1997) + 0.000173, 2) AS total_1997,
               round(sum(o_totalprice) FILTER (year(o_orderdate) = 1998) + 0.000173, 2) AS total_1998
        FROM orders GROUP BY 1""",
    "panel_long": f"""
        WITH {YEARLY_SQL}
        SELECT id, '1996' AS year, round(spent_1996 + 0.000173, 2) AS spent, status_1996 AS status FROM wide
        UNION ALL SELECT id, '1997', round(spent_1997 + 0.000173, 2), status_1997 FROM wide
        UNION ALL SELECT id, '1998', NULL, NULL FROM wide""",
    "panel_melt": f"""
        WITH {YEARLY_SQL}
        SELECT id, 'orders_1996' AS which, orders_1996 AS orders FROM wide
        UNION ALL SELECT id, 'orders_1997', orders_1997 FROM wide""",
    "transitions_topk": f"""
        WITH {YEARLY_SQL},
        t AS (SELECT priority_1996, priority_1997, count(*) AS n FROM wide
              WHERE priority_1996 IS NOT NULL AND priority_1997 IS NOT NULL AND priority_1996 <> priority_1997 GROUP BY ALL)
        SELECT *, round_even(n::DOUBLE / (SELECT sum(n) FROM t)::DOUBLE, 2) AS p FROM t
        ORDER BY n DESC, priority_1996, priority_1997 LIMIT 12""",
    "movers": f"""
        WITH {YEARLY_SQL},
        c AS (SELECT status_1996, orders_1996 > 1 AS a, coalesce(orders_1997 > 1, false) AS b FROM wide WHERE status_1996 <> status_1997)
        SELECT status_1996, count(*) FILTER (a AND b) AS "many_many", count(*) FILTER (a AND NOT b) AS "many_one",
               count(*) FILTER (NOT a AND b) AS "one_many", count(*) FILTER (NOT a AND NOT b) AS "one_one"
        FROM c GROUP BY 1""",
    "movers_found": f"""
        WITH {YEARLY_SQL},
        p AS (SELECT status_1996 AS s, least(orders_1996, 4)::VARCHAR AS a,
                     least(orders_1997, 4)::VARCHAR AS b, orders_1996, orders_1997 FROM wide),
        q AS (SELECT s, CASE WHEN orders_1996 IS NULL THEN 'NA' ELSE a END || '_' || CASE WHEN orders_1997 IS NULL THEN 'NA' ELSE b END AS pair, count(*) AS n FROM p GROUP BY ALL)
        SELECT s AS status_1996, coalesce(COLUMNS(* EXCLUDE (s)), 0)::BIGINT FROM (PIVOT q ON pair USING sum(n) GROUP BY s)""",
    "move_pairs": f"""
        WITH {YEARLY_SQL}
        SELECT concat_ws('_', status_1996, status_1997) AS pair, count(*) AS n FROM wide GROUP BY 1""",
    "stock_ratio": """
        WITH u AS (SELECT c_nationkey, year(o_orderdate) AS year FROM orders JOIN customer ON o_custkey = c_custkey
                   WHERE NOT (c_nationkey = 4 AND year(o_orderdate) = 1996)),
        c AS (SELECT c_nationkey, nullif(count(*) FILTER (year = 1996), 0) AS n_1996, nullif(count(*) FILTER (year = 1997), 0) AS n_1997
              FROM u WHERE year IN (1996, 1997) GROUP BY 1)
        SELECT *, round(n_1997 / n_1996::DOUBLE + 0.0000000173, 6) AS stock_ratio FROM c""",
}
