"""What the registered queries share: tables, the order cells, and rounding for comparison."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cellwright.operators.cells import cell_counts, cell_propensity, flagged_propensity
from cellwright.operators.joins import keep_units, lookup_join

CELL_KEYS = ["nation", "segment", "year"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def near(value: Column, digits: int = 4) -> Column:
    """A double rounded for comparison with another engine, whose sums run in another order.

    A small shift comes first. The mean of eight prices in cents often lies half-way between two rounded
    values, and there the order of a sum would decide. The SQL adds the same shift.
    """
    return F.round(value.cast("double") + F.lit(float(f"1.73e-{digits + 2}")), digits)


def rounded(df: DataFrame, columns: Sequence[str], digits: int = 4) -> DataFrame:
    return df.withColumns({c: near(F.col(c), digits) for c in columns})


def order_units(spark: SparkSession, sf_dir: str, columns: Sequence[str] = ()) -> DataFrame:
    """Orders with the cell keys of their customer. Nation 0 stands for a missing nation."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.year("o_orderdate").alias("year"), *columns)
    customers = table(spark, sf_dir, "customer").select(
        "c_custkey",
        F.nullif("c_nationkey", F.lit(0)).alias("nation"),
        F.col("c_mktsegment").alias("segment"),
    )
    return lookup_join(orders, customers, {"o_custkey": "c_custkey"}, "inner", null_safe=False)


def returned_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").where(F.col("l_returnflag") == "R").select(F.col("l_orderkey").alias("o_orderkey"))


def order_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells of all orders with the count of those that have a returned line, and the propensity."""
    returned = returned_orders(spark, sf_dir).distinct().withColumn("returned", F.lit(True))
    units = lookup_join(order_units(spark, sf_dir), returned, ["o_orderkey"], null_safe=False, hot=None)
    return flagged_propensity(units, CELL_KEYS, F.col("returned"))


def order_cells_two_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same cells from two separate tables of counts."""
    units = order_units(spark, sf_dir)
    treated = keep_units(units, returned_orders(spark, sf_dir), "o_orderkey", unique=True)
    return cell_propensity(cell_counts(treated, CELL_KEYS), cell_counts(units, CELL_KEYS), CELL_KEYS)


# The same steps in SQL, as leading common table expressions.
UNITS_SQL = """
units AS (
  SELECT o_orderkey, o_custkey, year(o_orderdate)::INT AS year, nullif(c_nationkey, 0) AS nation,
         c_mktsegment AS segment, o_totalprice, o_orderstatus, o_orderpriority
  FROM orders JOIN customer ON o_custkey = c_custkey)"""
CELLS_SQL = (
    UNITS_SQL
    + """,
returned AS (SELECT DISTINCT l_orderkey FROM lineitem WHERE l_returnflag = 'R'),
pop_cells AS (SELECT nation, segment, year, count(*) AS n FROM units GROUP BY ALL),
treated_cells AS (
  SELECT nation, segment, year, count(*) AS n FROM units WHERE o_orderkey IN (SELECT l_orderkey FROM returned) GROUP BY ALL),
cells AS (
  SELECT coalesce(p.nation, t.nation) AS nation, coalesce(p.segment, t.segment) AS segment,
         coalesce(p.year, t.year) AS year, coalesce(t.n, 0)::BIGINT AS n_treated, coalesce(p.n, 0)::BIGINT AS n_population
  FROM treated_cells t FULL JOIN pop_cells p
    ON t.nation IS NOT DISTINCT FROM p.nation AND t.segment IS NOT DISTINCT FROM p.segment
   AND t.year IS NOT DISTINCT FROM p.year)"""
)
