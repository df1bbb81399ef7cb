"""Plans of the main operators: what is read, what is pushed down, and how often rows are shuffled."""

import re

import pytest

from cellwright.catalog import QUERIES
from cellwright.operators import cells, filters, joins, reshape
from cellwright.operators.absorb import factor_cells

SF_DIR = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def exchanges(df):
    return len(re.findall(r"Exchange hashpartitioning", plan(df)))


@pytest.fixture(scope="module")
def orders(spark):
    return spark.read.parquet(f"{SF_DIR}/orders.parquet")


def read_columns(text, table):
    scan = next(line for line in text.split("\n") if "FileScan" in line and table in line)
    return set(re.findall(r"(\w+)#", scan.split("FileScan parquet [")[1].split("]")[0]))


def test_only_the_needed_columns_are_read(spark):
    text = plan(QUERIES["cell_counts"](spark, SF_DIR))
    assert read_columns(text, "orders.parquet") == {"o_custkey", "o_orderdate"}
    assert read_columns(text, "customer.parquet") == {"c_custkey", "c_nationkey", "c_mktsegment"}
    text = plan(QUERIES["group_moments"](spark, SF_DIR))
    assert read_columns(text, "lineitem.parquet") == {"l_returnflag", "l_extendedprice", "l_shipdate"}


def test_filters_reach_the_scan(spark):
    assert re.search(r"PushedFilters: \[.*EqualTo\(l_returnflag,R\)", plan(QUERIES["cell_propensity_flagged"](spark, SF_DIR)))
    assert re.search(r"PushedFilters: \[.*GreaterThanOrEqual\(l_quantity,50.0\)", plan(QUERIES["semi_join_units"](spark, SF_DIR)))


def test_a_range_of_years_reaches_the_scan(spark):
    from cellwright.catalog.recodes import yearly_orders

    assert re.search(r"PushedFilters: \[.*GreaterThanOrEqual\(o_orderdate,1996-01-01", plan(yearly_orders(spark, SF_DIR, (1996, 1997))))


def test_one_shuffle_with_a_partial_aggregate(orders):
    counted = cells.cell_counts(orders, ["o_custkey", "o_orderstatus"])
    assert exchanges(counted) == 1 and plan(counted).count("HashAggregate") == 2
    first = filters.first_per_key(orders, ["o_custkey"], ["o_orderkey"])
    assert exchanges(first) == 1 and "Window" not in plan(first) and "partial_min_by" in plan(first)
    wide = reshape.to_wide(orders, ["o_custkey"], "o_orderstatus", ["O", "F"], ["o_totalprice"], reduce="sum")
    assert exchanges(wide) == 1
    moments = factor_cells(orders, ["o_custkey"], ["o_totalprice", "o_orderkey"])
    assert exchanges(moments) == 1 and "partial_sum" in plan(moments)
    # Only counts and sums are shuffled by level, no products of columns.
    shuffled = [line for line in plan(moments).split("\n") if "partial_sum" in line]
    assert shuffled and all("*" not in line.split("functions=")[-1].replace("count(1)", "") for line in shuffled)


def test_count_tables_are_stacked_not_joined(orders):
    a = cells.cell_counts(orders.where("o_orderstatus = 'F'"), ["o_custkey"])
    text = plan(cells.cell_propensity(a, cells.cell_counts(orders, ["o_custkey"]), ["o_custkey"]))
    assert "Join" not in text and "Union" in text


def test_many_tables_fold_in_one_shuffle(spark):
    frames = [spark.range(9).withColumnRenamed("id", "k").withColumn(f"v{i}", joins.F.lit(i)) for i in range(4)]
    folded = joins.fold_full_join(frames, "k")
    assert exchanges(folded) == 1 and "Join" not in plan(folded)


def test_grouping_sets_run_on_cells_in_one_pass(orders):
    counted = cells.flagged_propensity(orders, ["o_custkey", "o_orderstatus"], joins.F.col("o_totalprice") > 1e5)
    text = plan(cells.propensity_key_sets(counted, {"c": ["o_custkey"], "s": ["o_orderstatus"]}))
    assert text.count("Expand") == 1 and text.count("FileScan") == 1
