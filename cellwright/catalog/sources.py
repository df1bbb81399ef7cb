"""Queries that write the given tables in the source formats and read them back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellwright.catalog.base import near, table
from cellwright.functions.rules import rule_table
from cellwright.session import scratch_path
from cellwright.sources.delimited import area_attributes, read_csv_table, read_padded_csv, read_separated
from cellwright.sources.fixed_width import (
    Field,
    fixed_width_line,
    layout_fields,
    layout_from_widths,
    read_ddi_layout,
    read_fixed_width,
)
from cellwright.sources.tables import as_view, load_table, write_labelled_csv


def fixed_width_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers = table(spark, sf_dir, "customer")
    line = fixed_width_line(
        [
            (F.col("c_custkey"), 12),
            (F.col("c_name"), 20),
            (F.nullif("c_nationkey", F.lit(0)), 4),
            (F.round(F.col("c_acctbal") * 100).cast("bigint"), 12),
            (F.col("c_mktsegment"), 12),
        ]
    )
    path = scratch_path(spark, "cards")
    customers.select(line.alias("value")).write.text(path)
    names = layout_from_widths(
        [("c_custkey", 12), ("c_name", 20), ("c_nationkey", 4), ("c_acctbal", 12), ("c_mktsegment", 12)]
    )
    kinds = {"c_custkey": ("bigint", 0), "c_nationkey": ("int", 0), "c_acctbal": ("double", 2)}
    layout = [
        f._replace(kind=kinds[f.name][0], decimals=kinds[f.name][1]) if f.name in kinds else f for f in names
    ]
    return read_fixed_width(spark, path, layout)


def delimited_text_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    suppliers = table(spark, sf_dir, "supplier")
    names = ["s_suppkey", "s_name", "s_nationkey", "s_acctbal"]
    fields = [
        F.col("s_suppkey").cast("string"),
        F.concat(F.col("s_name"), F.lit(", Ltd")),
        F.coalesce(F.nullif("s_nationkey", F.lit(0)).cast("string"), F.lit("")),
        F.col("s_acctbal").cast("decimal(12,2)").cast("string"),
    ]
    line = F.concat(F.lit("~"), F.concat_ws("~^~", *fields), F.lit("~"))
    header = "~" + "~^~".join(names) + "~"
    path = scratch_path(spark, "separated")
    suppliers.select(line.alias("value")).union(rule_table(spark, [(header,)], "value string")).write.text(path)
    return read_separated(spark, path, names).select(
        F.col("s_suppkey").try_cast("bigint").alias("s_suppkey"),
        "s_name",
        F.col("s_nationkey").try_cast("int").alias("s_nationkey"),
        F.col("s_acctbal").try_cast("double").alias("s_acctbal"),
    )


def padded_csv_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers = table(spark, sf_dir, "customer")
    path = scratch_path(spark, "padded")
    balance = F.when(F.col("c_acctbal") > 0, F.col("c_acctbal").cast("decimal(12,2)").cast("string"))
    padded = customers.select(
        F.rpad("c_name", 24, " ").alias("c_name"),
        F.lpad("c_mktsegment", 16, " ").alias("c_mktsegment"),
        F.lpad(F.coalesce(balance, F.lit("")), 12, " ").alias("c_acctbal"),
    )
    padded.write.csv(path, header=True, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    return read_padded_csv(spark, path, "c_name string, c_mktsegment string, c_acctbal double")


def marked_csv_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CSV with a header and a marker for missing values."""
    parts = table(spark, sf_dir, "part").select(
        "p_partkey", "p_brand", F.when(F.col("p_size") > 10, F.col("p_size")).alias("p_size")
    )
    path = scratch_path(spark, "marked")
    parts.write.csv(path, header=True, nullValue="NA")
    return read_csv_table(spark, path, "p_partkey bigint, p_brand string, p_size int")


DDI_TEXT = """<?xml version="1.0" encoding="UTF-8"?>
<codeBook><dataDscr>
<var ID="ORDERKEY" name="ORDERKEY" dcml="0"><location StartPos="1" EndPos="12" width="12"/><varFormat type="numeric"/></var>
<var ID="YEAR" name="YEAR" dcml="0"><location StartPos="13" EndPos="16" width="4"/><varFormat type="numeric"/></var>
<var ID="PRICE" name="PRICE" dcml="2"><location StartPos="17" EndPos="30" width="14"/><varFormat type="numeric"/></var>
<var ID="STATUS" name="STATUS" dcml="0"><location StartPos="31" EndPos="31" width="1"/><varFormat type="character"/></var>
<var ID="PRIORITY" name="PRIORITY" dcml="0"><location StartPos="32" EndPos="47" width="16"/><varFormat type="character"/></var>
</dataDscr></codeBook>"""


def ddi_layout_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records cut by a metadata layout; only three of the five fields are cut."""
    layout_path, data_path = scratch_path(spark, "ddi"), scratch_path(spark, "records")
    rule_table(spark, [(DDI_TEXT,)], "value string").coalesce(1).write.text(layout_path)
    line = fixed_width_line(
        [
            (F.col("o_orderkey"), 12),
            (F.year("o_orderdate"), 4),
            (F.round(F.col("o_totalprice") * 100).cast("bigint"), 14),
            (F.col("o_orderstatus"), 1),
            (F.col("o_orderpriority"), 16),
        ]
    )
    table(spark, sf_dir, "orders").select(line.alias("value")).write.text(data_path)
    layout: list[Field] = layout_fields(read_ddi_layout(spark, layout_path))
    return read_fixed_width(spark, data_path, layout, ["ORDERKEY", "PRICE", "PRIORITY"])


def guarded_table_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Load once, skip the second load, pass through a view and a labelled CSV, and count."""
    orders = table(spark, sf_dir, "orders")
    path = scratch_path(spark, "loaded")
    kept = [("o_orderstatus", ["O", "F"])]
    _, written = load_table(orders, path, keep=kept)
    stored, skipped = load_table(orders, path)
    view = as_view(stored, "loaded_orders")
    labels = rule_table(
        spark,
        [("o_orderstatus", "O", "open"), ("o_orderstatus", "F", "filled")],
        "variable string, code string, label string",
    )
    csv_path = scratch_path(spark, "labelled")
    write_labelled_csv(view.select("o_orderkey", "o_orderstatus", "o_totalprice"), csv_path, labels, ["o_orderstatus"])
    back = read_csv_table(spark, csv_path, "o_orderkey bigint, o_orderstatus string, o_totalprice double")
    return back.groupBy("o_orderstatus").agg(
        F.count("*").alias("n"),
        near(F.sum("o_totalprice"), 2).alias("total"),
        F.lit(written).cast("bigint").alias("rows_written"),
        F.lit(skipped is None).alias("second_load_skipped"),
    )


def area_attribute_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Attribute rows with padded codes; suppliers stand in for areas."""
    suppliers = table(spark, sf_dir, "supplier")
    rows = suppliers.select(
        F.when(F.col("s_nationkey") == 2, "Alaska Territory").otherwise(F.concat(F.lit("State "), F.col("s_nationkey"))).alias("STATENAM"),
        F.col("s_name").alias("NHGISNAM"),
        F.lpad((F.col("s_nationkey") * 10 + F.when(F.col("s_nationkey") == 2, 5).otherwise(0)).cast("string"), 3, "0").alias("NHGISST"),
        F.lpad((F.col("s_suppkey") * 10).cast("string"), 6, "0").alias("NHGISCTY"),
        (F.col("s_suppkey") + 0.5).alias("ICPSRFIP"),
    )
    return area_attributes(rows)


QUERIES = {
    "fixed_width_scan": fixed_width_scan,
    "delimited_text_scan": delimited_text_scan,
    "padded_csv_scan": padded_csv_scan,
    "marked_csv_scan": marked_csv_scan,
    "ddi_layout_scan": ddi_layout_scan,
    "guarded_table_load": guarded_table_load,
    "area_attribute_scan": area_attribute_scan,
}

ORACLE = {
    "fixed_width_scan": """
        SELECT c_custkey, c_name, nullif(c_nationkey, 0) AS c_nationkey,
               round(c_acctbal * 100) / 100.0::DOUBLE AS c_acctbal, c_mktsegment
        FROM customer""",
    "delimited_text_scan": """
        SELECT s_suppkey, s_name || ', Ltd' AS s_name, nullif(s_nationkey, 0) AS s_nationkey,
               s_acctbal::DECIMAL(12,2)::DOUBLE AS s_acctbal
        FROM supplier""",
    "padded_csv_scan": """
        SELECT c_name, c_mktsegment, CASE WHEN c_acctbal > 0 THEN c_acctbal::DECIMAL(12,2)::DOUBLE END AS c_acctbal
        FROM customer""",
    "marked_csv_scan": "SELECT p_partkey, p_brand, CASE WHEN p_size > 10 THEN p_size END AS p_size FROM part",
    "ddi_layout_scan": """
        SELECT o_orderkey AS "ORDERKEY", round(o_totalprice * 100) / 100.0::DOUBLE AS "PRICE",
               o_orderpriority AS "PRIORITY"
        FROM orders""",
    "guarded_table_load": """
        WITH kept AS (SELECT * FROM orders WHERE o_orderstatus IN ('O', 'F'))
        SELECT CASE o_orderstatus WHEN 'O' THEN 'open' ELSE 'filled' END AS o_orderstatus, count(*) AS n,
               round(sum(o_totalprice) + 0.000173, 2) AS total, (SELECT count(*) FROM kept) AS rows_written,
               true AS second_load_skipped
        FROM kept GROUP BY 1""",
    "area_attribute_scan": """
        WITH a AS (
          SELECT CASE WHEN s_nationkey = 2 THEN 'Alaska Territory' ELSE 'State ' || s_nationkey END AS st, s_name,
                 lpad((s_nationkey * 10 + CASE WHEN s_nationkey = 2 THEN 5 ELSE 0 END)::VARCHAR, 3, '0') AS code,
                 lpad((s_suppkey * 10)::VARCHAR, 6, '0') AS cty, s_suppkey + 0.5::DOUBLE AS fip
          FROM supplier)
        SELECT CASE st WHEN 'Alaska Territory' THEN 'Alaska' WHEN 'Hawaii Territory' THEN 'Hawaii' ELSE st END AS "STATENAM",
               s_name AS "NHGISNAM", code AS "NHGISST", cty AS "NHGISCTY", fip::DOUBLE AS "ICPSRFIP",
               floor(code::BIGINT / 10)::INT AS "STATEFIP", cty::INT AS "COUNTYICP"
        FROM a""",
}
