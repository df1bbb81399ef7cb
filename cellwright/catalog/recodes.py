"""Queries for projections, filters and recodes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from cellwright.catalog.base import UNITS_SQL, near, order_units, rounded, table
from cellwright.functions.numeric import (
    age_in,
    area_code,
    area_number,
    changed,
    compose_key,
    fill_zero,
    growth,
    mid_year,
    positive_log,
    strip_text,
)
from cellwright.functions.recode import (
    band,
    blank_sentinels,
    bounded_two_digit_year,
    columns_like,
    equal_width_bin,
    first_match,
    flag,
    groups_to_mapping,
    known,
    map_codes,
    scale_in_period,
    two_digit_year,
)
from cellwright.functions.rules import assign_region, rule_table, zone_flag
from cellwright.operators.filters import (
    at_or_above,
    complete_rows,
    first_per_key,
    flag_counts,
    id_quality,
    in_set,
    outside_sets,
    present_and_below,
    text_match,
    with_id_and_clean_name,
)
from cellwright.operators.joins import label_codes, recode_columns
from cellwright.operators.project import (
    aggregate_across,
    cast_types,
    distinct_values,
    rename_by,
    sample_rows,
    select_between,
    select_present,
    select_renamed,
)
from cellwright.operators.reshape import to_wide

PRIORITY_RANK = {"1-URGENT": 1, "2-HIGH": 2, "3-MEDIUM": 3, "4-NOT SPECIFIED": 4}
STATUS_GROUPS = [("closed", ["F"]), ("running", ["O", "F"]), ("partial", ["P", "O"])]
SIZE_BANDS = [(None, 5, "tiny"), (6, 15, "small"), (16, 30, "medium"), (31, 45, "large"), (46, None, "huge")]
AREA_RULES = [
    (0, [0, 5], "north"),
    (0, [5, 10, 15], "south"),
    (1, [1, 6, 11], "east"),
    (2, [2, 7], "west"),
    (2, [7, 12], "far west"),
]


def code_recode(spark: SparkSession, sf_dir: str) -> DataFrame:
    mapping, _ = groups_to_mapping(STATUS_GROUPS)
    labels = {code: f"rank {n}" for code, n in PRIORITY_RANK.items()}
    return table(spark, sf_dir, "orders").select(
        "o_orderkey",
        map_codes(F.col("o_orderpriority"), PRIORITY_RANK).alias("priority_rank"),
        map_codes(F.col("o_orderpriority"), labels, keep_unmatched=True).alias("priority_kept"),
        map_codes(F.col("o_orderpriority"), PRIORITY_RANK, default=9).alias("priority_default"),
        map_codes(F.col("o_orderstatus"), mapping).alias("status"),
    )


def dictionary_over_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    dictionary = rule_table(
        spark, [("R", "returned"), ("N", "none"), ("O", "open"), ("F", "filled")], "code string, value string"
    )
    labels = rule_table(
        spark,
        [("l_linenumber", "1", "first"), ("l_linenumber", "2", "second"), ("l_shipyear", "1998", "late")],
        "variable string, code string, label string",
    )
    lines = table(spark, sf_dir, "lineitem").select("l_returnflag", "l_linestatus", "l_linenumber")
    coded = recode_columns(lines, columns_like(lines, "^l_(return|line)(flag|status)$"), dictionary, keep_unmatched=True)
    counted = coded.groupBy(*coded.columns).agg(F.count("*").alias("n"))
    return label_codes(counted, labels, ["l_linenumber"])


def range_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", band(F.col("p_size"), SIZE_BANDS).alias("size_band"))


def equal_width_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    years = table(spark, sf_dir, "orders").select(
        F.lit("year").alias("kind"), equal_width_bin(F.year("o_orderdate"), 1995, 2000, 4).alias("bin")
    )
    sizes = table(spark, sf_dir, "part").select(
        F.lit("size").alias("kind"), equal_width_bin(F.col("p_size"), 1, 47, 5).alias("bin")
    )
    return years.unionByName(sizes).groupBy("kind", "bin").agg(F.count("*").alias("n"))


def two_key_region(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = table(spark, sf_dir, "customer").select(
        "c_custkey", (F.col("c_nationkey") % 5).alias("area"), F.col("c_nationkey").alias("part")
    )
    placed = assign_region(keys, "area", "part", AREA_RULES, ruled_states=[0, 1, 2])
    zoned = placed.withColumn("zone", zone_flag(F.col("area"), F.col("region"), [0, 1, 2], [1], ["south"]))
    return zoned.groupBy("area", "region", "zone").agg(F.count("*").alias("n"))


def two_digit_years(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    short = F.lpad((F.year("o_orderdate") % 100).cast("string"), 2, "0")
    code = F.when(F.col("o_custkey") % 50 == 0, "&&").when(F.col("o_custkey") % 50 == 1, "0-").otherwise(short)
    coded = orders.select(code.alias("code"))
    return (
        coded.withColumn("year", two_digit_year(F.col("code")))
        .withColumn("arrival", bounded_two_digit_year(F.col("code"), 96))
        .groupBy("code", "year", "arrival")
        .agg(F.count("*").alias("n"))
    )


def layered_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ordered rules over three columns, one of which may be missing; the first that holds wins."""
    units = order_units(spark, sf_dir, ["o_orderstatus"])
    rule = first_match(
        [
            (F.col("nation").isin(1, 2, 3) & (F.col("segment") == "BUILDING"), "home builder"),
            (F.col("nation").isin(1, 2, 3), "home other"),
            (F.col("o_orderstatus") == "P", "partial"),
            ((F.col("nation") > 12) & (F.col("year") < 1998), "abroad early"),
            (F.col("nation") > 12, "abroad late"),
        ],
        "rest",
    )
    return units.select(rule.alias("class"), "year").groupBy("class", "year").agg(F.count("*").alias("n"))


def sentinel_to_null(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("o_totalprice", F.year("o_orderdate").alias("year"))
    clean = blank_sentinels(orders, [("o_totalprice", 400000, 450000), ("year", 2001, 2001), ("absent", 0, 1)])
    scaled = clean.withColumn("price", scale_in_period(F.col("o_totalprice"), F.col("year"), 1996, 1.69))
    return scaled.groupBy("year").agg(
        F.count("*").alias("n"), F.count("price").alias("n_price"), near(F.sum("price"), 2).alias("total")
    )


def yearly_orders(spark: SparkSession, sf_dir: str, years: tuple[int, int] | None = None) -> DataFrame:
    """Spending, orders and last status per customer and year, of all years or from the first to the last one named."""
    orders = table(spark, sf_dir, "orders")
    if years:
        # A range of the column itself reaches the scan; the year of a date does not.
        first, end = (F.lit(f"{y}-01-01").cast("timestamp") for y in (years[0], years[1] + 1))
        orders = orders.where((F.col("o_orderdate") >= first) & (F.col("o_orderdate") < end))
    return orders.groupBy(F.col("o_custkey").alias("id"), F.year("o_orderdate").alias("year")).agg(
        F.sum("o_totalprice").alias("spent"),
        F.count("*").alias("orders"),
        F.max_by("o_orderstatus", F.col("o_orderkey")).alias("status"),
        F.max_by("o_orderpriority", F.col("o_orderkey")).alias("priority"),
    )


YEARLY_SQL = """
yearly AS (
  SELECT o_custkey AS id, year(o_orderdate)::INT AS year, sum(o_totalprice) AS spent, count(*) AS orders,
         max_by(o_orderstatus, o_orderkey) AS status, max_by(o_orderpriority, o_orderkey) AS priority
  FROM orders GROUP BY ALL),
wide AS (
  SELECT id, max(CASE WHEN year = 1996 THEN spent END) AS spent_1996, max(CASE WHEN year = 1997 THEN spent END) AS spent_1997,
         max(CASE WHEN year = 1996 THEN orders END) AS orders_1996, max(CASE WHEN year = 1997 THEN orders END) AS orders_1997,
         max(CASE WHEN year = 1996 THEN status END) AS status_1996, max(CASE WHEN year = 1997 THEN status END) AS status_1997,
         max(CASE WHEN year = 1996 THEN priority END) AS priority_1996, max(CASE WHEN year = 1997 THEN priority END) AS priority_1997
  FROM yearly GROUP BY id)"""


def yearly_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    values = ["spent", "orders", "status", "priority"]
    return to_wide(yearly_orders(spark, sf_dir), ["id"], "year", [1996, 1997], values)


def flags_and_growth(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = F.col("orders_1996"), F.col("orders_1997")
    return yearly_wide(spark, sf_dir).select(
        "id",
        near(growth(F.col("spent_1996"), F.col("spent_1997"))).alias("growth"),
        near(growth(a - 2, b)).alias("growth_from_zero"),
        mid_year(a, b).alias("middle"),
        changed([(F.col("status_1996"), F.col("status_1997"))]).alias("status_changed"),
        flag(F.col("status_1996").isin("P", "O")).alias("open_1996"),
        known(F.col("spent_1996"), F.col("spent_1997")).alias("in_both"),
        near(positive_log(a - 1)).alias("log_orders"),
        near(positive_log(F.col("spent_1997"), base10=True)).alias("log10_spent"),
        fill_zero(a).alias("orders_filled"),
        age_in(1942, b).alias("age"),
    )


def pad_and_compose_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    suppliers = table(spark, sf_dir, "supplier")
    code = area_code(F.col("s_nationkey"), 3, 10)
    return suppliers.select(
        "s_suppkey",
        code.alias("state_code"),
        area_code(F.col("s_suppkey"), 6).alias("county_code"),
        area_number(code, 10).alias("state"),
        area_number(F.concat(F.lit("x"), code)).alias("bad"),
        compose_key(F.col("s_nationkey"), F.col("s_suppkey")).alias("area_key"),
        strip_text(F.concat(F.lit("  "), F.col("s_name"), F.lit("~ ")), "~|#").alias("name"),
    )


def complete_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Units complete in both years, through each filter in turn."""
    wide = yearly_wide(spark, sf_dir)
    wide = present_and_below(wide, ["spent_1996"], {"spent_1996": 2_000_000.0})
    wide = complete_rows(wide, ["spent_1996", "spent_1997"])
    wide = in_set(wide, "status_1996", ["F", "O", "P"])
    wide = outside_sets(wide, {"priority_1997": ["5-LOW"]}, {"spent_1997": 50_000.0})
    wide = at_or_above(wide, "orders_1997", 1, 2)
    return wide.select("id", "orders_1996", "orders_1997", "status_1996", "priority_1997")


def completeness_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many units pass each check, by status."""
    wide = yearly_wide(spark, sf_dir)
    flags = {
        "known_spent": known(F.col("spent_1996"), F.col("spent_1997")),
        "same_status": F.col("status_1996") == F.col("status_1997"),
        "same_priority": F.col("priority_1996") == F.col("priority_1997"),
    }
    return flag_counts(wide, flags, ["status_1996"])


def text_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    named = with_id_and_clean_name(documents, "source", "text", "|")
    return text_match(named, "text", r"(?i)\bthe\b", {"lang": "en"}).select("doc_id", "source", "n_chars")


def first_of_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    return first_per_key(documents, ["lang", "text"], ["doc_id"]).select("doc_id", "lang", "source", "n_chars")


def id_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("c_custkey") % 40
    ids = table(spark, sf_dir, "customer").select(
        F.when(key == 0, None)
        .when(key == 1, F.concat(F.lit(" "), F.col("c_name")))
        .when(key == 2, F.lit(""))
        .otherwise(F.col("c_name"))
        .alias("id")
    )
    return id_quality(ids, "id")


def projection_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "part")
    some = select_present(parts, ["p_size", "no_such_column", "p_retailprice", "p_partkey", "p_type", "p_brand"])
    upper = rename_by(some, str.upper, ["p_brand", "p_type"])
    slice_ = select_between(upper, "p_size", "p_partkey", "P_BRAND")
    named = select_renamed(slice_, {"key": "p_partkey", "size": "p_size", "price": "p_retailprice", "brand": "P_BRAND"})
    return cast_types(named, DoubleType, "decimal(12,2)").withColumn("price", F.col("price").cast("double"))


def across_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem")
    rules = {"total": lambda c: near(F.sum(c), 2), "most": F.max}
    return aggregate_across(lines, ["l_returnflag"], ["l_quantity", "l_tax", "not_there"], rules)


def distinct_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return distinct_values(table(spark, sf_dir, "part"), "p_brand")


def exact_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sample_rows(table(spark, sf_dir, "part"), 100, ["p_partkey"], seed=7)


QUERIES = {
    "code_recode": code_recode,
    "dictionary_over_columns": dictionary_over_columns,
    "range_bands": range_bands,
    "equal_width_bins": equal_width_bins,
    "two_key_region": two_key_region,
    "two_digit_year": two_digit_years,
    "layered_class": layered_class,
    "sentinel_to_null": sentinel_to_null,
    "flags_and_growth": flags_and_growth,
    "pad_and_compose_keys": pad_and_compose_keys,
    "complete_units": complete_units,
    "completeness_flags": completeness_flags,
    "text_filter": text_filter,
    "first_of_duplicates": first_of_duplicates,
    "id_quality": id_checks,
    "projection_variants": projection_variants,
    "across_columns": across_columns,
    "distinct_codes": distinct_codes,
    "exact_sample": exact_sample,
}

ORACLE = {
    "code_recode": """
        SELECT o_orderkey,
          CASE o_orderpriority WHEN '1-URGENT' THEN 1 WHEN '2-HIGH' THEN 2 WHEN '3-MEDIUM' THEN 3
               WHEN '4-NOT SPECIFIED' THEN 4 END AS priority_rank,
          CASE o_orderpriority WHEN '1-URGENT' THEN 'rank 1' WHEN '2-HIGH' THEN 'rank 2' WHEN '3-MEDIUM' THEN 'rank 3'
               WHEN '4-NOT SPECIFIED' THEN 'rank 4' ELSE o_orderpriority END AS priority_kept,
          CASE o_orderpriority WHEN '1-URGENT' THEN 1 WHEN '2-HIGH' THEN 2 WHEN '3-MEDIUM' THEN 3
               WHEN '4-NOT SPECIFIED' THEN 4 ELSE 9 END AS priority_default,
          CASE o_orderstatus WHEN 'F' THEN 'closed' WHEN 'O' THEN 'running' WHEN 'P' THEN 'partial' END AS status
        FROM orders""",
    "dictionary_over_columns": """
        SELECT CASE l_returnflag WHEN 'R' THEN 'returned' WHEN 'N' THEN 'none' ELSE l_returnflag END AS l_returnflag,
               CASE l_linestatus WHEN 'O' THEN 'open' WHEN 'F' THEN 'filled' ELSE l_linestatus END AS l_linestatus,
               l_linenumber, count(*) AS n,
               CASE l_linenumber WHEN 1 THEN 'first' WHEN 2 THEN 'second' END AS l_linenumber_label
        FROM lineitem GROUP BY 1, 2, 3, 5""",
    "range_bands": """
        SELECT p_partkey, CASE WHEN p_size <= 5 THEN 'tiny' WHEN p_size <= 15 THEN 'small' WHEN p_size <= 30 THEN 'medium'
               WHEN p_size <= 45 THEN 'large' ELSE 'huge' END AS size_band
        FROM part""",
    "equal_width_bins": """
        SELECT 'year' AS kind, CASE WHEN y BETWEEN 1995 AND 1998 THEN '1995-1998'
               WHEN y BETWEEN 1999 AND 2001 THEN '1999-2000' END AS bin, count(*) AS n
        FROM (SELECT year(o_orderdate) AS y FROM orders) GROUP BY ALL
        UNION ALL
        SELECT 'size', CASE WHEN p_size BETWEEN 1 AND 5 THEN '1-5' WHEN p_size BETWEEN 6 AND 10 THEN '6-10'
               WHEN p_size BETWEEN 11 AND 15 THEN '11-15' WHEN p_size BETWEEN 16 AND 20 THEN '16-20'
               WHEN p_size BETWEEN 21 AND 25 THEN '21-25' WHEN p_size BETWEEN 26 AND 30 THEN '26-30'
               WHEN p_size BETWEEN 31 AND 35 THEN '31-35' WHEN p_size BETWEEN 36 AND 40 THEN '36-40'
               WHEN p_size BETWEEN 41 AND 45 THEN '41-45' WHEN p_size BETWEEN 46 AND 48 THEN '46-47' END, count(*)
        FROM part GROUP BY ALL""",
    "two_key_region": """
        WITH placed AS (
          SELECT c_nationkey % 5 AS area, c_nationkey AS part FROM customer),
        regions AS (
          SELECT area, CASE
            WHEN area NOT IN (0, 1, 2) THEN area::VARCHAR
            WHEN area = 0 AND part IN (0, 5) THEN 'north'
            WHEN area = 0 AND part IN (10, 15) THEN 'south'
            WHEN area = 1 AND part IN (1, 6, 11) THEN 'east'
            WHEN area = 2 AND part IN (2, 7) THEN 'west'
            WHEN area = 2 AND part IN (12) THEN 'far west' END AS region
          FROM placed)
        SELECT area, region, CASE WHEN area NOT IN (0, 1, 2) THEN 0 WHEN area = 1 THEN 1
               WHEN region IS NOT NULL AND region <> 'south' THEN 1 ELSE 0 END AS zone, count(*) AS n
        FROM regions GROUP BY ALL""",
    "two_digit_year": """
        WITH c AS (
          SELECT CASE WHEN o_custkey % 50 = 0 THEN '&&' WHEN o_custkey % 50 = 1 THEN '0-'
                 ELSE lpad((year(o_orderdate) % 100)::VARCHAR, 2, '0') END AS code FROM orders)
        SELECT code,
          CASE WHEN try_cast(code AS INT) > 42 THEN try_cast(code AS INT) + 1800 ELSE try_cast(code AS INT) + 1900 END AS year,
          CASE WHEN try_cast(code AS INT) > 96 THEN try_cast(code AS INT) + 1800 ELSE try_cast(code AS INT) + 1900 END AS arrival,
          count(*) AS n
        FROM c GROUP BY ALL""",
    "layered_class": f"""
        WITH {UNITS_SQL}
        SELECT CASE WHEN nation IN (1, 2, 3) AND segment = 'BUILDING' THEN 'home builder'
                    WHEN nation IN (1, 2, 3) THEN 'home other' WHEN o_orderstatus = 'P' THEN 'partial'
                    WHEN nation > 12 AND year < 1998 THEN 'abroad early' WHEN nation > 12 THEN 'abroad late'
                    ELSE 'rest' END AS class, year, count(*) AS n
        FROM units GROUP BY ALL""",
    "sentinel_to_null": """
        WITH c AS (
          SELECT nullif(year(o_orderdate)::INT, 2001) AS year,
                 CASE WHEN o_totalprice BETWEEN 400000 AND 450000 THEN NULL ELSE o_totalprice END AS p FROM orders)
        SELECT year, count(*) AS n, count(p) AS n_price,
               round(sum(CASE WHEN year = 1996 THEN p * 1.69::DOUBLE ELSE p END) + 0.000173, 2) AS total
        FROM c GROUP BY year""",
    "flags_and_growth": f"""
        WITH {YEARLY_SQL}
        SELECT id, round((spent_1997 - spent_1996) / nullif(spent_1996, 0) + 0.00000173, 4) AS growth,
          round((orders_1997 - (orders_1996 - 2))::DOUBLE / nullif(orders_1996 - 2, 0)::DOUBLE + 0.00000173, 4) AS growth_from_zero,
          round_even((orders_1996 + orders_1997) / 2.0::DOUBLE, 0)::INT AS middle,
          (status_1996 <> status_1997)::INT AS status_changed,
          CASE WHEN status_1996 IN ('P', 'O') THEN 1 ELSE 0 END AS open_1996,
          (spent_1996 IS NOT NULL AND spent_1997 IS NOT NULL) AS in_both,
          CASE WHEN orders_1996 > 1 THEN round(ln((orders_1996 - 1)::DOUBLE) + 0.00000173, 4) END AS log_orders,
          round(log10(spent_1997) + 0.00000173, 4) AS log10_spent, coalesce(orders_1996, 0) AS orders_filled,
          (1942 - orders_1997) AS age
        FROM wide""",
    "pad_and_compose_keys": """
        SELECT s_suppkey, lpad((s_nationkey * 10)::VARCHAR, 3, '0') AS state_code,
               lpad(s_suppkey::VARCHAR, 6, '0') AS county_code, s_nationkey AS state, NULL::INT AS bad,
               (s_nationkey::BIGINT * 10000 + s_suppkey) AS area_key, replace(s_name, '#', '') AS name
        FROM supplier""",
    "complete_units": f"""
        WITH {YEARLY_SQL}
        SELECT id, orders_1996, orders_1997, status_1996, priority_1997 FROM wide
        WHERE spent_1996 IS NOT NULL AND spent_1996 < 2000000 AND spent_1997 IS NOT NULL
          AND status_1996 IN ('F', 'O', 'P') AND priority_1997 <> '5-LOW' AND spent_1997 > 50000
          AND (orders_1997 = 1 OR orders_1997 > 2)""",
    "completeness_flags": f"""
        WITH {YEARLY_SQL}
        SELECT status_1996, count(*) FILTER (spent_1996 IS NOT NULL AND spent_1997 IS NOT NULL) AS known_spent,
               count(*) FILTER (status_1996 = status_1997) AS same_status,
               count(*) FILTER (priority_1996 = priority_1997) AS same_priority
        FROM wide GROUP BY status_1996""",
    "text_filter": """
        SELECT doc_id, source, n_chars FROM documents
        WHERE lang = 'en' AND source <> '' AND NOT contains(text, '|') AND regexp_matches(text, '(?i)\\bthe\\b')""",
    "first_of_duplicates": """
        SELECT doc_id, lang, source, n_chars FROM documents
        WHERE doc_id IN (SELECT min(doc_id) FROM documents GROUP BY lang, text)""",
    "id_quality": """
        WITH i AS (
          SELECT CASE c_custkey % 40 WHEN 0 THEN NULL WHEN 1 THEN ' ' || c_name WHEN 2 THEN '' ELSE c_name END AS id
          FROM customer)
        SELECT count(*) AS total, count(*) FILTER (id IS NULL) AS n_null, count(*) FILTER (id <> trim(id)) AS n_padded,
               count(*) FILTER (id = '') AS n_empty
        FROM i""",
    "projection_variants": """
        SELECT p_partkey AS "key", p_size AS size, round(p_retailprice + 0.000173, 2) AS price, p_brand AS brand FROM part""",
    "across_columns": """
        SELECT l_returnflag, round(sum(l_quantity) + 0.000173, 2) AS "total_l_quantity", max(l_quantity) AS "most_l_quantity",
               round(sum(l_tax) + 0.000173, 2) AS "total_l_tax", max(l_tax) AS "most_l_tax"
        FROM lineitem GROUP BY l_returnflag""",
    "distinct_codes": "SELECT DISTINCT p_brand FROM part",
    "exact_sample": "SELECT * FROM part ORDER BY md5('7:' || p_partkey), p_partkey LIMIT 100",
}
