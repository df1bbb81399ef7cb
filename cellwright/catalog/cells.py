"""Queries for cell counts, propensities and areas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellwright.catalog.base import (
    CELL_KEYS,
    CELLS_SQL,
    UNITS_SQL,
    near,
    order_cells,
    order_cells_two_sources,
    order_units,
    rounded,
    table,
)
from cellwright.functions.numeric import count_where, ratio
from cellwright.functions.recode import equal_width_bin, first_match
from cellwright.operators.cells import (
    area_demographics,
    area_income,
    attach_key_sets,
    attach_propensity,
    cell_counts,
    index_bands,
    propensity_key_sets,
    ranked_index,
    roll_up,
)
from cellwright.operators.joins import lookup_join, null_safe_join
from cellwright.operators.order import number_rows
from cellwright.operators.population import population_summary
from cellwright.session import cut

KEY_SETS = {
    "by_nation": ["nation"],
    "by_nation_segment": ["nation", "segment"],
    "by_segment_year": ["segment", "year"],
    "full": ["nation", "segment", "year"],
}


def year_pair():
    """Two-year bins stand in for the year of a cell."""
    return {"year": ("year_bin", equal_width_bin(F.col("year"), 1995, 2000, 2))}


def segment_class():
    return first_match([(F.col("segment") == "BUILDING", "build"), (F.col("segment") == "MACHINERY", "mach")], "other")


def cell_counts_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cell_counts(order_units(spark, sf_dir), CELL_KEYS, F.col("year") < 2001)


def cell_propensity_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(order_cells_two_sources(spark, sf_dir), ["prop"], 6)


def cell_propensity_flagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(order_cells(spark, sf_dir), ["prop"], 6)


def cell_full_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Full outer join of two tables of cell statistics in which a missing key matches a missing key."""
    units = order_units(spark, sf_dir, ["o_totalprice", "o_orderpriority"])
    urgent = units.where(F.col("o_orderpriority") == "1-URGENT").where(F.col("year") > 1995)
    low = units.where(F.col("o_orderpriority") == "5-LOW").where(F.col("year") < 2000)
    keys = ["nation", "year"]
    a = urgent.groupBy(*keys).agg(F.count("*").alias("n"), near(F.avg("o_totalprice")).alias("mean_urgent"))
    b = low.groupBy(*keys).agg(F.count("*").alias("n"), near(F.avg("o_totalprice")).alias("mean_low"))
    return null_safe_join(a, b, keys, "full", ("_urgent", "_low"))


def propensity_attach(spark: SparkSession, sf_dir: str) -> DataFrame:
    units = order_units(spark, sf_dir).select("o_orderkey", *CELL_KEYS)
    attached = attach_propensity(units, order_cells(spark, sf_dir), CELL_KEYS, year_pair(), threshold=0.75)
    return rounded(attached, ["propensity"], 6).select("o_orderkey", "year_bin", "propensity", "exposed")


def propensity_flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From rows to cells to propensity and back to the units, summarised by class."""
    units = order_units(spark, sf_dir)
    attached = attach_propensity(units, cut(order_cells(spark, sf_dir), "cells"), CELL_KEYS, threshold=0.75)
    summary = attached.groupBy("segment", "exposed").agg(
        F.count("*").alias("n"),
        count_where(F.col("year") >= 1998).alias("n_late"),
        near(F.avg("propensity"), 6).alias("mean_propensity"),
    )
    return summary


def propensity_grouping_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(propensity_key_sets(order_cells(spark, sf_dir), KEY_SETS), ["propensity"], 6)


def propensity_side_by_side(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every unit with its propensity under each key set."""
    units = order_units(spark, sf_dir).select("o_orderkey", *CELL_KEYS)
    attached = attach_key_sets(units, order_cells(spark, sf_dir), KEY_SETS)
    return rounded(attached, list(KEY_SETS), 6).drop(*CELL_KEYS)


def demographics(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = order_cells(spark, sf_dir)
    return area_demographics(cells, ["nation"], segment_class(), ["build", "mach", "other"], share_of="build")


def area_demographics_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(demographics(spark, sf_dir), ["share_tot", "share_build"], 6)


def region_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    nations = table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey")
    areas = lookup_join(demographics(spark, sf_dir), nations, {"nation": "n_nationkey"})
    areas = areas.withColumn("zone", (F.col("nation") % 2).cast("int"))
    sums = ["pop_tot", "pop_build", "treated"]
    shares = {"share_tot": ("treated", "pop_tot"), "share_build": ("treated", "pop_build")}
    rolled = roll_up(areas, ["n_regionkey"], sums, "zone", shares)
    return rounded(rolled, ["zone", "share_tot", "share_build"], 6)


def area_income_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    units = order_units(spark, sf_dir, ["o_totalprice"])
    sentinels = [("o_totalprice", 400000, 450000)]
    income = area_income(units, ["year", "nation"], ["o_totalprice"], "year", 1996, 1.69, sentinels)
    return rounded(rounded(income, ["total_o_totalprice"], 2), ["mean_o_totalprice"])


def ranked_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    grouped = ranked_index(order_cells(spark, sf_dir), ["nation", "segment"])
    # The weighted mean of the cells' shares is the share of the sums, which is the same in any order of summing.
    grouped = grouped.withColumn("index", ratio(F.col("n_treated"), F.col("n_population")))
    order = [F.desc_nulls_last("index"), F.asc_nulls_last("nation"), F.asc_nulls_last("segment")]
    ranked = number_rows(grouped.where(F.col("index") > 0), order, "rank")
    return rounded(index_bands(cut(ranked, "ranked"), "rank", 10, (0.70, 0.73)), ["index"], 6)


def population_summary_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    units = order_units(spark, sf_dir, ["o_totalprice", "o_orderstatus", "o_orderpriority"])
    units = units.withColumns(
        {
            "price": F.when(~F.col("o_totalprice").between(400000, 450000), F.col("o_totalprice")),
            "rank": F.substring("o_orderpriority", 1, 1).cast("int"),
        }
    )
    conditions = {
        "filled": F.col("o_orderstatus") == "F",
        "open": F.col("o_orderstatus") == "O",
        "urgent": F.col("o_orderpriority") == "1-URGENT",
    }
    cells = cut(order_cells(spark, sf_dir), "cells")
    summary = population_summary(
        units, cells, CELL_KEYS, ["segment"], conditions, ["price", "rank"], ["price", "nation"], year_pair(), 0.74
    )
    return rounded(rounded(summary, ["filled", "open", "urgent", "mean_rank", "var_rank"], 6), ["mean_price", "var_price"], 2)


QUERIES = {
    "propensity_flagship": propensity_flagship,
    "cell_counts": cell_counts_query,
    "cell_propensity": cell_propensity_query,
    "cell_propensity_flagged": cell_propensity_flagged,
    "cell_full_join": cell_full_join,
    "propensity_attach": propensity_attach,
    "propensity_grouping_sets": propensity_grouping_sets,
    "propensity_side_by_side": propensity_side_by_side,
    "area_demographics": area_demographics_query,
    "region_rollup": region_rollup,
    "area_income": area_income_query,
    "ranked_cells": ranked_cells,
    "population_summary": population_summary_query,
}

YEAR_BIN = """CASE WHEN year BETWEEN 1995 AND 1996 THEN '1995-1996' WHEN year BETWEEN 1997 AND 1998 THEN '1997-1998'
                   WHEN year BETWEEN 1999 AND 2001 THEN '1999-2000' END"""
AREAS_SQL = (
    CELLS_SQL
    + """,
areas AS (
  SELECT nation, coalesce(sum(n_population) FILTER (segment = 'BUILDING'), 0)::BIGINT AS pop_build,
         coalesce(sum(n_population) FILTER (segment = 'MACHINERY'), 0)::BIGINT AS pop_mach,
         coalesce(sum(n_population) FILTER (segment NOT IN ('BUILDING', 'MACHINERY')), 0)::BIGINT AS pop_other,
         sum(n_population)::BIGINT AS pop_tot, sum(n_treated)::BIGINT AS treated
  FROM cells GROUP BY nation)"""
)
COARSE_SQL = (
    CELLS_SQL
    + f""",
coarse AS (
  SELECT nation, segment, {YEAR_BIN} AS year_bin, sum(n_treated)::DOUBLE / nullif(sum(n_population), 0)::DOUBLE AS propensity
  FROM cells GROUP BY ALL)"""
)

ORACLE = {
    "propensity_flagship": f"""
        WITH {CELLS_SQL},
        p AS (SELECT *, n_treated::DOUBLE / nullif(n_population, 0)::DOUBLE AS propensity FROM cells)
        SELECT u.segment, p.propensity > 0.75 AS exposed, count(*) AS n, count(*) FILTER (u.year >= 1998) AS n_late,
               round(avg(p.propensity) + 0.0000000173, 6) AS mean_propensity
        FROM units u LEFT JOIN p ON u.nation IS NOT DISTINCT FROM p.nation AND u.segment = p.segment AND u.year = p.year
        GROUP BY 1, 2""",
    "cell_counts": f"""
        WITH {UNITS_SQL}
        SELECT nation, segment, year, count(*) AS n FROM units WHERE year < 2001 GROUP BY ALL""",
    "cell_propensity": f"""
        WITH {CELLS_SQL}
        SELECT nation, segment, year, n_treated, n_population,
               round(n_treated::DOUBLE / nullif(n_population, 0)::DOUBLE + 0.0000000173, 6) AS prop, n_population = 0 AS no_population
        FROM cells""",
    "cell_propensity_flagged": f"""
        WITH {CELLS_SQL}
        SELECT nation, segment, year, n_treated, n_population,
               round(n_treated::DOUBLE / nullif(n_population, 0)::DOUBLE + 0.0000000173, 6) AS prop, n_population = 0 AS no_population
        FROM cells""",
    "cell_full_join": f"""
        WITH {UNITS_SQL},
        a AS (SELECT nation, year, count(*) AS n, round(avg(o_totalprice) + 0.00000173, 4) AS m FROM units
              WHERE o_orderpriority = '1-URGENT' AND year > 1995 GROUP BY ALL),
        b AS (SELECT nation, year, count(*) AS n, round(avg(o_totalprice) + 0.00000173, 4) AS m FROM units
              WHERE o_orderpriority = '5-LOW' AND year < 2000 GROUP BY ALL)
        SELECT coalesce(a.nation, b.nation) AS nation, coalesce(a.year, b.year) AS year, a.n AS n_urgent,
               a.m AS mean_urgent, b.n AS n_low, b.m AS mean_low
        FROM a FULL JOIN b ON a.nation IS NOT DISTINCT FROM b.nation AND a.year IS NOT DISTINCT FROM b.year""",
    "propensity_attach": f"""
        WITH {COARSE_SQL}
        SELECT o_orderkey, year_bin, round(propensity + 0.0000000173, 6) AS propensity, propensity > 0.75 AS exposed
        FROM (SELECT *, {YEAR_BIN} AS yb FROM units) u LEFT JOIN coarse c
          ON u.nation IS NOT DISTINCT FROM c.nation AND u.segment IS NOT DISTINCT FROM c.segment
         AND u.yb IS NOT DISTINCT FROM c.year_bin""",
    "propensity_grouping_sets": f"""
        WITH {CELLS_SQL}
        SELECT CASE grouping(nation, segment, year) WHEN 3 THEN 'by_nation' WHEN 1 THEN 'by_nation_segment'
               WHEN 4 THEN 'by_segment_year' ELSE 'full' END AS key_set,
               nation, segment, year, sum(n_treated)::BIGINT AS n_treated, sum(n_population)::BIGINT AS n_population,
               round(sum(n_treated)::DOUBLE / nullif(sum(n_population), 0)::DOUBLE + 0.0000000173, 6) AS propensity
        FROM cells
        GROUP BY GROUPING SETS ((nation), (nation, segment), (segment, year), (nation, segment, year))""",
    "propensity_side_by_side": f"""
        WITH {CELLS_SQL},
        c1 AS (SELECT nation, sum(n_treated)::DOUBLE / sum(n_population)::DOUBLE AS p FROM cells GROUP BY ALL),
        c2 AS (SELECT nation, segment, sum(n_treated)::DOUBLE / sum(n_population)::DOUBLE AS p FROM cells GROUP BY ALL),
        c3 AS (SELECT segment, year, sum(n_treated)::DOUBLE / sum(n_population)::DOUBLE AS p FROM cells GROUP BY ALL),
        c4 AS (SELECT nation, segment, year, sum(n_treated)::DOUBLE / sum(n_population)::DOUBLE AS p FROM cells GROUP BY ALL)
        SELECT o_orderkey, round(c1.p + 0.0000000173, 6) AS by_nation, round(c2.p + 0.0000000173, 6) AS by_nation_segment,
               round(c3.p + 0.0000000173, 6) AS by_segment_year, round(c4.p + 0.0000000173, 6) AS "full"
        FROM units u
        LEFT JOIN c1 ON u.nation IS NOT DISTINCT FROM c1.nation
        LEFT JOIN c2 ON u.nation IS NOT DISTINCT FROM c2.nation AND u.segment = c2.segment
        LEFT JOIN c3 ON u.segment = c3.segment AND u.year = c3.year
        LEFT JOIN c4 ON u.nation IS NOT DISTINCT FROM c4.nation AND u.segment = c4.segment AND u.year = c4.year""",
    "area_demographics": f"""
        WITH {AREAS_SQL}
        SELECT *, round(treated::DOUBLE / nullif(pop_tot, 0)::DOUBLE + 0.0000000173, 6) AS share_tot,
               round(treated::DOUBLE / nullif(pop_build, 0)::DOUBLE + 0.0000000173, 6) AS share_build
        FROM areas""",
    "region_rollup": f"""
        WITH {AREAS_SQL}
        SELECT n_regionkey, sum(pop_tot)::BIGINT AS pop_tot, sum(pop_build)::BIGINT AS pop_build,
               sum(treated)::BIGINT AS treated, round(avg((nation % 2)::DOUBLE) + 0.0000000173, 6) AS zone,
               round(sum(treated)::DOUBLE / nullif(sum(pop_tot), 0)::DOUBLE + 0.0000000173, 6) AS share_tot,
               round(sum(treated)::DOUBLE / nullif(sum(pop_build), 0)::DOUBLE + 0.0000000173, 6) AS share_build
        FROM areas LEFT JOIN nation ON areas.nation = n_nationkey GROUP BY n_regionkey""",
    "area_income": f"""
        WITH {UNITS_SQL},
        v AS (SELECT year, nation, CASE WHEN o_totalprice BETWEEN 400000 AND 450000 THEN NULL WHEN year = 1996
                     THEN o_totalprice * 1.69::DOUBLE ELSE o_totalprice END AS p FROM units)
        SELECT year, nation, round(coalesce(sum(p), 0) + 0.000173, 2) AS "total_o_totalprice", count(p) AS "nwith_o_totalprice",
               round(sum(p) / nullif(count(p), 0)::DOUBLE + 0.00000173, 4) AS "mean_o_totalprice"
        FROM v GROUP BY year, nation""",
    "ranked_cells": f"""
        WITH {CELLS_SQL},
        g AS (SELECT nation, segment,
                     sum(n_treated)::DOUBLE / sum(n_population)::DOUBLE AS "index",
                     sum(n_population)::BIGINT AS n_population, sum(n_treated)::BIGINT AS n_treated
              FROM cells WHERE n_population > 0 GROUP BY nation, segment),
        r AS (SELECT *, row_number() OVER (ORDER BY "index" DESC NULLS LAST, nation NULLS LAST, segment NULLS LAST) AS rank
              FROM g WHERE "index" > 0)
        SELECT * REPLACE (round("index" + 0.0000000173, 6) AS "index") FROM (
          SELECT *, 'top' AS band FROM (SELECT * FROM r ORDER BY rank LIMIT 10)
          UNION ALL SELECT *, 'middle' FROM r WHERE "index" > 0.70 AND "index" < 0.73
          UNION ALL SELECT *, 'bottom' FROM (SELECT * FROM r ORDER BY rank DESC LIMIT 10))""",
    "population_summary": f"""
        WITH {COARSE_SQL}
        SELECT u.segment, c.propensity > 0.74 AS exposed, count(*) AS n,
               round(avg((o_orderstatus = 'F')::INT::DOUBLE) + 0.0000000173, 6) AS filled, round(avg((o_orderstatus = 'O')::INT::DOUBLE) + 0.0000000173, 6) AS "open",
               round(avg((o_orderpriority = '1-URGENT')::INT::DOUBLE) + 0.0000000173, 6) AS urgent,
               round(avg(o_totalprice) + 0.000173, 2) AS mean_price, round(var_samp(o_totalprice) + 0.000173, 2) AS var_price,
               round(avg(left(o_orderpriority, 1)::INT::DOUBLE) + 0.0000000173, 6) AS mean_rank,
               round(var_samp(left(o_orderpriority, 1)::INT::DOUBLE) + 0.0000000173, 6) AS var_rank
        FROM (SELECT *, {YEAR_BIN} AS yb FROM units) u LEFT JOIN coarse c
          ON u.nation IS NOT DISTINCT FROM c.nation AND u.segment IS NOT DISTINCT FROM c.segment
         AND u.yb IS NOT DISTINCT FROM c.year_bin
        WHERE o_totalprice NOT BETWEEN 400000 AND 450000 AND u.nation IS NOT NULL
        GROUP BY 1, 2""",
}
