"""Queries for recodes of the register and census rules, raw lines, random tables, and key-set combinations."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellwright.catalog.base import rounded, table
from cellwright.functions.recode import map_codes
from cellwright.functions.rules import age_cohort, birth_country_of_code, exposure_group, race_class, region_rows, west_coast
from cellwright.operators.cells import flagged_propensity, propensity_lattice
from cellwright.plans.areas import area_table, region_table
from cellwright.rules import census, regions
from cellwright.rules import register as codes
from cellwright.session import scratch_path
from cellwright.sources.fixed_width import peek_lines
from cellwright.sources.tables import random_table

SIX = ["year", "month", "priority", "status", "nation", "segment"]


def marital_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes of sex and marital status as cards hold them, one for every customer."""
    code = F.element_at(F.array(*[F.lit(c) for c in CARD_CODES]), (F.col("c_custkey") % len(CARD_CODES) + 1).cast("int"))
    people = table(spark, sf_dir, "customer").select("c_custkey", code.alias("code"))
    return people.select("c_custkey", map_codes(F.col("code"), codes.MARITAL_OF_CODE).alias("marst"), map_codes(F.col("code"), codes.SEX_OF_CODE).alias("sex"))


def age_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """People by band of age, band and sex-like class counted together."""
    year = (F.col("c_custkey") % 80 + 1865).cast("int")
    people = table(spark, sf_dir, "customer").select(age_cohort(year).alias("cohort"), "c_mktsegment")
    return people.groupBy("cohort", "c_mktsegment").agg(F.count("*").alias("n"))


def code_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Race class, coast flag and country of birth of codes."""
    key = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select(
        "c_custkey",
        race_class((key % 7).cast("int")).alias("race"),
        west_coast((key % 60).cast("int")).alias("coast"),
        birth_country_of_code((key % 600).cast("int")).alias("country"),
    )


def exposure_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Comparison groups from a race label and a propensity: orders by class, with a discount as propensity."""
    label = F.when(F.col("l_linenumber") == 1, "Chinese").when(F.col("l_linenumber") < 5, "Japanese").when(F.col("l_linenumber") < 7, "White")
    rows = table(spark, sf_dir, "lineitem").select(exposure_group(label, F.when(F.col("l_tax") > 0, F.col("l_discount") * 10), 0.0, 0.75).alias("grp"), "l_quantity")
    return rows.groupBy("grp").agg(F.count("*").alias("n"), F.sum("l_quantity").alias("quantity"))


def raw_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first raw lines of a text file of regions, in one part so that their order is that of the file."""
    path = scratch_path(spark, "lines")
    rows = table(spark, sf_dir, "nation").orderBy("n_nationkey").select(F.concat_ws("|", "n_nationkey", "n_name"))
    rows.coalesce(1).write.text(path)
    return peek_lines(spark, path, 7)


def random_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A random test table as long as ``customer``; what must hold of it is told by bounds."""
    n = table(spark, sf_dir, "customer").count()
    found = random_table(spark, n, 3, 5)
    return found.agg(
        F.count("*").alias("n"),
        F.count_distinct("id").alias("ids"),
        F.count_distinct("g").alias("groups"),
        (F.abs(F.avg("x")) < 6 / F.sqrt(F.count("*"))).alias("centred"),
        (F.abs(F.stddev_samp("x") - 1) < 6 / F.sqrt(F.count("*"))).alias("unit_spread"),
        (F.bool_and(F.bround("x", 2) == F.col("x"))).alias("two_digits"),
    )


def area_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as people: customers live in six states and 130 counties, dear orders are the treated."""
    key = F.col("c_custkey")
    state = F.element_at(F.array(*[F.lit(s) for s in AREA_STATES]), (key % len(AREA_STATES) + 1).cast("int"))
    people = table(spark, sf_dir, "customer").select(
        key.alias("o_custkey"), state.alias("STATEFIP"), F.when(key % 31 != 0, ((key * 7) % 130 * 10).cast("int")).alias("COUNTYICP"), (key % 8).cast("int").alias("RACE")
    )
    orders = table(spark, sf_dir, "orders").select("o_custkey", (F.col("o_totalprice") > 150000).alias("dear"))
    return flagged_propensity(orders.join(people, "o_custkey"), ["STATEFIP", "COUNTYICP", "RACE"], F.col("dear"))


def area_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Areas with their classes, shares, region and zone by the rules of the four western states."""
    return rounded(area_table(area_cells(spark, sf_dir)), ["share_tot", "share_japn"], 6)


def area_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(region_table(area_table(area_cells(spark, sf_dir))), ["share_tot", "share_japn", "zone"], 6)


def key_combinations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Propensities under all pairs and triples of six keys, 35 sets."""
    orders = table(spark, sf_dir, "orders").select(
        "o_custkey",
        F.year("o_orderdate").alias("year"),
        F.month("o_orderdate").alias("month"),
        F.col("o_orderpriority").alias("priority"),
        F.nullif("o_orderstatus", F.lit("P")).alias("status"),
        (F.col("o_totalprice") > 150000).alias("dear"),
    )
    people = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), F.nullif("c_nationkey", F.lit(0)).alias("nation"), F.col("c_mktsegment").alias("segment"))
    cells = flagged_propensity(orders.join(people, "o_custkey"), SIX, F.col("dear"))
    sets = {"+".join(keys): list(keys) for k in (2, 3) for keys in combinations(SIX, k)}
    return propensity_lattice(cells, sets).drop("propensity")


AREA_STATES = [4, 6, 32, 41, 49, 53]
CARD_CODES = sorted({*codes.MARITAL_OF_CODE, *codes.SEX_OF_CODE, "?"})
QUERIES = {
    "marital_status": marital_status,
    "age_bands": age_bands,
    "code_classes": code_classes,
    "exposure_groups": exposure_groups,
    "raw_lines": raw_lines,
    "random_rows": random_rows,
    "key_combinations": key_combinations,
    "area_tags": area_tags,
    "area_regions": area_regions,
}


def _text(value: object) -> str:
    return "'" + str(value).replace("'", "''") + "'"


def _case(column: str, mapping: dict) -> str:
    whens = " ".join(f"WHEN {column} = {_text(k)} THEN {v if isinstance(v, int) else _text(v)}" for k, v in mapping.items())
    return f"CASE {whens} END"


_COHORTS = " ".join(f"WHEN b {f'BETWEEN {low} AND {high}' if low is not None else f'<= {high}'} THEN {_text(label)}" for low, high, label in census.AGE_COHORTS)
_SETS = ", ".join(f"({', '.join(keys)})" for k in (2, 3) for keys in combinations(SIX, k))
_NAMES = " ".join(
    f"WHEN {' AND '.join(f'grouping({c}) = {int(c not in keys)}' for c in SIX)} THEN '{'+'.join(keys)}'" for k in (2, 3) for keys in combinations(SIX, k)
)
_RULES = ", ".join(f"({state}, {county}, {_text(region)})" for state, county, region in region_rows(regions.REGIONS)[0])
_STATES = ", ".join(map(str, regions.WEST_COAST_STATES))
_AREAS = f"""
    rules(s, c, r) AS (VALUES {_RULES}),
    people AS (SELECT c_custkey, ([{", ".join(map(str, AREA_STATES))}])[(c_custkey % {len(AREA_STATES)} + 1)::INT] AS "STATEFIP",
                      CASE WHEN c_custkey % 31 <> 0 THEN (c_custkey * 7) % 130 * 10 END::INT AS "COUNTYICP", c_custkey % 8 AS race FROM customer),
    sums AS (SELECT "STATEFIP", "COUNTYICP", count(*) FILTER (race = 5)::BIGINT AS pop_japn, count(*) FILTER (race = 4)::BIGINT AS pop_chin,
                    count(*) FILTER (race NOT IN (4, 5))::BIGINT AS pop_other, count(*)::BIGINT AS pop_tot, count(*) FILTER (o_totalprice > 150000)::BIGINT AS treated
             FROM orders JOIN people ON o_custkey = c_custkey GROUP BY ALL),
    placed AS (SELECT sums.*, CASE WHEN "STATEFIP" IN ({_STATES}) THEN r ELSE "STATEFIP"::VARCHAR END AS region FROM sums LEFT JOIN rules ON s = "STATEFIP" AND c = "COUNTYICP"),
    areas AS (SELECT *, CASE WHEN "STATEFIP" NOT IN ({_STATES}) THEN 0 WHEN "STATEFIP" IN ({", ".join(map(str, regions.WHOLE_STATE_IN_ZONE))}) THEN 1
                             WHEN region IS NOT NULL AND region NOT IN ({", ".join(map(_text, regions.OUTSIDE_ZONE))}) THEN 1 ELSE 0 END::INT AS zone FROM placed)"""
_SHARES = "round(treated / nullif(pop_tot, 0)::DOUBLE + 0.0000000173, 6) AS share_tot, round(treated / nullif(pop_japn, 0)::DOUBLE + 0.0000000173, 6) AS share_japn"
ORACLE = {
    "area_tags": f"WITH {_AREAS} SELECT *, {_SHARES} FROM areas",
    "area_regions": f"""
        WITH {_AREAS},
        rolled AS (SELECT region, sum(pop_tot)::BIGINT AS pop_tot, sum(pop_japn)::BIGINT AS pop_japn, sum(pop_chin)::BIGINT AS pop_chin,
                          sum(pop_other)::BIGINT AS pop_other, sum(treated)::BIGINT AS treated, round(avg(zone) + 0.0000000173, 6) AS zone FROM areas GROUP BY region)
        SELECT *, {_SHARES} FROM rolled""",
    "marital_status": f"""
        WITH c AS (SELECT c_custkey, ([{", ".join(map(_text, CARD_CODES))}])[(c_custkey % {len(CARD_CODES)} + 1)::INT] AS code FROM customer)
        SELECT c_custkey, {_case("code", codes.MARITAL_OF_CODE)} AS marst, {_case("code", codes.SEX_OF_CODE)} AS sex FROM c""",
    "age_bands": f"""
        SELECT CASE {_COHORTS} END AS cohort, c_mktsegment, count(*) AS n
        FROM (SELECT c_custkey % 80 + 1865 AS b, c_mktsegment FROM customer) GROUP BY ALL""",
    "code_classes": f"""
        SELECT c_custkey, CASE c_custkey % 7 WHEN 5 THEN 'japn' WHEN 4 THEN 'chin' ELSE 'other' END AS race,
               CASE WHEN c_custkey % 60 IN ({", ".join(map(str, regions.WEST_COAST_STATES))}) THEN 'West Coast' ELSE 'Other' END AS coast,
               CASE WHEN c_custkey % 600 BETWEEN 1 AND 99 THEN 'USA' WHEN c_custkey % 600 = 501 THEN 'Japan' ELSE 'Other' END AS country
        FROM customer""",
    "exposure_groups": """
        WITH r AS (SELECT CASE WHEN l_linenumber = 1 THEN 'Chinese' WHEN l_linenumber < 5 THEN 'Japanese' WHEN l_linenumber < 7 THEN 'White' END AS race,
                          CASE WHEN l_tax > 0 THEN l_discount * 10 END AS p, l_quantity FROM lineitem)
        SELECT CASE WHEN race = 'Chinese' THEN 'Chinese' WHEN race = 'Japanese' AND p = 0 THEN 'Unexposed' WHEN race = 'Japanese' AND p > 0.75 THEN 'Exposed'
                    WHEN race = 'Japanese' AND p BETWEEN 0 AND 0.75 THEN '(Dropped)' END AS grp, count(*) AS n, sum(l_quantity) AS quantity
        FROM r GROUP BY ALL""",
    "raw_lines": "SELECT n_nationkey || '|' || n_name AS value FROM nation ORDER BY n_nationkey LIMIT 7",
    "random_rows": """
        SELECT count(*) AS n, count(*) AS ids, 3::BIGINT AS "groups", true AS centred, true AS unit_spread, true AS two_digits FROM customer""",
    "key_combinations": f"""
        WITH o AS (SELECT year(o_orderdate)::INT AS year, month(o_orderdate)::INT AS month, o_orderpriority AS priority, nullif(o_orderstatus, 'P') AS status,
                          nullif(c_nationkey, 0) AS nation, c_mktsegment AS segment, o_totalprice > 150000 AS dear FROM orders JOIN customer ON o_custkey = c_custkey)
        SELECT CASE {_NAMES} END AS key_set, {", ".join(SIX)}, count(*) FILTER (dear)::BIGINT AS n_treated, count(*)::BIGINT AS n_population
        FROM o GROUP BY GROUPING SETS ({_SETS})""",
}
