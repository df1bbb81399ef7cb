"""Queries that run the register and the panel from end to end on records derived from the orders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cellwright.catalog.base import rounded, table
from cellwright.functions.recode import groups_to_mapping
from cellwright.operators.cells import cell_counts, cell_propensity
from cellwright.operators.joins import lookup_join
from cellwright.plans import panel, register
from cellwright.rules import census
from cellwright.rules import register as codes
from cellwright.session import cut
from cellwright.sources.fixed_width import fixed_width_line

# One-character codes dealt out to the records in turn; each list holds some that no dictionary knows.
DEALT = {
    "camp": "0123456789DIRX",
    "assembly": "-0123456789ABCDEFZ?",
    "brth_cntry_pnts": "WAJSXB147CK258LT369UYDMVZ",
    "school_jap": "&0123456789ABCDEFG",
    "high_educ": "ABCDEFGHIJKLMNOPQR123-",
    "sex_marrge": "0123456789-&ACF",
    "race_raw": "12345678JKLMOSTVWX ",
    "educ": "JSKTLUMVNWOXPYQZFAGBHCIDE15263748_9.",
}
PLACES = [code for code, _, _ in codes.BIRTHPLACES] + ["4E"]


def dealt(name: str) -> Column:
    chars = DEALT[name]
    return F.expr(f"substring('{chars}', cast(o_orderkey % {len(chars)} as int) + 1, 1)")


def card_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One card per order, stored; several orders of a customer with one status repeat a card's id and names."""
    key, customer = F.col("o_orderkey"), F.col("o_custkey")
    place = F.element_at(F.array(*[F.lit(p) for p in PLACES]), (key % len(PLACES)).cast("int") + 1)
    values = {
        "last_name": F.when(customer % 50 == 0, "O\\NE").otherwise(F.concat(F.lit("N"), customer % 7)),
        "first_name": F.concat(F.lit("F"), customer % 3),
        "ind_number": F.when(customer % 90 != 0, F.lpad((customer % 1_000_000).cast("string"), 6, "0")),
        "file_no": F.col("o_orderstatus"),
        "prev_address": F.lpad((customer % 30 * 37).cast("string"), 5, "0"),
        "arrival_us": F.when(key % 103 < 100, F.lpad((key % 103).cast("string"), 2, "0")).otherwise("--"),
        "birth_yr": F.when(key % 101 < 100, F.lpad((key % 101).cast("string"), 2, "0")).otherwise("&&"),
        "birthplace": place,
        **{name: dealt(name) for name in DEALT},
    }
    line = fixed_width_line([(values.get(name, F.lit("")), width) for name, width in codes.CARD_WIDTHS])
    return cut(table(spark, sf_dir, "orders").select(key.alias("card_order"), line.alias("value")), "cards")


def addresses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "nation").select(
        F.lpad((F.col("n_nationkey") * 37).cast("string"), 5, "0").alias("prev_address"),
        F.col("n_name").alias("state"),
        F.concat(F.lit("county "), F.col("n_nationkey")).alias("county"),
        F.lit(None).cast("string").alias("city"),
        F.lpad((F.col("n_nationkey") * 10).cast("string"), 3, "0").alias("NHGISST"),
        F.lit("0010").alias("NHGISCTY"),
        F.col("n_nationkey").cast("double").alias("ICPSRFIP"),
        F.col("n_nationkey").alias("STATEFIP"),
        (F.col("n_regionkey") * 10).alias("COUNTYICP"),
    )


REGISTER_OUTPUT = [
    "ind_number", "camp", "assembly", "RACE", "SEX", "BIRTHYR", "BPL", "birthplace", "bpl_pop", "bpl_mom", "YRIMMIG",
    "NATIVITY", "generation", "DEGFIELD", "high_deg", "EDUC", "school_jap", "bpl_grp", "byr_grp", "state", "STATEFIP",
    "COUNTYICP", "last_name",
]


def register_compile(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = card_lines(spark, sf_dir)
    return register.compile_register(lines, addresses(spark, sf_dir)).select(*REGISTER_OUTPUT)


def register_cell_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = card_lines(spark, sf_dir)
    return register.register_cells(register.compile_register(lines, addresses(spark, sf_dir)))


def panel_people(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Person rows of two census years from the customers' orders of two years."""
    orders = table(spark, sf_dir, "orders").where(F.year("o_orderdate").isin(1996, 1997))
    yearly = orders.groupBy("o_custkey", F.year("o_orderdate").alias("y")).agg(
        F.sum("o_totalprice").alias("spent"), F.max("o_orderkey").alias("last_order")
    )
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    joined = lookup_join(yearly, customers, {"o_custkey": "c_custkey"}, "inner", null_safe=False)
    unit, last, late = F.col("o_custkey"), F.col("last_order"), F.col("y") == 1997
    return joined.select(
        unit.cast("string").alias("HIK"),
        F.when(late, 1950).otherwise(1940).alias("YEAR"),
        F.nullif((F.col("c_nationkey") + F.when(late & (unit % 6 == 0), 1).otherwise(0)).cast("int"), F.lit(0)).alias("STATEFIP"),
        (unit % 4 * 10 + F.when(late & (unit % 5 == 0), 10).otherwise(0)).cast("int").alias("COUNTYICP"),
        F.when(late & (unit % 11 == 0), 1).otherwise(4 + unit % 2).cast("int").alias("RACE"),
        (1 + unit % 2).cast("int").alias("SEX"),
        (1870 + unit % 60 + F.when(late & (unit % 3 == 0), 1).otherwise(0)).cast("int").alias("BIRTHYR"),
        F.element_at(F.array(*[F.lit(b) for b in (6, 53, 15, 501, 36, 99, 150)]), (unit % 7).cast("int") + 1).alias("BPL"),
        F.when(last % 9 != 0, F.round(F.col("spent") / 1000)).alias("INCWAGE"),
        F.when(last % 10 != 0, last % 980).cast("int").alias("OCC1950"),
        (1 + last % 3).cast("int").alias("EMPSTAT"),
        (last % 3).cast("int").alias("CLASSWKR"),
    )


def panel_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query, wide cleaning, named propensities, long cleaning and the complete, consistent sample."""
    people = cut(panel_people(spark, sf_dir), "people")
    first = people.where(F.col("YEAR") == 1940)
    treated = first.where(F.col("OCC1950") % 3 == 0)
    cells = cell_propensity(cell_counts(treated, census.CELL_KEYS), cell_counts(first, census.CELL_KEYS), census.CELL_KEYS)
    wide = panel.clean_wide(panel.collect_panel(people))
    key_sets = panel.PROPENSITIES
    exposed = panel.attach_propensities(wide, cut(cells, "cells"), key_sets)
    sample = panel.estimation_sample(panel.clean_long(exposed))
    return rounded(sample, [*key_sets, "earning_growth"], 6).select(
        "HIK", "birthyr_adj", "sex_adj", "race_adj", "migrate10", "bpl_grp", "byr_grp", *key_sets, "earning_growth",
        "occ_grp_1940", "employed_1950", "selfemp_1940", "wagewrk_1950", "age_adj_1950",
    )


QUERIES = {
    "register_compile": register_compile,
    "register_cell_counts": register_cell_counts,
    "panel_sample": panel_sample,
}


def _literal(value: object) -> str:
    return "NULL" if value is None else "'" + value.replace("'", "''") + "'" if isinstance(value, str) else str(value)


def _case(column: str, mapping: dict, otherwise: str = "NULL") -> str:
    arms = " ".join(f"WHEN {_literal(k)} THEN {_literal(v)}" for k, v in mapping.items())
    return f"CASE {column} {arms} ELSE {otherwise} END"


def _in(column: str, values) -> str:
    return f"{column} IN ({', '.join(_literal(v) for v in values)})"


def _dealt_sql(name: str) -> str:
    return f"nullif(trim(substr('{DEALT[name]}', (o_orderkey % {len(DEALT[name])})::INT + 1, 1)), '')"


def _bin_sql(year: str) -> str:
    index = f"least(floor(({year} - 1860) / 3), 27)::INT"
    return f"CASE WHEN {year} BETWEEN 1860 AND 1943 THEN (1860 + 3 * {index})::VARCHAR || '-' || least(1862 + 3 * {index}, 1942)::VARCHAR END"


def _birthplace_group_sql(code: str) -> str:
    arms = " ".join(
        f"WHEN {_in(code, values)} THEN {_literal(census.BIRTHPLACE_GROUP_LABELS[n])}" for n, values in census.BIRTHPLACE_GROUPS
    )
    return f"CASE {arms} ELSE {_literal(census.BIRTHPLACE_GROUP_LABELS[4])} END"


def _year_sql(code: str) -> str:
    return f"CASE WHEN try_cast({code} AS INT) > 42 THEN try_cast({code} AS INT) + 1800 ELSE try_cast({code} AS INT) + 1900 END"


def _grouped_sql(column: str, groups) -> str:
    return _case(column, groups_to_mapping(groups)[0])


_NAMES = {code: name for code, name, _ in codes.BIRTHPLACES}
_NUMBERS = {code: number for code, _, number in codes.BIRTHPLACES if number is not None}
_REGISTER = f"""
    raw AS (
      SELECT o_orderkey, CASE WHEN o_custkey % 50 = 0 THEN 'O\\NE' ELSE 'N' || (o_custkey % 7) END AS last_name,
             'F' || (o_custkey % 3) AS first_name,
             CASE WHEN o_custkey % 90 <> 0 THEN lpad((o_custkey % 1000000)::VARCHAR, 6, '0') END AS ind_number,
             o_orderstatus AS file_no, lpad((o_custkey % 30 * 37)::VARCHAR, 5, '0') AS prev_address,
             CASE WHEN o_orderkey % 103 < 100 THEN lpad((o_orderkey % 103)::VARCHAR, 2, '0') ELSE '--' END AS arrival_us,
             CASE WHEN o_orderkey % 101 < 100 THEN lpad((o_orderkey % 101)::VARCHAR, 2, '0') ELSE '&&' END AS birth_yr,
             [{", ".join(_literal(p) for p in PLACES)}][(o_orderkey % {len(PLACES)})::INT + 1] AS place,
             {", ".join(f"{_dealt_sql(n)} AS {n}" for n in DEALT)}
      FROM orders),
    kept AS (
      SELECT * FROM raw WHERE ind_number IS NOT NULL AND NOT contains(last_name, '\\')
      QUALIFY row_number() OVER (PARTITION BY ind_number, file_no, first_name, last_name ORDER BY o_orderkey) = 1),
    one AS (
      SELECT ind_number, {_case("camp", codes.CAMPS)} AS camp, {_case("assembly", codes.ASSEMBLY_CENTERS)} AS assembly,
             CASE WHEN {_in("race_raw", codes.RACE_JAPANESE)} THEN 5 WHEN {_in("race_raw", codes.RACE_WHITE)} THEN 1
                  WHEN {_in("place", codes.FOREIGN_BIRTHPLACES)} THEN 5 WHEN {_in("race_raw", codes.RACE_OTHER)} THEN 0 END AS "RACE",
             {_case("sex_marrge", codes.SEX_OF_CODE)} AS "SEX", {_year_sql("birth_yr")} AS "BIRTHYR",
             {_case("place", _NUMBERS)} AS "BPL", {_case("place", _NAMES, "place")} AS birthplace,
             {_grouped_sql("brth_cntry_pnts", codes.FATHER_BIRTHPLACE)} AS bpl_pop,
             {_grouped_sql("brth_cntry_pnts", codes.MOTHER_BIRTHPLACE)} AS bpl_mom, {_year_sql("arrival_us")} AS "YRIMMIG",
             {_grouped_sql("place", codes.BIRTH_COUNTRY)} AS country, place,
             {_grouped_sql("high_educ", codes.DEGREE_FIELD)} AS "DEGFIELD", {_grouped_sql("high_educ", codes.HIGHEST_DEGREE)} AS high_deg,
             {_grouped_sql("educ", codes.SCHOOL_GRADE)} AS "EDUC", {_case("school_jap", codes.SCHOOL_YEARS)} AS school_jap,
             prev_address, last_name
      FROM kept),
    two AS (
      SELECT *, CASE WHEN country = 'United States' AND bpl_pop IN (15, 99) AND bpl_mom IN (15, 99) THEN 1
                     WHEN country = 'United States' AND bpl_pop = 501 AND bpl_mom IN (15, 99) THEN 2
                     WHEN country = 'United States' AND bpl_pop IN (15, 99) AND bpl_mom = 501 THEN 3
                     WHEN country = 'United States' AND bpl_pop = 501 AND bpl_mom = 501 THEN 4
                     WHEN {_in("place", codes.FOREIGN_BIRTHPLACES)} THEN 5 END AS "NATIVITY"
      FROM one),
    register AS (
      SELECT two.*, CASE WHEN "RACE" = 5 AND "NATIVITY" = 5 THEN 'Issei' WHEN "RACE" = 5 AND "NATIVITY" IN (2, 3, 4) THEN 'Nisei'
                         WHEN "RACE" = 5 AND "NATIVITY" = 1 THEN 'Sansei' END AS generation,
             {_birthplace_group_sql('"BPL"')} AS bpl_grp, {_bin_sql('"BIRTHYR"')} AS byr_grp,
             n_name AS state, n_nationkey AS "STATEFIP", n_regionkey * 10 AS "COUNTYICP"
      FROM two LEFT JOIN nation ON prev_address = lpad((n_nationkey * 37)::VARCHAR, 5, '0'))"""

_PEOPLE = """
    yearly AS (
      SELECT o_custkey AS u, year(o_orderdate) = 1997 AS late, sum(o_totalprice) AS spent, max(o_orderkey) AS l
      FROM orders WHERE year(o_orderdate) IN (1996, 1997) GROUP BY ALL),
    people AS (
      SELECT u, CASE WHEN late THEN 1950 ELSE 1940 END AS y, nullif(c_nationkey + CASE WHEN late AND u % 6 = 0 THEN 1 ELSE 0 END, 0) AS st,
             u % 4 * 10 + CASE WHEN late AND u % 5 = 0 THEN 10 ELSE 0 END AS ct,
             CASE WHEN late AND u % 11 = 0 THEN 1 ELSE 4 + u % 2 END AS race, 1 + u % 2 AS sex,
             1870 + u % 60 + CASE WHEN late AND u % 3 = 0 THEN 1 ELSE 0 END AS byr, [6, 53, 15, 501, 36, 99, 150][(u % 7)::INT + 1] AS bpl,
             CASE WHEN l % 9 <> 0 THEN round(spent / 1000) END AS wage, CASE WHEN l % 10 <> 0 THEN l % 980 END AS occ,
             1 + l % 3 AS emp, l % 3 AS cls
      FROM yearly JOIN customer ON u = c_custkey)"""
_OCCUPATION = "CASE " + " ".join(
    f"WHEN a.occ BETWEEN {low} AND {high} THEN {_literal(label)}" for low, high, label in census.OCCUPATION_GROUPS
) + " END"
_TREATED = "count(*) FILTER (occ % 3 = 0) / count(*)::DOUBLE AS p"

ORACLE = {
    "register_compile": f"WITH {_REGISTER} SELECT {', '.join(chr(34) + c + chr(34) for c in REGISTER_OUTPUT)} FROM register",
    "register_cell_counts": f"""
        WITH {_REGISTER}
        SELECT "STATEFIP", "COUNTYICP", "RACE", "SEX", "BIRTHYR", "BPL", count(*) AS n FROM register GROUP BY ALL""",
    "panel_sample": f"""
        WITH {_PEOPLE},
        f AS (SELECT *, {_bin_sql("byr")} AS bg, {_birthplace_group_sql("bpl")} AS pg FROM people WHERE y = 1940),
        c1 AS (SELECT st, ct, race, {_TREATED} FROM f GROUP BY ALL),
        c2 AS (SELECT st, ct, {_TREATED} FROM f GROUP BY ALL),
        c3 AS (SELECT st, race, pg, bg, {_TREATED} FROM f GROUP BY ALL),
        c4 AS (SELECT st, ct, race, sex, bg, pg, {_TREATED} FROM f GROUP BY ALL),
        a AS (SELECT * FROM f WHERE st IS NOT NULL AND ct IS NOT NULL AND byr < 1926),
        b AS (SELECT * FROM people WHERE y = 1950 AND st IS NOT NULL AND ct IS NOT NULL AND byr < 1926)
        SELECT a.u::VARCHAR AS "HIK", round_even((a.byr + b.byr) / 2.0::DOUBLE, 0)::INT AS birthyr_adj,
               CASE a.sex WHEN 1 THEN 'Male' ELSE 'Female' END AS sex_adj, CASE a.race WHEN 5 THEN 'Japanese' WHEN 4 THEN 'Chinese' END AS race_adj,
               (a.st <> b.st OR a.ct <> b.ct)::INT AS migrate10, a.pg AS bpl_grp, a.bg AS byr_grp,
               round(c1.p + 0.0000000173, 6) AS int_prob, round(c2.p + 0.0000000173, 6) AS county_intprop,
               round(c3.p + 0.0000000173, 6) AS "intprob_AB", round(c4.p + 0.0000000173, 6) AS intprob_full,
               round((b.wage - a.wage) / nullif(a.wage, 0) + 0.0000000173, 6) AS earning_growth, {_OCCUPATION} AS occ_grp_1940,
               (b.emp = 1)::INT AS employed_1950, (a.cls = 1)::INT AS selfemp_1940, (b.cls = 2)::INT AS wagewrk_1950,
               1950 - round_even((a.byr + b.byr) / 2.0::DOUBLE, 0)::INT AS age_adj_1950
        FROM a JOIN b ON a.u = b.u
        LEFT JOIN c1 ON c1.st = a.st AND c1.ct = a.ct AND c1.race = a.race
        LEFT JOIN c2 ON c2.st = a.st AND c2.ct = a.ct
        LEFT JOIN c3 ON c3.st = a.st AND c3.race = a.race AND c3.pg = a.pg AND c3.bg IS NOT DISTINCT FROM a.bg
        LEFT JOIN c4 ON c4.st = a.st AND c4.ct = a.ct AND c4.race = a.race AND c4.sex = a.sex AND c4.bg IS NOT DISTINCT FROM a.bg AND c4.pg = a.pg
        WHERE a.wage IS NOT NULL AND b.wage IS NOT NULL AND a.race = b.race AND a.occ IS NOT NULL AND b.occ IS NOT NULL""",
}
