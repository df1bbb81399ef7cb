"""Rule tables as small DataFrames, and the recodes of census columns built on the fixed values."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cellwright.functions.numeric import member
from cellwright.functions.recode import band, first_match, map_codes
from cellwright.rules import census, regions

# A rule table is written in code, so its length is known before it is broadcast.
RULE_ROWS = 10_000


def rule_table(spark: SparkSession, rows: Sequence[tuple], schema: str) -> DataFrame:
    """A table of literal rows, marked for broadcast."""
    if len(rows) > RULE_ROWS:
        raise ValueError("too long for a rule table; read it as a file and use lookup_join")
    return F.broadcast(spark.createDataFrame(rows, schema))


def region_rows(rules: Iterable[tuple[int, Sequence[int], str]]) -> tuple[list[tuple], list[tuple]]:
    """One (state, county, region) row per county. The first rule that names a county wins; the later
    ones come back as the second item."""
    seen: dict[tuple[int, int], str] = {}
    shadowed = []
    for state, counties, region in rules:
        for county in counties:
            if (state, county) in seen:
                shadowed.append((state, county, region))
            else:
                seen[(state, county)] = region
    return [(s, c, r) for (s, c), r in seen.items()], shadowed


def assign_region(
    df: DataFrame,
    state: str = "STATEFIP",
    county: str = "COUNTYICP",
    rules: Iterable[tuple[int, Sequence[int], str]] = regions.REGIONS,
    ruled_states: Sequence[int] = tuple(regions.WEST_COAST_STATES),
    output: str = "region",
) -> DataFrame:
    """Add the region of a two-part area key. Outside the ruled states the region is the state code."""
    rows, _ = region_rows(rules)
    table = rule_table(df.sparkSession, rows, "_state int, _county int, _region string")
    match = (df[state] == table["_state"]) & (df[county] == table["_county"])
    joined = df.join(table, match, "left")
    elsewhere = F.when(~member(F.col(state), ruled_states), F.col(state).cast("string"))
    return joined.withColumn(output, F.coalesce(elsewhere, F.col("_region"))).drop("_state", "_county", "_region")


def zone_flag(
    state: Column,
    region: Column,
    ruled_states: Sequence[int] = tuple(regions.WEST_COAST_STATES),
    whole_states: Sequence[int] = tuple(regions.WHOLE_STATE_IN_ZONE),
    outside: Sequence[str] = tuple(regions.OUTSIDE_ZONE),
) -> Column:
    """1 inside the zone, else 0; an area without a region lies outside."""
    inside = region.isNotNull() & ~member(region, outside)
    return first_match([(~member(state, ruled_states), 0), (member(state, whole_states), 1), (inside, 1)], 0)


def birthplace_group(code: Column) -> Column:
    """Group label of a birthplace code; a missing code is in the last group."""
    labels = census.BIRTHPLACE_GROUP_LABELS
    return first_match([(code.isin(codes), labels[n]) for n, codes in census.BIRTHPLACE_GROUPS], labels[4])


def birthplace_group_number(code: Column) -> Column:
    """Order number of the birthplace group."""
    return first_match([(code.isin(codes), n) for n, codes in census.BIRTHPLACE_GROUPS], 4)


def occupation_group(code: Column) -> Column:
    return band(code, census.OCCUPATION_GROUPS)


def age_cohort(birth_year: Column) -> Column:
    return band(birth_year, census.AGE_COHORTS)


def birth_country_of_code(code: Column) -> Column:
    return band(code, census.BIRTH_COUNTRIES, "Other")


def race_class(code: Column) -> Column:
    return first_match([(code == value, name) for value, name in census.RACE_CLASSES], "other")


def race_label(code: Column) -> Column:
    return map_codes(code, census.RACE_LABELS)


def west_coast(state: Column) -> Column:
    return F.when(member(state, regions.WEST_COAST_STATES), "West Coast").otherwise("Other")


def exposure_group(race: Column, propensity: Column, low: float = 0.0, high: float = 0.75) -> Column:
    """Comparison group from race label and propensity; values between the cuts are set aside."""
    treated = race == "Japanese"
    return first_match(
        [
            (race == "Chinese", "Chinese"),
            (treated & (propensity == low), "Unexposed"),
            (treated & (propensity > high), "Exposed"),
            (treated & propensity.between(low, high), "(Dropped)"),
        ]
    )
