"""The linked panel: query, wide cleaning, propensities, long cleaning and the estimation sample."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellwright.functions.numeric import age_in, changed, growth, mid_year
from cellwright.functions.recode import equal_width_bin, first_match, flag
from cellwright.functions.rules import birthplace_group, occupation_group
from cellwright.operators.cells import attach_propensity
from cellwright.operators.filters import consistency_flags, present_and_below
from cellwright.operators.joins import keep_units, label_codes, lookup_join
from cellwright.operators.project import select_present
from cellwright.operators.reshape import period_values, to_long, to_wide
from cellwright.rules import census

YEARS = ("1940", "1950")


def collect_panel(
    people: DataFrame,
    units: DataFrame | None = None,
    columns: Sequence[str] = tuple(census.PANEL_COLUMNS),
    born_before: int = 1926,
    years: Sequence[int] = (1940, 1950),
) -> DataFrame:
    """One row per linked unit with a known place and a birth year below the bound.

    ``units`` limits the panel to listed ids.
    """
    if units is not None:
        people = keep_units(people, units, "HIK")
    kept = present_and_below(people, ["STATEFIP", "COUNTYICP"], {"BIRTHYR": born_before})
    values = [c for c in columns if c in people.columns]
    return to_wide(kept.select("HIK", "YEAR", *values), ["HIK"], "YEAR", list(years), values)


def clean_wide(wide: DataFrame, move_keys: Sequence[str] = ("STATEFIP", "COUNTYICP")) -> DataFrame:
    """Settle what should not change between the periods, and flag movers.

    A move is a change in any of ``move_keys``. The unit keeps its linkage id, which is unique.
    """
    first, second = YEARS
    sex = F.col(f"SEX_{first}")
    moves = [(F.col(f"{k}_{first}"), F.col(f"{k}_{second}")) for k in move_keys]
    return wide.withColumns(
        {
            "birthyr_adj": mid_year(F.col(f"BIRTHYR_{first}"), F.col(f"BIRTHYR_{second}")),
            "sex_adj": F.when(sex == 1, "Male").when(sex.isNotNull(), "Female"),
            "race_adj": first_match([(F.col(f"RACE_{first}") == c, n) for c, n in census.RACE_PANEL_LABELS]),
            "migrate10": changed(moves),
            "same_occ": (F.col(f"OCC1950_{first}") == F.col(f"OCC1950_{second}")).cast("int"),
            "bpl_grp": birthplace_group(F.col(f"BPL_{first}")),
            "byr_grp": equal_width_bin(F.col(f"BIRTHYR_{first}")),
            "earning_growth": growth(F.col(f"INCWAGE_{first}"), F.col(f"INCWAGE_{second}")),
        }
    )


def with_first_period_keys(wide: DataFrame, keys: Sequence[str] = tuple(census.CELL_KEYS)) -> DataFrame:
    """Copies of the first period's cell keys under their plain names, for the join with the cells."""
    return wide.withColumns({k: F.col(f"{k}_{YEARS[0]}") for k in keys})


def coarse_keys() -> dict[str, tuple[str, Column]]:
    """Groups that stand in for birth year and birthplace in a propensity."""
    return {
        "BIRTHYR": ("byr_grp", equal_width_bin(F.col("BIRTHYR"))),
        "BPL": ("bpl_grp", birthplace_group(F.col("BPL"))),
    }


# Key sets of the four named propensities. A county is told by state and county code together.
PROPENSITIES = {
    "int_prob": ["STATEFIP", "COUNTYICP", "RACE"],
    "county_intprop": ["STATEFIP", "COUNTYICP"],
    "intprob_AB": ["STATEFIP", "RACE", "BPL", "BIRTHYR"],
    "intprob_full": ["STATEFIP", "COUNTYICP", "RACE", "SEX", "BIRTHYR", "BPL"],
}


def attach_propensities(
    wide: DataFrame, cells: DataFrame, key_sets: Mapping[str, Sequence[str]] = PROPENSITIES, threshold: float = 0.5
) -> DataFrame:
    """One propensity column per key set, from the first period's place and person."""
    units = with_first_period_keys(wide)
    for name, keys in key_sets.items():
        units = attach_propensity(units, cells, keys, coarse_keys(), threshold)
        units = units.drop("n_treated", "n_population", "exposed").withColumnRenamed("propensity", name)
    return units.drop(*census.CELL_KEYS)


def clean_long(wide: DataFrame, labels: DataFrame | None = None, areas: DataFrame | None = None) -> DataFrame:
    """Two rows per unit, with indicators, occupation group, area statistics and age; labels come last."""
    stems = period_values(wide, YEARS)
    ids = [c for c in wide.columns if not c.endswith(tuple(f"_{y}" for y in YEARS))]
    long = to_long(wide, ids, stems, YEARS).withColumn("YEAR", F.col("YEAR").cast("int"))
    flags = {
        name: flag(F.col(source).isin(values)) for source, values, name in census.INDICATORS if source in long.columns
    }
    long = long.withColumns({**flags, "occ_grp": occupation_group(F.col("OCC1950"))})
    if areas is not None:
        long = lookup_join(long, areas, ["STATEFIP", "COUNTYICP"])
    long = long.withColumn("age_adj", age_in(F.col("YEAR"), F.col("birthyr_adj")))
    if labels is not None:
        coded = ["OCC1950", "IND1950", "RACE", "SEX", "EDUCD", "CLASSWKR", "EMPSTAT", "FARM"]
        long = label_codes(long, labels, [c for c in coded if c in long.columns])
    return long


UNIT_COLUMNS = [
    "HIK", "byr_grp", "bpl_grp", "migrate10", "sex_adj", "race_adj", "birthyr_adj", "int_prob", "county_intprop",
    "intprob_AB", "intprob_full", "earning_growth",
]


def estimation_sample(long: DataFrame, years: Sequence[int] = (1940, 1950)) -> DataFrame:
    """Wide rows of the units that are complete and consistent in both periods."""
    units = [c for c in UNIT_COLUMNS if c in long.columns]
    values = [c for c in long.columns if c not in [*units, "YEAR"]]
    wide = to_wide(select_present(long, [*units, "YEAR", *values]), units, "YEAR", list(years), values)
    flagged = wide.withColumns(consistency_flags(*[str(y) for y in years]))
    return flagged.where("consistent_all")
