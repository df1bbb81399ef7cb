"""The area table: population by class and treated people per area, with region and zone, and its roll-up to regions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellwright.functions.rules import assign_region, race_class, zone_flag
from cellwright.operators.cells import area_demographics, roll_up

AREA = ["STATEFIP", "COUNTYICP"]
CLASSES = ["japn", "chin", "other"]


def area_table(cells: DataFrame, treated: str = "n_treated", population: str = "n_population") -> DataFrame:
    """One row per area from cells by area and race: ``pop_<class>``, ``pop_tot``, ``treated``, both shares, region and zone.

    A class that an area lacks counts zero there. Areas are few, and only they meet the region rules. A missing state or county
    is an area of its own, without a region and outside the zone.
    """
    areas = area_demographics(cells, AREA, race_class(F.col("RACE")), CLASSES, treated, population, share_of="japn")
    placed = assign_region(areas)
    return placed.withColumn("zone", zone_flag(F.col("STATEFIP"), F.col("region")))


def region_table(areas: DataFrame) -> DataFrame:
    """The areas summed to regions; ``zone`` is the share of a region's areas inside, and the shares are worked out anew."""
    shares = {"share_tot": ("treated", "pop_tot"), "share_japn": ("treated", "pop_japn")}
    sums = ["pop_tot", *[f"pop_{c}" for c in CLASSES], "treated"]
    rolled = roll_up(areas.withColumn("_inside", F.col("zone") == 1), ["region"], sums, "_inside", shares)
    return rolled.withColumnRenamed("_inside", "zone")

