"""The register from raw cards to cleaned rows and cell counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cellwright.functions.numeric import member
from cellwright.functions.recode import (
    bounded_two_digit_year,
    columns_like,
    equal_width_bin,
    first_match,
    groups_to_mapping,
    map_codes,
    two_digit_year,
)
from cellwright.functions.rules import birthplace_group
from cellwright.operators.cells import cell_counts
from cellwright.operators.filters import first_per_key, with_id_and_clean_name
from cellwright.operators.joins import lookup_join, recode_columns
from cellwright.operators.project import rename_by, select_present
from cellwright.rules import census
from cellwright.rules import register as codes
from cellwright.sources.delimited import read_csv_table
from cellwright.sources.fixed_width import cut_field, layout_from_widths

CARD_LAYOUT = layout_from_widths(codes.CARD_WIDTHS)
DUPLICATE_KEYS = ["ind_number", "file_no", "first_name", "last_name"]


def read_card_lines(spark: SparkSession, path: str) -> DataFrame:
    """Card lines with ``card_order``: by file name, place of the split in its file, and line in the split.

    The row id alone would not do: Spark reads large splits first, whatever their names.
    """
    place = F.struct(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("start"),
        F.monotonically_increasing_id().alias("line"),
    )
    return spark.read.text(path).select("value", place.alias("card_order"))


def cut_cards(lines: DataFrame) -> DataFrame:
    """All fields of the cards as text, with their order."""
    return lines.select("card_order", *[cut_field(F.col("value"), f).alias(f.name) for f in CARD_LAYOUT])


def drop_duplicate_cards(cards: DataFrame, order: str = "card_order") -> DataFrame:
    """Cards with an id and a clean name, the first of each repeated one."""
    usable = with_id_and_clean_name(cards, "ind_number", "last_name")
    return first_per_key(usable, DUPLICATE_KEYS, [order])


def drop_duplicate_lines(lines: DataFrame) -> DataFrame:
    """As ``drop_duplicate_cards``, on lines that are not cut yet: only the keys are cut, and the rest of a
    card travels as its 80 characters, a fraction of its 33 fields."""
    fields = {f.name: f for f in CARD_LAYOUT}
    keys = [cut_field(F.col("value"), fields[k]).alias(k) for k in DUPLICATE_KEYS]
    usable = with_id_and_clean_name(lines.select("card_order", "value", *keys), "ind_number", "last_name")
    return first_per_key(usable, DUPLICATE_KEYS, ["card_order"]).select("card_order", "value")


def _grouped(code: Column, groups) -> Column:
    return map_codes(code, groups_to_mapping(groups)[0])


def race(race_code: Column, birthplace: Column) -> Column:
    """Race from the race code; if that says nothing, a foreign birthplace decides."""
    return first_match(
        [
            (race_code.isin(codes.RACE_JAPANESE), 5),
            (race_code.isin(codes.RACE_WHITE), 1),
            (birthplace.isin(codes.FOREIGN_BIRTHPLACES), 5),
            (race_code.isin(codes.RACE_OTHER), 0),
        ]
    )


def nativity(birth_country: Column, father: Column, mother: Column, birthplace: Column) -> Column:
    """1 native of native parents, 2 foreign father, 3 foreign mother, 4 both foreign, 5 foreign born."""
    here = birth_country == "United States"
    rules = [
        (here & father.isin(codes.NATIVE_PARENT) & mother.isin(codes.NATIVE_PARENT), 1),
        (here & (father == codes.FOREIGN_PARENT) & mother.isin(codes.NATIVE_PARENT), 2),
        (here & father.isin(codes.NATIVE_PARENT) & (mother == codes.FOREIGN_PARENT), 3),
        (here & (father == codes.FOREIGN_PARENT) & (mother == codes.FOREIGN_PARENT), 4),
        (birthplace.isin(codes.FOREIGN_BIRTHPLACES), 5),
    ]
    return first_match(rules)


def generation(race_code: Column, nativity_code: Column) -> Column:
    of_race = race_code == 5
    return first_match(
        [
            (of_race & (nativity_code == 5), "Issei"),
            (of_race & member(nativity_code, [2, 3, 4]), "Nisei"),
            (of_race & (nativity_code == 1), "Sansei"),
        ]
    )


def label_cards(cards: DataFrame, occupations: DataFrame | None = None) -> DataFrame:
    """Replace the card codes by values. ``occupations`` is a (code, value) dictionary of the occupation
    columns, as long as needed; without it they keep their codes."""
    place = F.col("birthplace")
    names = {code: name for code, name, _ in codes.BIRTHPLACES}
    numbers = {code: number for code, _, number in codes.BIRTHPLACES if number is not None}
    labelled = cards.withColumns(
        {
            "camp": map_codes(F.col("camp"), codes.CAMPS),
            "assembly": map_codes(F.col("assembly"), codes.ASSEMBLY_CENTERS),
            "sex": map_codes(F.col("sex_marrge"), codes.SEX_OF_CODE),
            "marst": map_codes(F.col("sex_marrge"), codes.MARITAL_OF_CODE),
            "birthyr": two_digit_year(F.col("birth_yr")),
            "race": race(F.col("race_raw"), place),
            "bpl_pop": _grouped(F.col("brth_cntry_pnts"), codes.FATHER_BIRTHPLACE),
            "bpl_mom": _grouped(F.col("brth_cntry_pnts"), codes.MOTHER_BIRTHPLACE),
            "yrimmig": bounded_two_digit_year(F.col("arrival_us")),
            "birth_country": _grouped(place, codes.BIRTH_COUNTRY),
            "school_jap": map_codes(F.col("school_jap"), codes.SCHOOL_YEARS),
            "degfield": _grouped(F.col("high_educ"), codes.DEGREE_FIELD),
            "high_deg": _grouped(F.col("high_educ"), codes.HIGHEST_DEGREE),
            "educ": _grouped(F.col("educ"), codes.SCHOOL_GRADE),
            "bpl": map_codes(place, numbers),
        }
    )
    labelled = labelled.withColumn(
        "nativity", nativity(F.col("birth_country"), F.col("bpl_pop"), F.col("bpl_mom"), place)
    )
    labelled = labelled.withColumn("generation", generation(F.col("race"), F.col("nativity")))
    labelled = labelled.withColumn("birthplace", map_codes(place, names, keep_unmatched=True))
    if occupations is not None:
        labelled = recode_columns(labelled, columns_like(labelled, "^(qual|pot)_occ_"), occupations)
    return labelled


def compile_register(lines: DataFrame, addresses: DataFrame, occupations: DataFrame | None = None) -> DataFrame:
    """Deduplicate, cut, recode, bin and geocode card lines; the result has the columns of the cleaned register."""
    labelled = label_cards(cut_cards(drop_duplicate_lines(lines)), occupations)
    binned = labelled.withColumn("bpl_grp", birthplace_group(F.col("bpl")))
    binned = binned.withColumn("byr_grp", equal_width_bin(F.col("birthyr")))
    placed = lookup_join(binned, addresses, ["prev_address"], null_safe=True)
    upper = ["race", "sex", "birthyr", "bpl", "yrimmig", "nativity", "degfield", "educ"]
    return select_present(rename_by(placed, str.upper, upper), codes.REGISTER_COLUMNS)


def read_addresses(spark: SparkSession, path: str) -> DataFrame:
    return read_csv_table(spark, path, codes.ADDRESS_SCHEMA)


def register_cells(register: DataFrame) -> DataFrame:
    return cell_counts(register, census.CELL_KEYS)


def census_cells(people: DataFrame, year: int = 1940) -> DataFrame:
    return cell_counts(people, census.CELL_KEYS, F.col("YEAR") == year)
