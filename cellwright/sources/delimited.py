"""Delimited text: CSV with a stated schema, padded CSV, and text with a quoted multi-character separator."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cellwright.functions.numeric import area_number
from cellwright.functions.recode import map_codes


def read_csv_table(spark: SparkSession, path: str, schema: str, null_value: str = "NA") -> DataFrame:
    """CSV with a header line. The schema is stated, so the file is read once."""
    return spark.read.csv(path, header=True, schema=schema, nullValue=null_value)


def read_padded_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """CSV whose fields are padded with blanks and whose numbers may be empty."""
    return spark.read.csv(
        path, header=True, schema=schema, ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True, nullValue=""
    )


def split_separated(line: Column, names: Sequence[str], quote: str = "~", separator: str = "~^~") -> list[Column]:
    """The fields of a line such as ``~a~^~b~``. The separator is taken literally, so a comma inside a
    field is just text. An empty field is NULL."""
    mark = re.escape(quote)
    bare = F.regexp_replace(line, f"^{mark}|{mark}$", "")
    parts = F.split(bare, re.escape(separator))
    return [F.nullif(F.get(parts, F.lit(i)), F.lit("")).alias(name) for i, name in enumerate(names)]


def separated_header(spark: SparkSession, path: str, quote: str = "~", separator: str = "~^~") -> list[str]:
    """The column names in the first line of a file."""
    first = spark.read.text(path).first()
    return first["value"].removeprefix(quote).removesuffix(quote).split(separator) if first else []


def read_separated(
    spark: SparkSession, path: str, names: Sequence[str] | None = None, quote: str = "~", separator: str = "~^~"
) -> DataFrame:
    """Read text with a quoted separator; the header line gives the names unless they are given."""
    names = list(names) if names else separated_header(spark, path, quote, separator)
    header = quote + separator.join(names) + quote
    lines = spark.read.text(path).where(F.col("value") != F.lit(header))
    return lines.select(*split_separated(F.col("value"), names, quote, separator))


# Territory names and the state names they are filed under (fixed values).
TERRITORY_NAMES = {"Alaska Territory": "Alaska", "Hawaii Territory": "Hawaii"}


def area_attributes(table: DataFrame, territory_names: dict[str, str] = TERRITORY_NAMES) -> DataFrame:
    """Attribute rows of an area layer with plain names and numeric state and county codes.

    State codes carry an extra digit for territories and are floor-divided by ten.
    """
    return table.select(
        map_codes(F.col("STATENAM"), territory_names, keep_unmatched=True).alias("STATENAM"),
        "NHGISNAM",
        "NHGISST",
        "NHGISCTY",
        "ICPSRFIP",
        area_number(F.col("NHGISST"), 10).alias("STATEFIP"),
        area_number(F.col("NHGISCTY")).alias("COUNTYICP"),
    )
