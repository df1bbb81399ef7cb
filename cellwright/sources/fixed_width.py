"""Fixed-width text: the layout is a table, and only the fields asked for are cut."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


class Field(NamedTuple):
    """One field of a record: first and last character (from 1), implied decimals, and type.

    ``kind`` is 'string', 'int', 'bigint' or 'double'.
    """

    name: str
    start: int
    end: int
    decimals: int = 0
    kind: str = "string"


def layout_from_widths(widths: Iterable[tuple[str, int]], kind: str = "string") -> list[Field]:
    """Fields that follow each other without gaps."""
    fields, start = [], 1
    for name, width in widths:
        fields.append(Field(name, start, start + width - 1, 0, kind))
        start += width
    return fields


def cut_field(line: Column, field: Field) -> Column:
    """One field of a line: trimmed, blank as NULL, text that is not a number as NULL."""
    text = F.trim(F.substring(line, field.start, field.end - field.start + 1))
    text = F.nullif(text, F.lit(""))
    if field.kind == "string":
        return text
    if field.decimals:
        return text.try_cast("double") / F.lit(float(10**field.decimals))
    return text.try_cast(field.kind)


def cut_fixed_width(lines: DataFrame, layout: Sequence[Field], names: Sequence[str] | None = None) -> DataFrame:
    """Cut the column ``value`` into fields. ``names`` limits and orders them."""
    by_name = {field.name: field for field in layout}
    wanted = list(names) if names is not None else [field.name for field in layout]
    missing = [name for name in wanted if name not in by_name]
    if missing:
        raise ValueError(f"not in the layout: {missing}")
    line = F.col("value")
    return lines.select(*[cut_field(line, by_name[name]).alias(name) for name in wanted])


def read_lines(spark: SparkSession, path: str, partitions: int | None = None) -> DataFrame:
    """Text lines as column ``value``. A gzip file arrives as one split: give ``partitions`` to spread it."""
    lines = spark.read.text(path)
    return lines.repartition(partitions) if partitions else lines


def read_fixed_width(
    spark: SparkSession,
    path: str,
    layout: Sequence[Field],
    names: Sequence[str] | None = None,
    partitions: int | None = None,
) -> DataFrame:
    """Read a fixed-width file or folder of files."""
    return cut_fixed_width(read_lines(spark, path, partitions), layout, names)


def peek_lines(spark: SparkSession, path: str, n: int = 5) -> DataFrame:
    """The first raw lines of a file."""
    return spark.read.text(path).limit(n)


def read_ddi_layout(spark: SparkSession, path: str) -> DataFrame:
    """Field table (name, start, end, decimals, kind) from a DDI codebook's ``var`` elements."""
    variables = spark.read.format("xml").option("rowTag", "var").load(path)
    decimals = F.col("_dcml").try_cast("int") if "_dcml" in variables.columns else F.lit(None).cast("int")
    decimals = F.coalesce(decimals, F.lit(0))
    style = F.lit("numeric")
    if "varFormat" in variables.columns:
        style = F.coalesce(F.col("varFormat._type"), F.lit("numeric"))
    start = F.col("location._StartPos").cast("int")
    end = F.col("location._EndPos").cast("int")
    kind = (
        F.when(style == "character", "string")
        .when(decimals > 0, "double")
        .when(end - start >= 9, "bigint")
        .otherwise("int")
    )
    return variables.select(
        F.col("_name").alias("name"), start.alias("start"), end.alias("end"), decimals.alias("decimals"), kind.alias("kind")
    )


def layout_fields(layout: DataFrame) -> list[Field]:
    """A layout table as fields. A layout has one row per variable, so it is small."""
    return [Field(r["name"], r["start"], r["end"], r["decimals"], r["kind"]) for r in layout.orderBy("start").collect()]


def fixed_width_line(fields: Sequence[tuple[Column, int]]) -> Column:
    """The reverse of a cut: one line from (column, width) pairs, left-aligned and blank-padded."""
    return F.concat(*[F.rpad(F.coalesce(column.cast("string"), F.lit("")), width, " ") for column, width in fields])
