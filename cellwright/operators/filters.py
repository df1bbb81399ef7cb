"""Row filters with stated NULL rules, deduplication, complete panel units and id checks."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, DataType, DoubleType, FloatType, MapType, StructType, TimestampType

from cellwright.functions.numeric import count_where, member
from cellwright.functions.recode import known, same_known


def present_and_below(df: DataFrame, required: Sequence[str], limits: Mapping[str, object]) -> DataFrame:
    """Rows with every required column present and each limited column below its bound."""
    tests = [F.col(c).isNotNull() for c in required] + [F.col(c) < bound for c, bound in limits.items()]
    return df.where(reduce(lambda a, b: a & b, tests))


def complete_rows(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows on which every listed column is present."""
    return df.dropna(subset=list(columns))


def with_id_and_clean_name(df: DataFrame, id_column: str, name_column: str, mark: str = "\\") -> DataFrame:
    """Rows with a non-empty id and a name without the mark; a missing name drops out as well."""
    return df.where((F.col(id_column) != "") & ~F.contains(F.col(name_column), F.lit(mark)))


def in_set(df: DataFrame, column: str, values: Sequence) -> DataFrame:
    return df.where(member(F.col(column), values))


def outside_sets(df: DataFrame, excluded: Mapping[str, Sequence], above: Mapping[str, float] | None = None) -> DataFrame:
    """Rows whose columns are in none of the excluded sets, and above the cuts."""
    tests = [~member(F.col(c), values) for c, values in excluded.items()]
    tests += [F.col(c) > cut for c, cut in (above or {}).items()]
    return df.where(reduce(lambda a, b: a & b, tests))


def at_or_above(df: DataFrame, column: str, exact: float, cut: float) -> DataFrame:
    """Rows at the exact value or above the cut."""
    return df.where((F.col(column) == exact) | (F.col(column) > cut))


def text_match(df: DataFrame, column: str, pattern: str, equal: Mapping[str, object] | None = None) -> DataFrame:
    """Rows whose text matches a regular expression and whose other columns have given values."""
    tests = [F.col(column).rlike(pattern)] + [F.col(c) == v for c, v in (equal or {}).items()]
    return df.where(reduce(lambda a, b: a & b, tests))


def canonical(value: Column, kind: DataType) -> Column:
    """Text that two values of a type share exactly if Spark groups them together; it says its own length.

    Instants count to the microsecond, 0.0 equals -0.0, NaN equals NaN, and a missing value is one of its own.
    """
    if isinstance(kind, MapType):
        raise TypeError("a map cannot be a key")
    if isinstance(kind, ArrayType):
        parts = F.transform(value, lambda v: canonical(v, kind.elementType))
        text = F.concat(F.size(value).cast("string"), F.lit("["), F.array_join(parts, ""))
    elif isinstance(kind, StructType):
        text = F.concat(*[canonical(value.getField(f.name), f.dataType) for f in kind], F.lit(";"))
    elif isinstance(kind, TimestampType):
        text = F.unix_micros(value).cast("string")
    elif isinstance(kind, BinaryType):
        text = F.hex(value)
    elif isinstance(kind, (FloatType, DoubleType)):
        text = (value.cast("double") + F.lit(0.0)).cast("string")
    else:
        text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def key_digest(df: DataFrame, keys: Sequence[str]) -> Column:
    """SHA-256 of the keys in their canonical text."""
    return F.sha2(F.concat(*[canonical(F.col(k), df.schema[k].dataType) for k in keys]).cast("binary"), 256)


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The first row of every key by a unique order, missing values last. A missing key value is a value of its own.

    One aggregate: each task keeps one row per key before the shuffle, so a key with very many copies
    is no heavier than the others. Rows are sorted and dealt by a SHA-256 digest of the keys, never by long texts.
    """
    position = F.struct(*[part for c in order for part in (F.col(c).isNull(), F.col(c))])
    picked = df.groupBy(key_digest(df, keys).alias("_digest")).agg(F.min_by(F.struct(*df.columns), position).alias("_first"))
    return picked.select("_first.*")


def consistency_flags(first: str, second: str) -> dict[str, Column]:
    """The checks on a wide panel row: wage, occupation and place known in both periods, same race."""
    wage = known(F.col(f"INCWAGE_{first}"), F.col(f"INCWAGE_{second}"))
    race = same_known(F.col(f"RACE_{first}"), F.col(f"RACE_{second}"))
    place = known(F.col(f"COUNTYICP_{first}"), F.col(f"COUNTYICP_{second}"))
    occupation = known(F.col(f"OCC1950_{first}"), F.col(f"OCC1950_{second}"))
    return {
        "consistent_wage": wage,
        "consistent_race": race,
        "consistent_place": place,
        "consistent_occ": occupation,
        "consistent_all": wage & race & place & occupation,
    }


def flag_counts(df: DataFrame, flags: Mapping[str, Column], keys: Sequence[str] = ()) -> DataFrame:
    """How many rows pass each check, by group."""
    return df.groupBy(*keys).agg(*[count_where(test).alias(name) for name, test in flags.items()])


def id_quality(df: DataFrame, column: str) -> DataFrame:
    """Counts of all, missing, blank-padded and empty ids."""
    value = F.col(column)
    return df.agg(
        F.count("*").alias("total"),
        count_where(value.isNull()).alias("n_null"),
        count_where(value != F.trim(value)).alias("n_padded"),
        count_where(value == "").alias("n_empty"),
    )
