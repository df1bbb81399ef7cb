"""Null-safe arithmetic on columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def ratio(numerator: Column, denominator: Column) -> Column:
    """``numerator / denominator`` as double; NULL when the denominator is zero or missing."""
    return F.try_divide(numerator.cast("double"), denominator.cast("double"))


def total(value: Column) -> Column:
    """Sum of the present values; zero when there are none."""
    return F.coalesce(F.sum(value), F.lit(0))


def count_where(condition: Column) -> Column:
    """Rows on which the condition holds; a NULL condition does not count."""
    return F.count_if(F.coalesce(condition, F.lit(False)))


def share_where(condition: Column) -> Column:
    """Share of the rows with a known condition on which it holds."""
    return F.avg(condition.cast("double"))


def member(value: Column, choices) -> Column:
    """Set membership that is never NULL, so it can be negated."""
    return F.coalesce(value.isin(list(choices)), F.lit(False))


def mid_year(first: Column, second: Column) -> Column:
    """Average of two years, halves rounded to the even year."""
    return F.bround((first + second) / F.lit(2.0), 0).cast("int")


def growth(before: Column, after: Column) -> Column:
    """Relative change; NULL when the base is zero."""
    return ratio(after - before, before)


def changed(pairs) -> Column:
    """1 when any of the (before, after) pairs differs, 0 when none does, NULL when it cannot be known.

    Give several pairs where the key has several parts: an area is a state and a county, and a
    county code alone repeats from state to state.
    """
    differs = None
    for before, after in pairs:
        test = before != after
        differs = test if differs is None else differs | test
    return differs.cast("int")


def age_in(year: Column | int, birth_year: Column) -> Column:
    return F.lit(year) - birth_year if isinstance(year, int) else year - birth_year


def positive_log(value: Column, base10: bool = False) -> Column:
    """Logarithm of positive values; NULL for the rest."""
    return F.when(value > 0, F.log10(value) if base10 else F.ln(value))


def fill_zero(value: Column) -> Column:
    return F.coalesce(value, F.lit(0))


def area_code(value: Column, width: int, scale: int = 1) -> Column:
    """A number as a zero-padded text code, after multiplying by ``scale``."""
    return F.lpad((value.cast("bigint") * F.lit(scale)).cast("string"), width, "0")


def area_number(code: Column, scale: int = 1) -> Column:
    """The number in a padded text code, floor-divided by ``scale``; NULL if it is not a number."""
    return F.floor(code.try_cast("bigint") / F.lit(scale)).cast("int")


def compose_key(high: Column, low: Column, scale: int = 10_000) -> Column:
    """One number from a two-part key."""
    return high.cast("bigint") * F.lit(scale) + low.cast("bigint")


def strip_text(value: Column, pattern: str | None = None) -> Column:
    """Trimmed text, with every match of ``pattern`` removed first."""
    return F.trim(F.regexp_replace(value, pattern, "") if pattern else value)
