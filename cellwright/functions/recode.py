"""Recodes: dictionaries, ordered rules, ranges, bins and missing-value codes.

A rule set is data. Small ones become one column expression; a dictionary of any size can be given
as a table and is joined (see ``operators.joins.recode_columns``).
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def map_codes(code: Column, mapping: Mapping, default: object = None, keep_unmatched: bool = False) -> Column:
    """Dictionary lookup on a text code. Codes are compared as text, so '0' never equals '00'."""
    entries = [F.lit(item) for pair in mapping.items() for item in pair]
    found = F.create_map(*entries)[code]
    if keep_unmatched:
        return F.coalesce(found, code)
    return found if default is None else F.coalesce(found, F.lit(default))


def groups_to_mapping(groups: Iterable[tuple[object, Iterable[str]]]) -> tuple[dict, list[str]]:
    """Turn (value, codes) rows into a dictionary. The first row that names a code wins; the codes
    named again later are returned as the second item."""
    mapping: dict = {}
    shadowed: list[str] = []
    for value, codes in groups:
        for code in codes:
            if code in mapping:
                shadowed.append(code)
            else:
                mapping[code] = value
    return mapping, shadowed


def first_match(rules: Sequence[tuple[Column, object]], default: object = None) -> Column:
    """Value of the first rule whose condition holds. A NULL condition does not match."""
    chain = None
    for condition, value in rules:
        chain = F.when(condition, value) if chain is None else chain.when(condition, value)
    return chain if default is None else chain.otherwise(default)


def band(value: Column, ranges: Sequence[tuple[object, object, object]], default: object = None) -> Column:
    """Label of the first (low, high, label) range that holds the value, ends included. A None end is open."""
    rules = []
    for low, high, label in ranges:
        if low is None:
            test = value <= high
        elif high is None:
            test = value >= low
        else:
            test = value.between(low, high)
        rules.append((test, label))
    return first_match(rules, default)


def bin_index(value: Column, start: int, stop: int, width: int) -> Column:
    """Number of the left-closed bin of ``width`` that holds the value, from 0.

    ``stop`` is the last labelled value; the edge ``stop + 1`` still falls in the last bin.
    """
    last = (stop - start) // width
    inside = value.between(start, stop + 1)
    return F.when(inside, F.least(F.floor((value - F.lit(start)) / F.lit(width)), F.lit(last)).cast("int"))


def equal_width_bin(value: Column, start: int = 1860, stop: int = 1942, width: int = 3) -> Column:
    """Label ``a-b`` of the bin; the last label is clipped at ``stop``."""
    low = F.lit(start) + bin_index(value, start, stop, width) * F.lit(width)
    high = F.least(low + F.lit(width - 1), F.lit(stop))
    return F.concat(low.cast("string"), F.lit("-"), high.cast("string"))


def two_digit_year(code: Column, pivot: int = 42, before: int = 1800, after: int = 1900) -> Column:
    """Full year from a two-digit text year: above the pivot in ``before``, else in ``after``."""
    number = code.try_cast("int")
    return F.when(number > pivot, number + F.lit(before)).when(number <= pivot, number + F.lit(after))


def bounded_two_digit_year(code: Column, pivot: int = 42) -> Column:
    """As ``two_digit_year``, only for numbers 0 to 99."""
    return F.when(code.try_cast("int").between(0, 99), two_digit_year(code, pivot))


def flag(condition: Column) -> Column:
    """1 when the condition holds, else 0; a missing input gives 0."""
    return F.when(condition, F.lit(1)).otherwise(F.lit(0))


def known(*columns: Column) -> Column:
    """True when every column is present."""
    test = F.lit(True)
    for column in columns:
        test = test & column.isNotNull()
    return test


def same_known(first: Column, second: Column) -> Column:
    """True when both are present and equal, else false."""
    return F.coalesce(first == second, F.lit(False))


def blank_sentinels(df: DataFrame, rules: Iterable[tuple[str, object, object]]) -> DataFrame:
    """Replace coded missing values by NULL. ``rules`` are (column, low, high) rows; columns that the
    table lacks are skipped."""
    by_column: dict[str, list[tuple[object, object]]] = {}
    for column, low, high in rules:
        if column in df.columns:
            by_column.setdefault(column, []).append((low, high))
    replaced = {}
    for column, ranges in by_column.items():
        coded = F.lit(False)
        for low, high in ranges:
            coded = coded | F.col(column).between(low, high)
        replaced[column] = F.when(~F.coalesce(coded, F.lit(False)), F.col(column))
    return df.withColumns(replaced) if replaced else df


def scale_in_period(value: Column, period: Column, base: int, factor: float) -> Column:
    """Multiply the values of one period by a price factor."""
    return F.when(period == base, value * F.lit(factor)).otherwise(value)


def columns_like(df: DataFrame, pattern: str) -> list[str]:
    """The columns whose name matches a regular expression."""
    return [name for name in df.columns if re.search(pattern, name)]
