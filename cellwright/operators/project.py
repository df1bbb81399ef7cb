"""Projections: tolerant selects, renames over a set of columns, casts by type, and sampling."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DataType


def select_present(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """The named columns that the table has, in the order given."""
    return df.select(*[name for name in names if name in df.columns])


def select_renamed(df: DataFrame, names: Mapping[str, str]) -> DataFrame:
    """Select and rename; ``names`` maps new name to old name."""
    return df.select(*[F.col(old).alias(new) for new, old in names.items()])


def select_between(df: DataFrame, first: str, last: str, *more: str) -> DataFrame:
    """The columns from ``first`` to ``last`` by position, then ``more``."""
    start, stop = df.columns.index(first), df.columns.index(last)
    return df.select(*df.columns[start : stop + 1], *more)


def rename_by(df: DataFrame, rule: Callable[[str], str], columns: Sequence[str] | None = None) -> DataFrame:
    """Rename columns by a function of their name."""
    return df.withColumnsRenamed({c: rule(c) for c in (columns or df.columns) if c in df.columns})


def across(
    df: DataFrame, columns: Sequence[str], rules: Mapping[str, Callable[[Column], Column]], names: str = "{fn}_{col}"
) -> dict[str, Column]:
    """The same expressions over many columns, named by a template. Use with ``withColumns`` or ``agg``.
    Columns the table lacks are skipped."""
    present = [c for c in columns if c in df.columns]
    return {names.format(fn=fn, col=c): rule(F.col(c)) for c in present for fn, rule in rules.items()}


def aggregate_across(
    df: DataFrame,
    keys: Sequence[str],
    columns: Sequence[str],
    rules: Mapping[str, Callable[[Column], Column]],
    names: str = "{fn}_{col}",
) -> DataFrame:
    """Group and apply the same aggregates to many columns."""
    aggregates = across(df, columns, rules, names)
    return df.groupBy(*keys).agg(*[c.alias(n) for n, c in aggregates.items()])


def cast_types(df: DataFrame, source: type[DataType], target: str) -> DataFrame:
    """Cast every column of one type to another; a value that does not fit becomes NULL."""
    names = [f.name for f in df.schema.fields if isinstance(f.dataType, source)]
    return df.withColumns({n: F.col(n).try_cast(target) for n in names}) if names else df


def distinct_values(df: DataFrame, column: str) -> DataFrame:
    return df.select(column).distinct()


def sample_share(df: DataFrame, share: float, seed: int) -> DataFrame:
    """Each row with the given probability."""
    return df.sample(fraction=share, seed=seed)


def sample_rows(df: DataFrame, n: int, key: Sequence[str], seed: int) -> DataFrame:
    """Exactly ``n`` rows, picked by a digest of a unique key, so the pick does not depend on partitions."""
    return df.orderBy(F.md5(F.concat_ws(":", F.lit(str(seed)), *key)), *key).limit(n)
