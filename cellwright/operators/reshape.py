"""Panels between long and wide, and moves between two periods."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellwright.functions.numeric import ratio, total
from cellwright.session import cut


def to_wide(
    df: DataFrame,
    ids: Sequence[str],
    period: str,
    periods: Sequence,
    values: Sequence[str],
    reduce: str | None = None,
    template: str = "{value}_{period}",
    absent_zero: bool = False,
) -> DataFrame:
    """One row per unit, one column per value and period.

    The periods are stated, so one aggregate does it. A unit with two rows in a period raises an error,
    unless ``reduce`` ('sum', 'min', 'max') says how to merge them. A unit missing from a period has NULLs.
    """
    merge = {"sum": F.sum, "min": F.min, "max": F.max, None: F.max}[reduce]
    columns = []
    for value in values:
        for p in periods:
            picked = merge(F.when(F.col(period) == p, F.col(value)))
            picked = F.coalesce(picked, F.lit(0)) if absent_zero else picked
            columns.append(picked.alias(template.format(value=value, period=p)))
    if reduce:
        return df.groupBy(*ids).agg(*columns)
    most = F.greatest(*[F.count_if(F.col(period) == p) for p in periods], F.lit(0))
    wide = df.groupBy(*ids).agg(most.alias("_most"), *columns)
    message = F.lit(f"a unit has two rows in one {period}; name a way to reduce them")
    checked = F.when(F.col("_most") > 1, F.raise_error(message).cast("boolean"))
    return wide.where(F.coalesce(checked, F.lit(True))).drop("_most")


def to_long(
    df: DataFrame, ids: Sequence[str], values: Sequence[str], periods: Sequence, period: str = "YEAR"
) -> DataFrame:
    """One row per unit and period from columns named ``VALUE_period``; several values at once.

    A value that lacks a column for some period is NULL there.
    """
    types = {f.name: f.dataType for f in df.schema.fields}
    rows = []
    for p in periods:
        fields = [F.lit(p).alias(period)]
        for v in values:
            name = f"{v}_{p}"
            other = next(types[f"{v}_{q}"] for q in periods if f"{v}_{q}" in types)
            fields.append((F.col(name) if name in types else F.lit(None).cast(other)).alias(v))
        rows.append(F.struct(*fields))
    return df.select(*ids, F.inline(F.array(*rows)))


def period_values(df: DataFrame, periods: Sequence) -> list[str]:
    """The stems of the columns named ``STEM_period``, in order of appearance."""
    ends = [f"_{p}" for p in periods]
    stems = [c[: -len(e)] for c in df.columns for e in ends if c.endswith(e)]
    return list(dict.fromkeys(stems))


def melt(df: DataFrame, ids: Sequence[str], columns: Sequence[str], name: str, value: str) -> DataFrame:
    """Wide to long for one value column."""
    return df.unpivot(list(ids), list(columns), name, value)


def transitions(wide: DataFrame, before: str, after: str, movers_only: bool = True) -> DataFrame:
    """Count of units per (before, after) pair, both known."""
    pairs = wide.where(F.col(before).isNotNull() & F.col(after).isNotNull())
    if movers_only:
        pairs = pairs.where(F.col(before) != F.col(after))
    return pairs.groupBy(before, after).agg(F.count("*").alias("n"))


def transition_shares(counts: DataFrame, digits: int = 2) -> DataFrame:
    """Share of each pair in all pairs, rounded half to even."""
    whole = counts.agg(F.sum("n")).scalar()
    return counts.withColumn("p", F.bround(ratio(F.col("n"), whole), digits))


def movers_table(
    wide: DataFrame, group: Sequence[str], before: Column, after: Column, classes: Sequence[str] | None = None, most_pairs: int = 1000
) -> DataFrame:
    """Units per group by the pair of classes before and after, one column per pair.

    Without ``classes`` the pairs are those found in the data, a missing class being NA; the table is counted once, and more than
    ``most_pairs`` pairs, or two of one name, are an error.
    """
    if classes is not None:
        columns = [
            total(F.when((before == a) & (after == b), 1)).alias(f"{a}_{b}".replace(" ", "_"))
            for a in classes
            for b in classes
        ]
        return wide.groupBy(*group).agg(*columns)
    from_, to = F.coalesce(before.cast("string"), F.lit("NA")), F.coalesce(after.cast("string"), F.lit("NA"))
    counted = cut(wide.groupBy(*group, from_.alias("_a"), to.alias("_b")).agg(F.count("*").alias("_n")), "pairs")
    pairs = sorted((r["_a"], r["_b"]) for r in counted.select("_a", "_b").distinct().limit(most_pairs + 1).collect())
    names = [f"{a}_{b}".replace(" ", "_") for a, b in pairs]
    if len(pairs) > most_pairs or len(set(names)) < len(names):
        raise ValueError(f"more than {most_pairs} pairs of classes, or two pairs of one name")
    columns = [total(F.when((F.col("_a") == a) & (F.col("_b") == b), F.col("_n"))).alias(n) for (a, b), n in zip(pairs, names)]
    return counted.groupBy(*group).agg(*columns)


def stock_ratio(df: DataFrame, area: Sequence[str], period: str, first, second) -> DataFrame:
    """Units per area in two periods, and the later count over the earlier; no units gives NULL."""
    names = {p: f"n_{p}" for p in (first, second)}
    counts = [F.nullif(F.count_if(F.col(period) == p), F.lit(0)).alias(n) for p, n in names.items()]
    rows = df.where(F.col(period).isin(first, second)).groupBy(*area).agg(*counts)
    return rows.withColumn("stock_ratio", ratio(F.col(names[second]), F.col(names[first])))


def pair_column(columns: Mapping[str, str] | Sequence[str], separator: str = "_") -> Column:
    """Text key of several columns."""
    return F.concat_ws(separator, *[F.col(c) for c in columns])
