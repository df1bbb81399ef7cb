"""Tables for reports: cross-tabs, shares, balance and level tables, histograms, densities, fitted lines."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellwright.functions.numeric import ratio, total
from cellwright.operators.joins import lookup_join
from cellwright.session import cut


def column_name(value: object) -> str:
    return "".join(ch if ch.isalnum() else "_" for ch in str(value))


def crosstab(
    df: DataFrame, rows: Sequence[str], column: str, levels: Sequence | None = None, with_total: bool = False, prefix: str = ""
) -> DataFrame:
    """Counts by row keys and one column per level; the total counts every row, other levels too.

    Without ``levels``, all those found in the data, in ascending order; a missing value is counted in the total alone.
    """
    if levels is None:
        found = df.select(F.col(column).alias("level")).where("level IS NOT NULL").distinct().orderBy("level")
        levels = [r["level"] for r in found.collect()]
    counts = [F.count_if(F.col(column) == level).alias(prefix + column_name(level)) for level in levels]
    if with_total:
        counts.append(F.count("*").alias("total"))
    return df.groupBy(*rows).agg(*counts)


def shares(df: DataFrame, keys: Sequence[str], within: Sequence[str] = (), name: str = "share") -> DataFrame:
    """Counts per key and their share of all rows, or of the rows with the same ``within`` keys."""
    counts = df.groupBy(*within, *[k for k in keys if k not in within]).agg(F.count("*").alias("n"))
    if not within:
        return counts.withColumn(name, ratio(F.col("n"), counts.agg(F.sum("n")).scalar()))
    counts = cut(counts, "counts")
    whole = counts.groupBy(*within).agg(F.sum("n").alias("_whole"))
    return lookup_join(counts, whole, within).withColumn(name, ratio(F.col("n"), F.col("_whole"))).drop("_whole")


def compare_sources(
    first: DataFrame, second: DataFrame, keys: Sequence[str], names: tuple[str, str] = ("first", "second")
) -> DataFrame:
    """Counts of two sources side by side with difference and ratio (first to second).

    A key that one source lacks has NULL on that side, and so has no difference.
    """
    source = "_source"
    both = stack_sources({names[0]: first.select(*keys), names[1]: second.select(*keys)}, source)
    sides = [F.nullif(F.count_if(F.col(source) == s), F.lit(0)).alias(s) for s in names]
    table = both.groupBy(*keys).agg(*sides)
    a, b = F.col(names[0]), F.col(names[1])
    return table.withColumn("difference", a - b).withColumn("ratio", ratio(a, b))


def stack_sources(frames: Mapping[str, DataFrame], tag: str = "source") -> DataFrame:
    """Stack tables by column name with a column that says where a row came from; absent columns are NULL."""
    stacked = None
    for name, frame in frames.items():
        tagged = frame.withColumn(tag, F.lit(name))
        stacked = tagged if stacked is None else stacked.unionByName(tagged, allowMissingColumns=True)
    return stacked


def balance_table(df: DataFrame, group: str, levels: tuple, measures: Sequence[str]) -> DataFrame:
    """Mean and standard deviation of each measure in two groups, difference of means (second minus
    first) and its standard error. One aggregate over the rows, laid out one row per measure."""
    aggregates = []
    for m in measures:
        for i, level in enumerate(levels):
            value = F.when(F.col(group) == level, F.col(m).cast("double"))
            aggregates += [
                F.count(value).alias(f"n{i}_{m}"),
                F.avg(value).alias(f"mean{i}_{m}"),
                F.var_samp(value).alias(f"var{i}_{m}"),
            ]
    one = df.where(F.col(group).isin(list(levels))).agg(*aggregates)
    rows = [
        F.struct(F.lit(m).alias("measure"), *[F.col(f"{s}{i}_{m}").alias(f"{s}{i}") for i in (0, 1) for s in ("n", "mean", "var")])
        for m in measures
    ]
    table = one.select(F.inline(F.array(*rows)))
    return table.select(
        "measure",
        "n0",
        "mean0",
        F.sqrt("var0").alias("sd0"),
        "n1",
        "mean1",
        F.sqrt("var1").alias("sd1"),
        (F.col("mean1") - F.col("mean0")).alias("difference"),
        F.sqrt(ratio(F.col("var0"), F.col("n0")) + ratio(F.col("var1"), F.col("n1"))).alias("std_error"),
    )


def level_table(df: DataFrame, variables: Sequence[str], group: Sequence[str] = ()) -> DataFrame:
    """N and percent of every level of several coded variables, by group."""
    pairs = [F.struct(F.lit(v).alias("variable"), F.col(v).cast("string").alias("level")) for v in variables]
    long = df.select(*group, F.inline(F.array(*pairs)))
    counted = shares(long, [*group, "variable", "level"], [*group, "variable"])
    return counted.withColumn("pct", F.col("share") * 100).drop("share")


def histogram(df: DataFrame, value: str, width: float, start: float = 0.0, keys: Sequence[str] = ()) -> DataFrame:
    """Rows per bin of a fixed width, left ends closed, by facet. Missing values are left out."""
    number = F.floor((F.col(value) - F.lit(start)) / F.lit(width)).cast("bigint")
    counted = df.where(F.col(value).isNotNull()).groupBy(*keys, number.alias("bin")).agg(F.count("*").alias("n"))
    return counted.withColumn("low", F.col("bin") * F.lit(float(width)) + F.lit(float(start)))


def density_on_grid(
    df: DataFrame,
    value: str,
    low: float,
    high: float,
    points: int,
    bandwidth: float,
    bin_width: float,
    keys: Sequence[str] = (),
) -> DataFrame:
    """Gaussian kernel density at evenly spaced points, by facet.

    The rows are first counted in narrow bins about their centres, so the kernel runs over the bins. Values
    recorded in steps of ``bin_width`` keep their exact place.
    """
    centre = F.bround(F.col(value) / F.lit(bin_width), 0)
    present = df.where(F.col(value).isNotNull())
    binned = present.groupBy(*keys, centre.alias("_bin")).agg(F.count("*").alias("_n"))
    step = (high - low) / (points - 1)
    at = F.col("point") * F.lit(step) + F.lit(float(low))
    z = (at - F.col("_bin") * F.lit(bin_width)) / F.lit(float(bandwidth))
    spread = binned.withColumn("point", F.explode(F.sequence(F.lit(0), F.lit(points - 1))))
    kernel = F.exp(z * z * F.lit(-0.5)) * F.col("_n")
    summed = spread.groupBy(*keys, "point").agg(F.sum(kernel).alias("_k"), F.sum("_n").alias("n"))
    scale = F.lit(1.0 / (bandwidth * math.sqrt(2.0 * math.pi)))
    return summed.select(*keys, "point", at.alias("x"), "n", (F.col("_k") * scale / F.col("n")).alias("density"))


def fitted_line(df: DataFrame, y: str, x: str, keys: Sequence[str] = ()) -> DataFrame:
    """Least-squares line of y on x per facet."""
    return df.groupBy(*keys).agg(
        F.regr_count(y, x).alias("n"),
        F.regr_slope(y, x).alias("slope"),
        F.regr_intercept(y, x).alias("intercept"),
        F.regr_r2(y, x).alias("r2"),
    )


def match_rate(linked: DataFrame, population: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Linked units over all units per class."""
    sides = stack_sources({"linked": linked.select(*keys), "population": population.select(*keys)}, "_side")
    table = sides.groupBy(*keys).agg(
        F.count_if(F.col("_side") == "linked").alias("n_linked"),
        F.count_if(F.col("_side") == "population").alias("n_population"),
    )
    return table.withColumn("match_rate", ratio(F.col("n_linked"), F.col("n_population")))


def conditional_totals(df: DataFrame, keys: Sequence[str], conditions: Mapping[str, Column]) -> DataFrame:
    """Rows per group and how many meet each condition."""
    counted = [total(F.when(c, 1)).alias(name) for name, c in conditions.items()]
    return df.groupBy(*keys).agg(F.count("*").alias("n"), *counted)
