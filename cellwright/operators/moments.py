"""Means and variances, from rows and from partial results."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellwright.functions.numeric import ratio
from cellwright.operators.order import running_sums


def moment_columns(value: str, prefix: str | None = None) -> list[Column]:
    """Count of the present, mean, variance and standard deviation of a column."""
    p = prefix or value
    return [
        F.count(value).alias(f"n_{p}"),
        F.avg(value).alias(f"mean_{p}"),
        F.var_samp(value).alias(f"var_{p}"),
        F.stddev_samp(value).alias(f"sd_{p}"),
    ]


def group_moments(df: DataFrame, keys: Sequence[str], values: Sequence[str]) -> DataFrame:
    columns = [c for v in values for c in moment_columns(v)]
    return df.groupBy(*keys).agg(F.count("*").alias("n"), *columns)


def mean_band(df: DataFrame, value: str, width: float = 1.0) -> DataFrame:
    """Lower and upper edge of mean +/- ``width`` standard deviations, on top of ``group_moments``."""
    spread = F.col(f"sd_{value}") * F.lit(width)
    return df.withColumns({f"low_{value}": F.col(f"mean_{value}") - spread, f"high_{value}": F.col(f"mean_{value}") + spread})


def weighted_mean(weight: Column, value: Column) -> Column:
    """Weighted mean over the rows where the value is present."""
    return ratio(F.sum(F.when(value.isNotNull(), weight) * value), F.sum(F.when(value.isNotNull(), weight)))


def _part_sums(n: Column, mean: Column, var: Column, center: float) -> dict[str, Column]:
    """Additive sums of a part: count, first and second moment about ``center``. A missing variance is zero."""
    size = n.cast("double")
    shift = mean - F.lit(float(center))
    return {"_n": size, "_s": size * shift, "_q": (size - 1) * F.coalesce(var, F.lit(0.0)) + size * shift * shift}


def _whole(n: Column, s: Column, q: Column, center: float) -> dict[str, Column]:
    """Count, mean, variance and standard deviation from the sums. One observation has no variance."""
    shift = ratio(s, n)
    var = F.when(n > 1, F.greatest(q - s * shift, F.lit(0.0)) / (n - 1))
    return {"n": n.cast("bigint"), "mean": shift + F.lit(float(center)), "var": var, "sd": F.sqrt(var)}


def _usable(parts: DataFrame, n: str, drop_singletons: bool) -> DataFrame:
    return parts.where(F.col(n) > (1 if drop_singletons else 0))


def pooled_moments(
    parts: DataFrame,
    keys: Sequence[str],
    n: str,
    mean: str,
    var: str,
    drop_singletons: bool = False,
    center: float = 0.0,
) -> DataFrame:
    """Count, mean, variance and standard deviation of the whole from those of its parts.

    A part with one observation has no variance of its own and counts with zero, unless
    ``drop_singletons`` leaves it out. Where the means are very large against their spread, give a
    ``center`` near them; it does not change the result, only the digits kept.
    """
    sums = _part_sums(F.col(n), F.col(mean), F.col(var), center)
    merged = _usable(parts, n, drop_singletons).groupBy(*keys).agg(*[F.sum(c).alias(k) for k, c in sums.items()])
    result = _whole(F.col("_n"), F.col("_s"), F.col("_q"), center)
    return merged.select(*keys, *[c.alias(k) for k, c in result.items()])


def running_moments(
    parts: DataFrame,
    order: Sequence[str],
    n: str,
    mean: str,
    var: str,
    keys: Sequence[str] = (),
    drop_singletons: bool = False,
    center: float = 0.0,
) -> DataFrame:
    """The pooled moments of all parts up to and with each part, in order."""
    sums = _part_sums(F.col(n), F.col(mean), F.col(var), center)
    parts = _usable(parts, n, drop_singletons).select(*keys, *order, *[c.alias(k) for k, c in sums.items()])
    run = running_sums(parts, order, ["_n", "_s", "_q"], keys)
    result = _whole(F.col("run__n"), F.col("run__s"), F.col("run__q"), center)
    return run.select(*keys, *order, *[c.alias(k) for k, c in result.items()])
