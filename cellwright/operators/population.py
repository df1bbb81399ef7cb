"""Population summary by class and exposure status, in one plan."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellwright.functions.numeric import count_where, ratio
from cellwright.operators.cells import attach_propensity


def cell_summary(
    df: DataFrame, keys: Sequence[str], conditions: Mapping[str, Column], measures: Sequence[str]
) -> DataFrame:
    """Per cell: rows, rows that meet each condition, and count, mean and variance of each measure."""
    columns = [F.count("*").alias("n_cell")]
    columns += [count_where(c).alias(f"c_{name}") for name, c in conditions.items()]
    for m in measures:
        columns += [F.count(m).alias(f"k_{m}"), F.avg(m).alias(f"m_{m}"), F.var_samp(m).alias(f"v_{m}")]
    return df.groupBy(*keys).agg(*columns)


def pool_cells(
    cells: DataFrame,
    by: Sequence[str],
    conditions: Sequence[str],
    measures: Sequence[str],
    centers: Mapping[str, float] | None = None,
) -> DataFrame:
    """Pool cell summaries: total rows, share meeting each condition, pooled mean and variance."""
    centers = centers or {}
    sums = [F.sum("n_cell").alias("n")]
    sums += [F.sum(f"c_{c}").alias(f"_c_{c}") for c in conditions]
    for m in measures:
        k, mean, var = F.col(f"k_{m}").cast("double"), F.col(f"m_{m}"), F.col(f"v_{m}")
        shift = mean - F.lit(float(centers.get(m, 0.0)))
        within = (k - 1) * F.coalesce(var, F.lit(0.0))
        sums += [
            F.sum(f"k_{m}").alias(f"_k_{m}"),
            F.sum(k * shift).alias(f"_s_{m}"),
            F.sum(F.when(k > 0, within + k * shift * shift)).alias(f"_q_{m}"),
        ]
    pooled = cells.groupBy(*by).agg(*sums)
    columns = [F.col("n")]
    columns += [ratio(F.col(f"_c_{c}"), F.col("n")).alias(c) for c in conditions]
    for m in measures:
        k, s, q = F.col(f"_k_{m}"), F.col(f"_s_{m}"), F.col(f"_q_{m}")
        shift = ratio(s, k)
        columns.append((shift + F.lit(float(centers.get(m, 0.0)))).alias(f"mean_{m}"))
        columns.append(F.when(k > 1, F.greatest(q - s * shift, F.lit(0.0)) / (k - 1)).alias(f"var_{m}"))
    return pooled.select(*by, *columns)


def population_summary(
    df: DataFrame,
    cells: DataFrame,
    keys: Sequence[str],
    by_class: Sequence[str],
    conditions: Mapping[str, Column],
    measures: Sequence[str],
    required: Sequence[str] = (),
    coarse: Mapping[str, tuple[str, Column]] | None = None,
    threshold: float = 0.5,
    centers: Mapping[str, float] | None = None,
) -> DataFrame:
    """Summarise all rows per cell, attach the cell's propensity to the summary, and pool by class and
    exposure. The rows are read once and shuffled only as cell summaries."""
    if required:
        df = df.dropna(subset=list(required))
    summary = cell_summary(df, keys, conditions, measures)
    exposed = attach_propensity(summary, cells, keys, coarse, threshold)
    return pool_cells(exposed, [*by_class, "exposed"], list(conditions), measures, centers)
