"""Least squares with a text regressor of any number of levels, whose coefficients stay a table.

The normal equations of a text's indicators and a few other columns are shaped like an arrow: a diagonal of counts, one row of
sums for each level, and a small corner. Eliminating the levels first fills nothing in, so a level is one row (count and sums)
instead of a column, the corner is what absorbing the text leaves, and each level's coefficient and error follow from its row.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellwright.functions.tails import t_two_sided
from cellwright.operators.design import Term
from cellwright.operators.estimate import FIT_SCHEMA, fit_pass
from cellwright.session import in_tasks


def _with_p_values(df_t: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = [None if t is None else t_two_sided(t, df_t) for t in batch.column("statistic").to_pylist()]
            columns = [*batch.columns[:5], pa.array(p, pa.float64()), batch.column("n")]
            yield pa.RecordBatch.from_arrays(columns, ["outcome", "term", "estimate", "std_error", "statistic", "p_value", "n"])

    return run


def ols_with_levels(df: DataFrame, outcome: str, terms: Sequence[Term], text: str) -> DataFrame:
    """The coefficient table of ``outcome`` on a constant, ``terms`` and the levels of ``text``, with plain errors.

    It is that of ``ols`` with ``text`` among the terms: levels are set against the first one in order, and a term that the
    levels and the terms before it span is left out. Rows with a missing value are left out. Nothing of a level reaches the
    driver but the first one's row.
    """
    shared = fit_pass(df, outcome, terms, absorb=[text])
    fit = shared.fit(outcome, "iid", None)
    layout = shared.layouts[outcome]
    degrees = fit.n - fit.n_params
    spread = fit.stats["rmse"] ** 2 * fit.n / degrees if degrees > 0 else float("nan")
    short = dict(zip(layout.terms, layout.regressors))

    def mean(name: str, column: str) -> Column:
        return F.col(f"s_{column}") / F.col("n") * F.lit(layout.scale[name]) + F.lit(layout.center[name])

    means = {f"x{i}": mean(t, short[t]) for i, t in enumerate(fit.terms)}
    level = mean(outcome, layout.y)
    for i, b in enumerate(fit.coef):
        level = level - F.lit(float(b)) * means[f"x{i}"]
    rows = shared.cells.select(F.col(text).cast("string").alias("level"), F.col("n").alias("size"), level.alias("value"), *[m.alias(x) for x, m in means.items()])
    first = rows.orderBy("level").first()
    off = {x: F.col(x) - F.when(F.col("level") == first["level"], 0.0).otherwise(F.lit(float(first[x]))) for x in means}
    variance = F.lit(spread) * (1 / F.col("size") + F.when(F.col("level") == first["level"], 0.0).otherwise(F.lit(1 / first["size"])))
    for i in range(len(fit.terms)):
        for j in range(len(fit.terms)):
            variance = variance + F.lit(float(fit.vcov[i, j])) * off[f"x{i}"] * off[f"x{j}"]
    is_first = F.col("level") == first["level"]
    of_levels = rows.select(
        F.lit(outcome).alias("outcome"),
        F.when(is_first, "(Intercept)").otherwise(F.concat(F.lit(text), "level")).alias("term"),
        (F.col("value") - F.when(is_first, 0.0).otherwise(F.lit(float(first["value"])))).alias("estimate"),
        F.sqrt(variance).alias("std_error"),
    )
    spark = df.sparkSession
    others = [(outcome, t, float(b), float(s)) for t, b, s in zip(fit.terms, fit.coef, fit.std_error)]
    if others:
        of_levels = of_levels.unionByName(spark.createDataFrame(others, "outcome string, term string, estimate double, std_error double"))
    whole = of_levels.select("*", F.try_divide("estimate", "std_error").alias("statistic"), F.lit(fit.n).cast("bigint").alias("n"))
    return in_tasks(whole, _with_p_values(fit.df_t), FIT_SCHEMA)
