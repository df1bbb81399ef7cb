"""Global numbering and running sums without a single-task window.

The table is range-sorted and written once with the position that each row has in its sorted split.
The splits are few, so their sizes fit in a lookup, and a row's rank is its split's start plus its place.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cellwright.operators.joins import lookup_join
from cellwright.session import cut


def last_null(column: str, descending: bool = False) -> Column:
    """Sort order with missing values at the end."""
    return F.desc_nulls_last(column) if descending else F.asc_nulls_last(column)


def sorted_splits(df: DataFrame, order: Sequence[Column]) -> DataFrame:
    """The table, stored in sorted order, with ``_split`` (number of the split) and ``_place`` (from 0)."""
    placed = df.orderBy(*order).withColumn("_id", F.monotonically_increasing_id())
    stored = cut(placed, "sorted")
    split = F.shiftright("_id", 33).cast("int")
    place = F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))
    return stored.withColumn("_split", split).withColumn("_place", place).drop("_id")


def number_rows(df: DataFrame, order: Sequence[Column], output: str = "rank") -> DataFrame:
    """Number the rows from 1 in the given order. End the order with a unique column to make it total."""
    stored = sorted_splits(df, order)
    sizes = stored.groupBy("_split").agg(F.count("*").alias("_size"))
    before = W.orderBy("_split").rowsBetween(W.unboundedPreceding, -1)
    starts = cut(sizes.select("_split", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_start")), "starts")
    numbered = lookup_join(stored, starts, ["_split"])
    return numbered.withColumn(output, F.col("_start") + F.col("_place") + 1).drop("_split", "_place", "_start")


def running_sums(df: DataFrame, order: Sequence[str], sums: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """Running sum of each column in ``sums`` up to and with the row, within ``keys``, as ``run_<name>``.

    ``order`` must be unique within the keys. Each sorted split is summed on its own; what came before
    is added from the split totals.
    """
    stored = sorted_splits(df, [*[F.col(k) for k in keys], *[F.col(c) for c in order]])
    parts = stored.groupBy(*keys, "_split").agg(*[F.sum(c).alias(f"_t_{c}") for c in sums])
    before = W.partitionBy(*keys).orderBy("_split").rowsBetween(W.unboundedPreceding, -1)
    offsets = parts.select(
        *keys, "_split", *[F.coalesce(F.sum(f"_t_{c}").over(before), F.lit(0)).alias(f"_o_{c}") for c in sums]
    )
    within = W.partitionBy(*keys, "_split").orderBy("_place").rowsBetween(W.unboundedPreceding, W.currentRow)
    local = stored.withColumns({f"_l_{c}": F.sum(c).over(within) for c in sums})
    joined = lookup_join(local, cut(offsets, "offsets"), [*keys, "_split"])
    added = joined.withColumns({f"run_{c}": F.col(f"_o_{c}") + F.col(f"_l_{c}") for c in sums})
    return added.drop("_split", "_place", *[f"_l_{c}" for c in sums], *[f"_o_{c}" for c in sums])


def top_rows(df: DataFrame, order: Sequence[Column], k: int) -> DataFrame:
    """The first ``k`` rows of an order, as a report asks for."""
    return df.orderBy(*order).limit(k)
