"""Tables: scans, generated test tables, guarded loads, CSV and view sinks, stage tables."""

from __future__ import annotations

import os
from collections.abc import Sequence

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from cellwright.operators.filters import first_per_key
from cellwright.operators.joins import label_codes, lookup_join


def read_table(spark: SparkSession, source: str) -> DataFrame:
    """A Parquet path or the name of a table or view, read lazily."""
    if os.sep in source or source.endswith(".parquet"):
        return spark.read.parquet(source)
    return spark.table(source)


def random_table(spark: SparkSession, n: int, groups: int = 3, seed: int = 1, digits: int = 2) -> DataFrame:
    """``n`` rows of a normal variable ``x`` and a group number ``g`` from 1."""
    return spark.range(n).select(
        "id",
        F.bround(F.randn(seed), digits).alias("x"),
        (F.floor(F.rand(seed + 1) * groups) + 1).cast("int").alias("g"),
    )


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether a finished Parquet table is at ``path``; a table left unfinished by a failed job does not count."""
    jvm = spark.sparkContext._jvm
    marker = jvm.org.apache.hadoop.fs.Path(path, "_SUCCESS")
    return marker.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(marker)


def holds_files(spark: SparkSession, path: str) -> bool:
    """Whether data files lie in the folder ``path``; what a failed write leaves, in hidden names, does not count."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    files = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return files.exists(folder) and any(f.getPath().getName()[0] not in "._" for f in files.listStatus(folder))


def load_table(
    df: DataFrame, path: str, replace: bool = False, keep: Sequence[tuple[str, Sequence]] = ()
) -> tuple[DataFrame, int | None]:
    """Write ``df`` to ``path`` once and return the stored table with the number of rows written.

    A finished table is kept unless ``replace``; the count is then None. Rows are counted while they
    are written. ``keep`` lists (column, values) filters, which hold for every row. The write commits
    as a whole, so a failed load leaves no table behind. Without ``replace``, a folder that holds files but no
    mark of a finished write is an error: nothing in it is deleted.
    """
    spark = df.sparkSession
    if path_exists(spark, path) and not replace:
        return spark.read.parquet(path), None
    if not replace and holds_files(spark, path):
        raise FileExistsError(f"{path} holds files without a mark of a finished write; name replace=True to overwrite them")
    for column, values in keep:
        df = df.where(F.col(column).isin(list(values)))
    seen = Observation("load")
    df.observe(seen, F.count(F.lit(1)).alias("rows")).write.mode("overwrite").parquet(path)
    return spark.read.parquet(path), seen.get["rows"]


def load_catalog_table(
    df: DataFrame, name: str, replace: bool = False, keep: Sequence[tuple[str, Sequence]] = ()
) -> tuple[DataFrame, int | None]:
    """As ``load_table``, for a table of the session catalog."""
    spark = df.sparkSession
    if spark.catalog.tableExists(name) and not replace:
        return spark.table(name), None
    for column, values in keep:
        df = df.where(F.col(column).isin(list(values)))
    seen = Observation("load")
    df.observe(seen, F.count(F.lit(1)).alias("rows")).write.mode("overwrite" if replace else "errorifexists").saveAsTable(name)
    return spark.table(name), seen.get["rows"]


def write_labelled_csv(df: DataFrame, path: str, labels: DataFrame | None = None, columns: Sequence[str] = ()) -> None:
    """Write CSV with a header, the coded columns replaced by their labels."""
    if labels is not None:
        order = df.columns
        df = label_codes(df, labels, columns)
        df = df.drop(*columns).withColumnsRenamed({f"{c}_label": c for c in columns}).select(*order)
    df.write.mode("overwrite").csv(path, header=True, nullValue="NA")


def as_view(df: DataFrame, name: str) -> DataFrame:
    """Register a temporary view and return it."""
    df.createOrReplaceTempView(name)
    return df.sparkSession.table(name)


def read_dictionary(spark: SparkSession, path: str, schema: str = "code string, value int, label string") -> DataFrame:
    """A code dictionary from CSV, with the line order in ``prio``. Long code lists are kept as such files."""
    return spark.read.csv(path, header=True, schema=schema, nullValue="NA").withColumn("prio", F.monotonically_increasing_id())


def settle_dictionary(dictionary: DataFrame, code: str = "code", prio: str = "prio") -> tuple[DataFrame, DataFrame]:
    """The dictionary with the first entry of every code, and the entries that it hides."""
    first = first_per_key(dictionary, [code], [prio])
    kept = first.select(F.col(code).alias("_code"), F.col(prio).alias("_prio"))
    marked = lookup_join(dictionary, kept, {code: "_code"})
    return first.drop(prio), marked.where(F.col("_prio") != F.col(prio)).drop("_prio")
