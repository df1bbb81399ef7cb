"""Group statistics kept up to date as files arrive in a folder."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.functions import try_divide
from pyspark.sql.types import StructType

from cellwright.operators.moments import pooled_moments
from cellwright.session import scratch_path


def read_arriving(
    spark: SparkSession, folder: str, schema: StructType, pattern: str | None = None, files_per_step: int | None = None
) -> DataFrame:
    """A folder of Parquet files as a stream."""
    reader = spark.readStream.schema(schema).format("parquet")
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    if files_per_step:
        reader = reader.option("maxFilesPerTrigger", files_per_step)
    return reader.load(folder)


def group_stats(rows: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Count, sum, mean and variance of a column by group; works on a stream and on a table."""
    return rows.groupBy(*keys).agg(
        F.count(value).alias("n"),
        F.sum(value).alias("total"),
        F.avg(value).alias("mean"),
        F.var_samp(value).alias("var"),
    )


def _steps(spark: SparkSession, output_path: str) -> dict[int, str]:
    """The finished steps of a result: number and folder. A step counts once its files are all there."""
    root = spark._jvm.org.apache.hadoop.fs.Path(output_path)
    files = root.getFileSystem(spark._jsc.hadoopConfiguration())
    found = {}
    for status in files.listStatus(root) if files.exists(root) else []:
        name = status.getPath().getName()
        if name.startswith("step=") and files.exists(spark._jvm.org.apache.hadoop.fs.Path(status.getPath(), "_SUCCESS")):
            found[int(name.removeprefix("step="))] = status.getPath().toString()
    return found


def partial_stats(rows: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Count, sum, mean and sum of squared distances from the mean by group, of rows that came together."""
    known = F.count(value)
    return rows.groupBy(*keys).agg(
        known.alias("n"), F.sum(value).alias("total"), F.avg(value).alias("mean"), (F.var_pop(value) * known).alias("m2")
    )


def store_step(rows: DataFrame, step: int, keys: Sequence[str], value: str, output_path: str) -> None:
    """Write what one step adds, under its number. A step that is run again finds itself done and adds nothing."""
    if step not in _steps(rows.sparkSession, output_path):
        partial_stats(rows, keys, value).write.mode("overwrite").parquet(f"{output_path}/step={step}")


def read_group_stats(spark: SparkSession, output_path: str, schema: StructType, keys: Sequence[str], value: str) -> DataFrame:
    """The statistics of all finished steps, merged. Steps are only ever added, so a reader always finds a whole result;
    before the first one it is empty. ``schema`` is that of the rows."""
    partial = partial_stats(spark.createDataFrame([], schema), keys, value)
    steps = _steps(spark, output_path)
    if steps:
        partial = spark.read.schema(partial.schema).parquet(*[steps[k] for k in sorted(steps)])
    group = W.partitionBy(*keys)
    known = partial.withColumn("_mean", try_divide(F.sum("total").over(group), F.sum("n").over(group)))
    around = F.coalesce(F.col("m2") + F.col("n") * (F.col("mean") - F.col("_mean")) ** 2, F.lit(0.0))
    merged = known.groupBy(*keys).agg(F.sum("n").alias("n"), F.sum("total").alias("total"), F.first("_mean").alias("mean"), F.sum(around).alias("_m2"))
    return merged.withColumn("var", F.when(F.col("n") > 1, F.col("_m2") / (F.col("n") - 1))).drop("_m2")


def run_available(stream: DataFrame, keys: Sequence[str], value: str, state_path: str, output_path: str) -> None:
    """Process the rows that have arrived and stop. Every step adds its partial statistics to ``output_path``; the
    progress lives in ``state_path``, so a later call goes on from there. No group is kept between steps."""

    def store(rows: DataFrame, step: int) -> None:
        store_step(rows, step, keys, value, output_path)

    query = stream.writeStream.option("checkpointLocation", state_path).trigger(availableNow=True).foreachBatch(store).start()
    query.awaitTermination()


def stream_group_stats(
    spark: SparkSession,
    folder: str,
    schema: StructType,
    keys: Sequence[str],
    value: str,
    pattern: str | None = None,
    state_path: str | None = None,
    output_path: str | None = None,
    files_per_step: int | None = None,
) -> DataFrame:
    """Statistics of everything that has arrived in ``folder`` so far."""
    state_path = state_path or scratch_path(spark, "stream-state")
    output_path = output_path or scratch_path(spark, "stream-result")
    run_available(read_arriving(spark, folder, schema, pattern, files_per_step), keys, value, state_path, output_path)
    return read_group_stats(spark, output_path, schema, keys, value)


def merge_runs(runs: Sequence[DataFrame], keys: Sequence[str]) -> DataFrame:
    """One result from the results of separate runs over separate files."""
    stacked = runs[0]
    for run in runs[1:]:
        stacked = stacked.unionByName(run)
    return pooled_moments(stacked, keys, "n", "mean", "var")
