import pytest
from pyspark.sql import functions as F

from cellwright.streaming.group_stats import group_stats, merge_runs, read_group_stats, store_step, stream_group_stats


def write(spark, lo, hi, folder):
    spark.range(lo, hi).select((F.col("id") % 3).alias("g"), F.col("id").cast("double").alias("v")).coalesce(1).write.mode("append").parquet(folder)


def test_files_that_arrive_later_are_added(spark, tmp_path):
    folder, state, out = (str(tmp_path / n) for n in ("in", "state", "out"))
    write(spark, 0, 50, folder)
    schema = spark.read.parquet(folder).schema
    first = stream_group_stats(spark, folder, schema, ["g"], "v", state_path=state, output_path=out, files_per_step=1)
    assert first.agg(F.sum("n")).first()[0] == 50
    write(spark, 50, 120, folder)
    second = {r["g"]: r for r in stream_group_stats(spark, folder, schema, ["g"], "v", state_path=state, output_path=out, files_per_step=1).collect()}
    batch = {r["g"]: r for r in group_stats(spark.read.parquet(folder), ["g"], "v").collect()}
    for g, r in batch.items():
        assert second[g]["n"] == r["n"] and second[g]["total"] == r["total"]
        assert second[g]["mean"] == pytest.approx(r["mean"]) and second[g]["var"] == pytest.approx(r["var"])


def test_separate_runs_merge(spark, tmp_path):
    a, b = str(tmp_path / "a"), str(tmp_path / "b")
    write(spark, 0, 40, a)
    write(spark, 40, 41, b)
    runs = [group_stats(spark.read.parquet(p), ["g"], "v") for p in (a, b)]
    merged = {r["g"]: r for r in merge_runs(runs, ["g"]).collect()}
    whole = group_stats(spark.read.parquet(a, b), ["g"], "v").collect()
    for r in whole:
        assert merged[r["g"]]["n"] == r["n"] and merged[r["g"]]["var"] == pytest.approx(r["var"])


def test_no_file_yet_gives_an_empty_result(spark, tmp_path):
    folder, state, out = (str(tmp_path / n) for n in ("in", "state", "out"))
    (tmp_path / "in").mkdir()
    schema = spark.range(1).select((F.col("id") % 3).alias("g"), F.col("id").cast("double").alias("v")).schema
    found = stream_group_stats(spark, folder, schema, ["g"], "v", state_path=state, output_path=out)
    assert found.count() == 0 and found.columns == ["g", "n", "total", "mean", "var"]
    write(spark, 0, 30, folder)
    assert stream_group_stats(spark, folder, schema, ["g"], "v", state_path=state, output_path=out).agg(F.sum("n")).first()[0] == 30


def test_a_step_run_twice_counts_once(spark, tmp_path):
    out = str(tmp_path / "out")
    rows = spark.createDataFrame([("a", 1e9 + i) for i in range(9)] + [("b", None), (None, 4.0)], "g string, v double")
    for step in (0, 1, 1, 0):
        store_step(rows, step, ["g"], "v", out)
    (tmp_path / "out" / "step=2").mkdir()  # a step that ended before its files were complete
    found = {r["g"]: r for r in read_group_stats(spark, out, rows.schema, ["g"], "v").collect()}
    assert (found["a"]["n"], found["b"]["n"], found[None]["n"]) == (18, 0, 2)
    assert found["a"]["var"] == pytest.approx(2 * 60 / 17) and found["b"]["mean"] is None and found["b"]["total"] is None
    store_step(rows, 2, ["g"], "v", out)
    assert read_group_stats(spark, out, rows.schema, ["g"], "v").agg(F.sum("n")).first()[0] == 30
