import os

import pytest
from pyspark.sql import functions as F

from cellwright import session


def test_cut_writes_below_the_shared_folder(spark):
    root = session.scratch_root(spark)
    assert root == spark.conf.get("spark.checkpoint.dir", root)
    df = spark.range(5).select("id", F.col("id").cast("string").alias("s"))
    stored = session.cut(df, "mine")
    assert stored.dtypes == df.dtypes and sorted(stored.collect()) == sorted(df.collect())
    assert [n for n in os.listdir(root) if n.startswith("mine-")]
    assert session.scratch_path(spark, "a") != session.scratch_path(spark, "a")


def test_a_cluster_must_name_the_folder():
    class Conf:
        def get(self, key, default=None):
            return default

    class Context:
        master = "yarn"
        applicationId = "app"

    class Session:
        conf = Conf()
        sparkContext = Context()

    with pytest.raises(ValueError):
        session.scratch_root(Session())
