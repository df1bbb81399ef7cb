"""Session defaults, and the one place where intermediate tables are written."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

_local_scratch: dict[str, str] = {}


def build_session(app: str = "cellwright", master: str | None = None, **conf: object) -> SparkSession:
    """A session with the settings the operators expect. ``conf`` wins over the defaults."""
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        # Files unpack to several times their size; size estimates should say so before a broadcast.
        "spark.sql.sources.fileCompressionFactor": "4",
        **{key: str(value) for key, value in conf.items()},
    }
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def scratch_root(spark: SparkSession) -> str:
    """The shared folder for intermediate tables: ``spark.checkpoint.dir`` of the session.

    Only a session whose tasks run in the driver may do without it; it then gets a temporary folder of its own.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        return shared
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that every executor can reach")
    app = spark.sparkContext.applicationId
    if app not in _local_scratch:
        _local_scratch[app] = tempfile.mkdtemp(prefix="cellwright-")
    return _local_scratch[app]


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new, unused path under the shared folder."""
    return os.path.join(scratch_root(spark), f"{label}-{uuid.uuid4().hex}")


def cut(df: DataFrame, label: str = "stage", path: str | None = None) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.

    This ends the lineage, survives the loss of executors, keeps the data columnar and gives the
    optimizer a true size for the table.
    """
    spark = df.sparkSession
    path = path or scratch_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def in_tasks(df: DataFrame, run: Callable, schema: str) -> DataFrame:
    """``df.mapInArrow`` with this package on the import path of the Python workers (where it is at the same place)."""
    environment = df.sparkSession.sparkContext.environment
    path = environment.get("PYTHONPATH", "")
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    if root not in path.split(os.pathsep):
        environment["PYTHONPATH"] = os.pathsep.join(filter(None, [path, root]))
    return df.mapInArrow(run, schema)
