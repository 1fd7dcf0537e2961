"""Session defaults and the places a job may write to."""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import SparkSession

LOCAL = "file://" + os.path.join(tempfile.gettempdir(), "notelake-shared")
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
}


def build(master: str = "local[8]", app: str = "notelake", **conf: str) -> SparkSession:
    """A session for local runs and tests; a cluster passes its own session to the operators."""
    builder = SparkSession.builder.master(master).appName(app)
    for key, value in {**DEFAULTS, "spark.checkpoint.dir": LOCAL, "spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", **conf}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return ship(spark)


_shipped: set[str] = set()


def ship(spark: SparkSession) -> SparkSession:
    """Let the executors' Python workers import this package, once per application."""
    app = spark.sparkContext.applicationId
    if app not in _shipped:
        _shipped.add(app)
        here = Path(__file__).parent
        archive = shutil.make_archive(os.path.join(tempfile.mkdtemp(), here.name), "zip", here.parent, here.name)
        spark.sparkContext.addPyFile(archive)  # served to the executors by the driver
    return spark


def _filesystem(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def _scratch(spark: SparkSession) -> str:
    """The application's own folder below the shared one that the cluster names in spark.checkpoint.dir.

    Only where that setting is absent (a session that was not made by ``build``) a local temporary folder takes its place.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or LOCAL
    return f"{base.rstrip('/')}/notelake-{spark.sparkContext.applicationId}"


_made: set[str] = set()


def shared_dir(spark: SparkSession, what: str) -> str:
    """A fresh folder that all executors share; it goes when the application ends, or with ``clear``."""
    root = _scratch(spark)
    if root not in _made:
        _made.add(root)
        fs, where = _filesystem(spark, root)
        fs.mkdirs(where)
        fs.deleteOnExit(where)
    return f"{root}/{what}-{uuid.uuid4().hex}"


def clear(spark: SparkSession) -> None:
    """Delete what the queries so far have written on the way; frames that read it must not be used any more."""
    root = _scratch(spark)
    if root in _made:
        fs, where = _filesystem(spark, root)
        fs.delete(where, True)
        fs.mkdirs(where)


def cut_lineage(df, what: str):
    """Write df to the shared folder and read it back: a cut that survives the loss of an executor."""
    path = shared_dir(df.sparkSession, what)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def forget(df) -> None:
    """Delete what ``cut_lineage`` has written for df; neither it nor what still reads it may be used any more."""
    files = df.inputFiles()
    if files:
        fs, where = _filesystem(df.sparkSession, files[0])
        fs.delete(where.getParent(), True)
