"""Sessions: settings for local runs, and this package on the executors."""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once for each application, so that Python functions can be loaded there."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    root = Path(__file__).resolve().parent
    folder = tempfile.mkdtemp(prefix="variorum-")
    shutil.copytree(root, os.path.join(folder, "package", root.name), ignore=shutil.ignore_patterns("__pycache__"))
    context.addPyFile(shutil.make_archive(os.path.join(folder, root.name), "zip", os.path.join(folder, "package")))
    _shipped.add(context.applicationId)


def stored(rows: DataFrame, label: str) -> DataFrame:
    """rows written as Parquet to the folder that all executors share (``spark.checkpoint.dir``) and read back.

    Lineage ends there: later plans stay small, and a lost executor costs none of the work before. Only a session on one
    machine that names no folder gets a temporary one.
    """
    spark = rows.sparkSession
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = "file://" + tempfile.mkdtemp(prefix="variorum-")
        spark.sparkContext.setCheckpointDir(root)
    path = f"{root.rstrip('/')}/variorum-{label}-{uuid.uuid4().hex}"
    rows.write.parquet(path)
    return spark.read.schema(rows.schema).parquet(path)


def local_session(cores: int | str = 8, **settings: str) -> SparkSession:
    """A session for tests and benchmarks on one machine."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName("variorum")
    defaults = {
        "spark.sql.shuffle.partitions": "8",
        "spark.sql.session.timeZone": "UTC",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": "8g",
    }
    for key, value in (defaults | settings).items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ship(spark)
    return spark
