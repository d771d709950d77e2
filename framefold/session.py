"""Session defaults.  A cluster's own settings always win: these are only used by bench.py and the tests."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def reachable(spark: SparkSession) -> SparkSession:
    """Lets Python workers find this package where it lies now, whatever the working directory.

    That does for one machine, or a path that all share; other clusters get the package by --py-files.
    """
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    known = spark.sparkContext.environment.get("PYTHONPATH", "")
    if root not in known.split(os.pathsep):
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join(filter(None, (root, known)))
    return spark


def local_session(cpus: int = 8, name: str = "framefold", **extra: str) -> SparkSession:
    """A single-JVM session with adaptive execution, UTC and as many shuffle partitions as cores."""
    conf = {
        "spark.sql.shuffle.partitions": str(cpus),
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": os.environ.get("FRAMEFOLD_DRIVER_MEMORY", "8g"),
        **extra,
    }
    builder = SparkSession.builder.master(f"local[{cpus}]").appName(name)
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return reachable(spark)
