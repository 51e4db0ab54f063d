"""Session settings that the engine needs, and how its Python code reaches the workers."""

from __future__ import annotations

import os
from pathlib import Path

from pyspark.sql import SparkSession

ROOT = str(Path(__file__).resolve().parent.parent)


def ship(spark: SparkSession) -> SparkSession:
    """Let the Python workers import this package where the driver found it.

    A cluster gets the package with --py-files or an installed wheel; where driver and executors share a
    machine or an image, as in local mode, the driver's own path is enough.
    """
    env = spark.sparkContext.environment
    have = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if ROOT not in have:
        env["PYTHONPATH"] = os.pathsep.join([*have, ROOT])
    return spark


def checkpoints(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir.

    Where none is set, a folder of this machine is used if driver and tasks share it (master local); elsewhere tasks would write where
    nobody reads, so that is an error.
    """
    context = spark.sparkContext
    base = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not base:
        if not (context.master == "local" or context.master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = "/tmp/checkpoints/tidegraph"
    if not context.getCheckpointDir():
        context.setCheckpointDir(base)
    return base.rstrip("/")


def local_session(app: str = "tidegraph", cpus: int | str = "*", shuffle: int = 8, memory: str = "8g") -> SparkSession:
    """A session for tests and benchmarks on one machine."""
    return ship(
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
