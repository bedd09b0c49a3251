"""Session settings shared by tests, the benchmark and the driver entry."""

from __future__ import annotations

import os
import tempfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

ROOT = str(Path(__file__).resolve().parent.parent)


def build(app: str = "galleon", master: str | None = None, partitions: int | None = None, **conf: str) -> SparkSession:
    """A session with adaptive execution, UTC and Arrow; ``conf`` keys use ``__`` for dots."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    }
    if partitions:
        settings["spark.sql.shuffle.partitions"] = str(partitions)
    settings |= {k.replace("__", "."): v for k, v in conf.items()}
    return b.config(map=settings).getOrCreate()


def share_package(spark: SparkSession) -> None:
    """Let Python workers import this package where it is not installed on them."""
    env = spark.sparkContext.environment
    paths = env.get("PYTHONPATH", "").split(os.pathsep)
    if ROOT not in paths:
        env["PYTHONPATH"] = os.pathsep.join([ROOT, *filter(None, paths)])


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder that the session names.  Where none is set: a temporary one in local
    mode, a folder of the warehouse, which all executors share, on a cluster."""
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        own = tempfile.mkdtemp(prefix="galleon-") if sc.master.startswith("local") else f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/galleon-cuts"
        sc.setCheckpointDir(sc.getConf().get("spark.checkpoint.dir") or own)
    return sc.getCheckpointDir()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the Parquet tables of a data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
