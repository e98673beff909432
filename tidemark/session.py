"""Session defaults of the engine."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

#: Settings that hold at every scale; sizes of memory and partitions stay with the cluster.
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.ansi.enabled": "true",
}


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; where it is unset, a folder of this machine, if all runs on it."""
    known = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("tidemark.folder", None)
    if not known:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        known = tempfile.mkdtemp(prefix="tidemark-")
        spark.conf.set("tidemark.folder", known)
    return known.rstrip("/")


def local_session(cores: int | None = None, shuffle_partitions: int = 8, memory: str = "4g") -> SparkSession:
    """A session on this machine, for tests and bench.py."""
    cores = cores or int(os.environ.get("BENCH_CPUS", "8"))
    builder = SparkSession.builder.master(f"local[{cores}]").appName("tidemark").config(map=DEFAULTS)
    builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    builder = builder.config("spark.driver.memory", memory).config("spark.ui.enabled", "false")
    spark = builder.config("spark.ui.showConsoleProgress", "false").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark
