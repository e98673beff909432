"""Reading the driver's tables with the engine's types."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import TimestampNTZType


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table; time stamps without a zone are UTC, and so is the session."""
    if spark.conf.get("spark.sql.session.timeZone") != "UTC":
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    zoned = {f.name: F.col(f.name).cast("timestamp") for f in df.schema if isinstance(f.dataType, TimestampNTZType)}
    return df.withColumns(zoned) if zoned else df
