"""Event streams: windows, sessions and duplicates, each with a batch twin that gives the same rows."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.session import shared_folder


def tumbling(events: DataFrame, ts: str, length: str, by: list[str], late: str | None = None) -> DataFrame:
    """Rows and sum of value in each window. With late, a watermark lets a stream forget windows."""
    rows = events.withWatermark(ts, late) if late else events
    return rows.groupBy(F.window(ts, length), *by).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("value")).select(F.col("window.start").alias("start"), *by, "n", "value")


def sliding(events: DataFrame, ts: str, length: str, slide: str, by: list[str], late: str | None = None) -> DataFrame:
    rows = events.withWatermark(ts, late) if late else events
    return rows.groupBy(F.window(ts, length, slide), *by).agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("start"), *by, "n")


def sessions(events: DataFrame, ts: str, gap: str, by: list[str], late: str | None = None) -> DataFrame:
    rows = events.withWatermark(ts, late) if late else events
    return rows.groupBy(F.session_window(ts, gap), *by).agg(F.count(F.lit(1)).alias("n")).select(F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), *by, "n")


def first_of(events: DataFrame, keys: list[str], ts: str, late: str | None = None) -> DataFrame:
    """One row for each key: a stream keeps keys as long as the watermark."""
    return events.withWatermark(ts, late).dropDuplicatesWithinWatermark(keys) if late else events.dropDuplicates(keys)


def read(spark: SparkSession, folder: str, name: str, zone: Column | None = None) -> DataFrame:
    """The table's files as a stream."""
    schema = spark.read.parquet(f"{folder}/{name}.parquet").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").option("recursiveFileLookup", "false").parquet(folder)


def run_once(stream: DataFrame, mode: str) -> DataFrame:
    """Let the stream read what is there, write its rows with their checkpoint to the shared folder, and return them.

    In complete mode the rows are those of the last batch."""
    spark = stream.sparkSession
    path = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"

    def write(batch: DataFrame, n: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/rows" + ("" if mode == "complete" else f"/{n}"))

    stream.writeStream.foreachBatch(write).outputMode(mode).option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).option("recursiveFileLookup", "true").parquet(f"{path}/rows")
