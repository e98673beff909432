"""Reading, cutting lineage and Arrow helpers that several operators use."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or one of our own where it is unset and all run on one machine (tests)."""
    known = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("tidemark.llm.folder", None)
    if not known:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        known = tempfile.mkdtemp(prefix="tidemark-")
        spark.conf.set("tidemark.llm.folder", known)
    return known.rstrip("/")


def written(df: DataFrame, what: str) -> DataFrame:
    """Write df as a table in the shared folder and read it back: later jobs do not recompute it when executors are lost."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/tidemark/{what}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_to = path
    return out


def forgotten(df: DataFrame) -> None:
    """Delete a table that written() gave and that no plan reads any more."""
    spark = df.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(df._written_to)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def fold(column: str | Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo: which fold a document is in (a null id counts as empty text)."""
    c = F.col(column) if isinstance(column, str) else column
    return F.pmod(F.crc32(F.coalesce(c.cast("string"), F.lit("")).cast("binary")), F.lit(modulus))


def text_buffers(arr: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (n + 1) of a string array; nulls are empty."""
    if isinstance(arr, pa.ChunkedArray):
        arr = arr.combine_chunks()
    arr = arr.cast(pa.large_string()).fill_null("")
    _, offsets, data = arr.buffers()
    offsets = np.frombuffer(offsets, np.int64)[arr.offset : arr.offset + len(arr) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]] if len(offsets) else data, offsets - (offsets[0] if len(offsets) else 0)


def chunks(offsets: np.ndarray, most: int):
    """Ranges (from, to) of texts whose bytes together stay under most; a longer text stands alone."""
    at, n = 0, len(offsets) - 1
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, side="right")) - 1)
        yield at, to
        at = to
