"""An append-only ledger and a lock store as Parquet: every batch is a folder of its own, every entry is chained to the one before.

Entries are few (the rows of a lock or a settlement), so the hashes of a batch are chained in one task; the uniqueness of its ids is an anti join, and verifying is one window over the whole ledger."""

from __future__ import annotations

import hashlib
import json

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException
from pyspark.sql.window import Window

LEDGER = "sequence long, row_id string, correction_of string, available_at timestamp, previous_sha256 string, entry_sha256 string, row_json string"


def read(spark: SparkSession, path: str) -> DataFrame:
    """All entries; an empty table where nothing was appended yet."""
    try:
        return spark.read.schema(LEDGER).option("recursiveFileLookup", "true").parquet(path)
    except AnalysisException:
        return spark.createDataFrame([], LEDGER)


def entry_hash(previous: Column, row_json: Column) -> Column:
    return F.sha2(F.concat(F.coalesce(previous, F.lit("null")), F.lit("\n"), row_json), 256)


def append(spark: SparkSession, path: str, rows: DataFrame) -> str:
    """Append rows (row_id, correction_of, available_at, row_json), in the order of their ids, and return the last hash.

    An id that is known, an id twice in the batch and a correction of an unknown row or of another prop are errors, and nothing is written.
    A batch is the folder with the number of its first entry, and that folder must be new, so of two writers at once one fails."""
    known = read(spark, path)
    rows = rows.select("row_id", "correction_of", "available_at", "row_json")
    twice = rows.groupBy("row_id").count().filter("count > 1")
    if not twice.isEmpty() or not rows.join(known, "row_id", "left_semi").isEmpty():
        raise ValueError("a row is in the ledger already; entries are never overwritten")
    prop = lambda c: F.get_json_object(c, "$.prop_id")
    both = known.select(F.col("row_id").alias("_id"), prop("row_json").alias("_prop")).unionAll(rows.select("row_id", prop("row_json")))
    lost = rows.filter("correction_of IS NOT NULL").join(both, F.col("correction_of") == F.col("_id"), "left").filter(F.col("_id").isNull() | ~F.col("_prop").eqNullSafe(prop("row_json")))
    if not lost.isEmpty():
        raise ValueError("a correction of a row that is not in the ledger, or of another prop")
    last = known.agg(F.max(F.struct("sequence", "entry_sha256")).alias("x")).head()["x"]
    first, previous = (last["sequence"] + 1, last["entry_sha256"]) if last else (1, None)

    def chained(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("row_id").reset_index(drop=True)
        before, out = previous, []
        for text in frame["row_json"]:
            out.append((before, hashlib.sha256(f"{before or 'null'}\n{text}".encode()).hexdigest()))
            before = out[-1][1]
        frame["previous_sha256"], frame["entry_sha256"] = zip(*out, strict=True)
        frame["sequence"] = range(first, first + len(frame))
        return frame[["sequence", "row_id", "correction_of", "available_at", "previous_sha256", "entry_sha256", "row_json"]]

    batch = rows.withColumn("_all", F.lit(True)).groupBy("_all").applyInPandas(chained, LEDGER)
    batch.write.mode("errorifexists").parquet(f"{path.rstrip('/')}/from-{first:012d}")
    return read(spark, path).agg(F.max(F.struct("sequence", "entry_sha256"))["entry_sha256"]).head()[0]


def verified(ledger: DataFrame) -> DataFrame:
    """One row: entries, corrections, and whether numbers are gapless, every entry points to the one before and has the right hash; the first bad number if not."""
    w = Window.orderBy("sequence")
    before = F.lag("entry_sha256").over(w)
    ok = (F.col("sequence") == F.row_number().over(w)) & F.col("previous_sha256").eqNullSafe(before) & (F.col("entry_sha256") == entry_hash(F.col("previous_sha256"), F.col("row_json")))
    # The chain is one sequence, so its window is one task; only hashes and texts of ledger entries pass through it.
    rows = ledger.withColumn("_ok", ok)
    return rows.agg(F.count(F.lit(1)).alias("n"), F.count("correction_of").alias("n_corrections"), F.count_if(~F.col("_ok")).alias("n_broken"), F.min(F.when(~F.col("_ok"), F.col("sequence"))).alias("first_broken"), F.max_by("entry_sha256", "sequence").alias("terminal_sha256"))


def effective_at(ledger: DataFrame, cutoff: Column) -> DataFrame:
    """The rows as they were known before a cutoff: of each row and its corrections the one appended last among those available before. Two corrections of one row that became available at one time are an error."""
    from tidemark.operators.timeline import roots

    seen = ledger.filter(F.col("available_at") < cutoff)
    # A correction may become known before what it corrects; its chain is that of the whole ledger.
    chain = seen.join(roots(ledger, "row_id", "correction_of"), "row_id")
    ranked = chain.withColumn("_r", F.row_number().over(Window.partitionBy("root").orderBy(F.col("available_at").desc(), F.col("sequence").desc())))
    same = F.count(F.lit(1)).over(Window.partitionBy("root", "available_at"))
    ranked = ranked.withColumn("_same", same).filter("_r = 1")
    return ranked.filter(F.when(F.col("_same") > 1, F.raise_error(F.lit("two corrections became available at one time")).cast("boolean")).otherwise(True)).drop("_r", "_same", "root")


def lock(record: dict) -> tuple[str, str]:
    """A lock's content id, the sha256 of its canonical JSON, and that JSON."""
    text = json.dumps(record, sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False)
    return hashlib.sha256(text.encode()).hexdigest(), text


def lock_rows(spark: SparkSession, records: list[dict]) -> DataFrame:
    """Locks as rows (lock_sha256, match_id, lock_json)."""
    return spark.createDataFrame([(sha, str(x.get("match_id")), text) for x in records for sha, text in [lock(x)]], "lock_sha256 string, match_id string, lock_json string")


def store_locks(spark: SparkSession, path: str, records: list[dict]) -> None:
    """Write locks, each once: one that is stored is left as it is."""
    rows = lock_rows(spark, records).dropDuplicates(["lock_sha256"])
    rows.join(load_locks(spark, path)[0], "lock_sha256", "left_anti").write.mode("append").parquet(path)


def load_locks(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(locks whose content has the hash it is stored under, the others as quarantine)."""
    try:
        rows = spark.read.schema("lock_sha256 string, match_id string, lock_json string").parquet(path)
    except AnalysisException:
        rows = spark.createDataFrame([], "lock_sha256 string, match_id string, lock_json string")
    ok = F.sha2("lock_json", 256) == F.col("lock_sha256")
    return rows.filter(ok), rows.filter(~ok)
