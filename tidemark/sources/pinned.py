"""Scans and sinks of pinned, checksummed files: nothing is read before its hash is right, and nothing is repaired."""

from __future__ import annotations

import hashlib
import json
import re
import zipfile
from xml.etree import ElementTree

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


class SourceError(ValueError):
    """A source is not what its pin says, or not what its format asks for."""


def hashes(spark: SparkSession, path: str) -> DataFrame:
    """(path, length, sha256) of all files below the path."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select("path", "length", F.sha2("content", 256).alias("sha256"))


def verify(spark: SparkSession, path: str, sha256: str) -> None:
    found = hashes(spark, path).collect()
    if len(found) != 1 or found[0]["sha256"] != sha256:
        raise SourceError(f"{path} is not the pinned file")


def check_header(names: list[str]) -> None:
    blank, twice = [n for n in names if not n.strip()], sorted({n for n in names if names.count(n) > 1})
    if blank or twice:
        raise SourceError(f"blank or repeated columns: {twice or 'blank'}")


def require(df: DataFrame, columns: list[str]) -> DataFrame:
    if missing := sorted(set(columns) - set(df.columns)):
        raise SourceError(f"missing columns: {', '.join(missing)}")
    return df


def read_csv(spark: SparkSession, path: str, sha256: str | None = None) -> DataFrame:
    """All columns as text, nothing taken for missing, with _source_row_number from 2 on and the row as canonical JSON.

    A file of this kind is small (a tour's year); it is read in one part so that its rows have their numbers."""
    if sha256:
        verify(spark, path, sha256)
    head = spark.read.text(path).limit(1).collect()
    if not head:
        raise SourceError(f"{path} is empty")
    names = head[0][0].removeprefix("﻿").rstrip("\r").split(",")
    check_header(names)
    kind = ", ".join(f"`{n}` string" for n in names)
    df = spark.read.schema(kind).option("header", "true").option("enforceSchema", "true").option("mode", "FAILFAST").option("nullValue", "\x00").option("emptyValue", "").csv(path)
    df = df.select([F.coalesce(F.col(f"`{n}`"), F.lit("")).alias(n) for n in names])
    pairs = F.to_json(F.map_from_entries(F.array_sort(F.array(*[F.struct(F.lit(n).alias("k"), F.col(f"`{n}`").alias("v")) for n in names]))))
    # A file's parts are read in order, and ids rise with them.
    df = df.withColumn("_raw_record_json", pairs).withColumn("_id", F.monotonically_increasing_id()).withColumn("_file", F.input_file_name())
    return df.withColumn("_source_row_number", (F.row_number().over(Window.partitionBy("_file").orderBy("_id")) + 1).cast("long")).drop("_id", "_file")


def read_many(spark: SparkSession, paths: dict[str, dict[str, str]]) -> DataFrame:
    """Files by path, each with the columns of its tags; columns that a file lacks are null."""
    out = None
    for path, tags in paths.items():
        df = read_csv(spark, path).withColumns({k: F.lit(v) for k, v in tags.items()})
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    if out is None:
        raise SourceError("no files")
    return out


def read_xlsx(spark: SparkSession, path: str, sheet: int = 1) -> DataFrame:
    """A worksheet's cells as text, by its first row's names. The file is read on the driver: a workbook has a million rows at most."""
    space = {"m": "http://schemas.openxmlformats.org/spreadsheetml/2006/main"}
    with zipfile.ZipFile(path) as z:
        shared = []
        if "xl/sharedStrings.xml" in z.namelist():
            shared = ["".join(t.text or "" for t in si.iter(f"{{{space['m']}}}t")) for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).findall("m:si", space)]
        rows = []
        for row in ElementTree.fromstring(z.read(f"xl/worksheets/sheet{sheet}.xml")).iter(f"{{{space['m']}}}row"):
            cells: dict[int, str] = {}
            for c in row.findall("m:c", space):
                letters = re.match(r"[A-Z]+", c.get("r", "A"))[0]
                at = 0
                for x in letters:
                    at = at * 26 + ord(x) - 64
                v, inline = c.find("m:v", space), c.find("m:is", space)
                text = "".join(t.text or "" for t in inline.iter(f"{{{space['m']}}}t")) if inline is not None else (v.text if v is not None else None)
                cells[at] = shared[int(text)] if c.get("t") == "s" and text is not None else text
            rows.append(cells)
    if not rows:
        raise SourceError(f"{path} has no rows")
    width = max(rows[0])
    names = [rows[0].get(i + 1) or "" for i in range(width)]
    check_header(names)
    return spark.createDataFrame([[r.get(i + 1) for i in range(width)] for r in rows[1:]], ", ".join(f"`{n}` string" for n in names))


def read_feed(spark: SparkSession, path: str, schema: str, event_codes: list[str], status: str) -> tuple[DataFrame, DataFrame]:
    """Finished matches of the event codes from nested JSON, and the others with the reason."""
    rows = spark.read.schema(schema).option("multiLine", "true").json(path).select(F.explode("matches").alias("m")).select("m.*")
    reason = F.when(~F.coalesce(F.col("eventCode").isin(event_codes), F.lit(False)), "OTHER_EVENT").when(F.coalesce(F.col("statusCode") != status, F.lit(True)), "NOT_FINISHED")
    rows = rows.withColumn("reason", reason)
    return rows.filter("reason IS NULL").drop("reason"), rows.filter("reason IS NOT NULL")


def score_text(sets: Column) -> Column:
    """`6-4 7-6(5)` from an array of sets of two sides with score and tiebreak; null if any part is malformed."""
    games = F.transform(sets, lambda s: F.concat(s[0]["score"].cast("string"), F.lit("-"), s[1]["score"].cast("string"), F.when(F.least(s[0]["tiebreak"], s[1]["tiebreak"]).isNotNull(), F.concat(F.lit("("), F.least(s[0]["tiebreak"], s[1]["tiebreak"]).cast("string"), F.lit(")"))).otherwise(F.lit(""))))
    return F.when(F.forall(games, lambda g: g.isNotNull()) & (F.size(games) > 0), F.array_join(games, " "))


def canonical(value: object) -> bytes:
    """Sorted keys, no blanks, no NaN, a line end."""
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False).encode() + b"\n"


def content_id(value: object) -> str:
    return hashlib.sha256(canonical(value)).hexdigest()


def _count_and_print(df: DataFrame) -> tuple[int, str]:
    """Rows, and a hash that does not hang on their order: the sum of the rows' hashes."""
    n, total = df.agg(F.count(F.lit(1)), F.sum(F.xxhash64(*[F.col(f"`{c}`") for c in df.columns]).cast("decimal(38,0)"))).head()
    return n, str(total or 0)


def write_bundle(tables: dict[str, DataFrame], folder: str, partition: dict[str, list[str]] | None = None) -> str:
    """Write each table as zstd Parquet under a folder that bears the id of all contents, with a manifest last; the id.

    A folder whose manifest is there is not written again: readers take only folders with one."""
    spark = next(iter(tables.values())).sparkSession
    receipts = {}
    for name, df in sorted(tables.items()):
        n, total = _count_and_print(df)
        receipts[name] = {"columns": [[f.name, f.dataType.simpleString()] for f in df.schema], "rows": n, "sum": total}
    bundle = content_id(receipts)
    path = f"{folder.rstrip('/')}/{bundle}"
    manifest = f"{path}/manifest"
    fs = spark._jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(spark._jvm.org.apache.hadoop.fs.Path(manifest)):
        for name, df in tables.items():
            df.write.mode("overwrite").option("compression", "zstd").partitionBy(*(partition or {}).get(name, [])).parquet(f"{path}/{name}")
        spark.createDataFrame([(canonical(receipts).decode().strip(),)], "value string").coalesce(1).write.mode("overwrite").text(manifest)
    return bundle


def read_bundle(spark: SparkSession, folder: str, bundle: str, name: str) -> DataFrame:
    """A table of a bundle, after its columns, row count and sum are compared with the manifest's."""
    path = f"{folder.rstrip('/')}/{bundle}"
    receipts = json.loads(spark.read.text(f"{path}/manifest").head()[0])
    if content_id(receipts) != bundle or name not in receipts:
        raise SourceError(f"the manifest of {bundle} is not its own, or has no table {name}")
    known = receipts[name]
    df = spark.read.schema(", ".join(f"`{c}` {t}" for c, t in known["columns"])).parquet(f"{path}/{name}")
    n, total = _count_and_print(df)
    if (n, total) != (known["rows"], known["sum"]):
        raise SourceError(f"{name} of {bundle} has other rows than its receipt")
    return df
