"""Operator 4: benchmark decontamination by one Aho-Corasick automaton over normalised questions and answers.

A-Z become a-z; a word is a run of letters a-z, digits and bytes outside ASCII. A benchmark item
gives windows of ten consecutive words (an item of one to nine words is one window). Words that
occur in the benchmark have numbers, and the automaton runs over these numbers, so that one scan
of a text gives all windows that occur in it; a text's other words are number 0, which no window
holds. Normalising changes no byte's place, so words map back to offsets in the original text.

The automaton goes to the executors by broadcast. Its size is bound: the benchmark is cut into
blocks of at most BLOCK_BYTES of text each, one automaton is built for a block, and with more than
one block the hits of all passes are brought together by document. A single item longer than that
is a block of its own.

Defined results: a null or empty text has no words, hits or items; a null item text has no windows;
a null item_id counts as the empty id; repeated items count once; repeated documents are each
reported; an empty benchmark hits nothing; other columns are not read.
"""

from __future__ import annotations

import hashlib
import re
import uuid
from itertools import repeat

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WINDOW, BLOCK_BYTES = 10, 1 << 20
_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))
_WORD = re.compile(rb"[^ ]+")
_built: dict = {}


def normalised(text: str | None) -> bytes:
    """The text's bytes, each at its place, with separators as blanks."""
    return (text or "").encode().translate(_TABLE)


def windows(text: str | None, size: int = WINDOW) -> list[tuple[bytes, ...]]:
    words = normalised(text).split(b" ") if text else []
    words = [w for w in words if w]
    return [tuple(words[i : i + size]) for i in range(max(1, len(words) - size + 1))] if words else []


def build(items: list[tuple[str, str | None]], size: int = WINDOW):
    """(word numbers, automaton or None) of these items. The automaton's values: words in the window, item ids."""
    import ahocorasick

    numbers: dict[bytes, int] = {}
    found: dict[tuple[int, ...], set[str]] = {}
    for item, text in items:
        for w in windows(text, size):
            found.setdefault(tuple(numbers.setdefault(x, len(numbers) + 1) for x in w), set()).add(item)
    if not found:
        return numbers, None
    automaton = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
    for key, ids in found.items():
        automaton.add_word(key, (len(key), tuple(sorted(ids))))
    automaton.make_automaton()
    return numbers, automaton


def scan(text: str | None, numbers: dict[bytes, int], automaton) -> tuple[int, list[tuple[int, int]], set[str]]:
    """Words of the text, runs (from, to) of hit words, and the items."""
    words = normalised(text).split()
    runs: list[tuple[int, int]] = []
    items: set[str] = set()
    if automaton is not None and words:
        for end, (n, ids) in automaton.iter(tuple(map(numbers.get, words, repeat(0)))):
            lo, hi = end - n + 1, end + 1
            while runs and runs[-1][1] >= lo:
                lo = min(lo, runs.pop()[0])
            runs.append((lo, hi))
            items.update(ids)
    return len(words), runs, items


def spans(text: str, runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Runs of words as (from, to) in characters of the original text."""
    raw = text.encode()
    at = [m.span() for m in _WORD.finditer(raw.translate(_TABLE))]
    return [(len(raw[: at[lo][0]].decode()), len(raw[: at[hi - 1][1]].decode())) for lo, hi in runs]


def _blocks(benchmark: DataFrame, item_column: str, text_column: str, block_bytes: int) -> list[list[tuple[str, str]]]:
    """The items in blocks of bounded text, in the order of their ids."""
    items = benchmark.select(F.coalesce(F.col(item_column).cast("string"), F.lit("")).alias("i"), F.col(text_column).cast("string").alias("t")).dropna(subset=["t"]).distinct()
    blocks: list[list[tuple[str, str]]] = [[]]
    size = 0
    for row in items.orderBy("i", "t").toLocalIterator():
        n = len(row["t"].encode())
        if blocks[-1] and size + n > block_bytes:
            blocks.append([])
            size = 0
        blocks[-1].append((row["i"], row["t"]))
        size += n
    return blocks


def find(
    docs: DataFrame, benchmark: DataFrame, id_column: str = "doc_id", text_column: str = "text", item_column: str = "item_id", item_text: str = "text", window: int = WINDOW, block_bytes: int = BLOCK_BYTES
) -> DataFrame:
    """For each document: its id, n_words, runs of hit words, their spans in characters, and the sorted items."""
    spark = docs.sparkSession
    source = docs.select(F.col(id_column).alias("_id"), F.col(text_column).cast("string").alias("_text"))
    run = "array<struct<lo:int,hi:int>>"
    kind = f"_id {source.schema['_id'].dataType.simpleString()}, n_words long, runs {run}, spans {run}, items array<string>"
    pairs = pa.list_(pa.struct([("lo", pa.int32()), ("hi", pa.int32())]))

    def one_pass(block: list[tuple[str, str]]) -> DataFrame:
        sent, key = spark.sparkContext.broadcast(block), uuid.uuid4().hex

        def scanned(batches):
            if key not in _built:
                _built.clear()
                _built[key] = build(sent.value, window)
            numbers, automaton = _built[key]
            for batch in batches:
                words, runs, places, items = [], [], [], []
                for text in batch.column(1).to_pylist():
                    n, r, ids = scan(text, numbers, automaton)
                    words.append(n)
                    runs.append([{"lo": a, "hi": b} for a, b in r])
                    places.append([{"lo": a, "hi": b} for a, b in spans(text, r)] if r else [])
                    items.append(sorted(ids))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array(words, pa.int64()), pa.array(runs, pairs), pa.array(places, pairs), pa.array(items, pa.list_(pa.string()))], ["_id", "n_words", "runs", "spans", "items"]
                )

        return source.mapInArrow(scanned, kind)

    blocks = _blocks(benchmark, item_column, item_text, block_bytes)
    if len(blocks) == 1:
        return one_pass(blocks[0]).withColumnRenamed("_id", id_column)
    # More than one automaton: each row gets a key from its content, and the passes meet by it.
    key = F.struct("_id", F.xxhash64("_text"), F.row_number().over(_within()))
    source = source.withColumn("_id", key)
    kind = f"_id {source.schema['_id'].dataType.simpleString()}, n_words long, runs {run}, spans {run}, items array<string>"
    found = one_pass(blocks[0])
    for block in blocks[1:]:
        found = found.unionAll(one_pass(block))
    met = found.groupBy("_id").agg(
        F.max("n_words").alias("n_words"),
        _merged(F.flatten(F.collect_list("runs"))).alias("runs"),
        _merged(F.flatten(F.collect_list("spans"))).alias("spans"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
    )
    return met.select(F.col("_id._id").alias(id_column), "n_words", "runs", "spans", "items")


def _within():
    from pyspark.sql.window import Window

    return Window.partitionBy("_id", F.xxhash64("_text")).orderBy(F.lit(1))


def _merged(runs):
    """Overlapping or touching runs as one."""
    empty = F.array().cast("array<struct<lo:int,hi:int>>")

    def add(done, x):
        last = F.element_at(done, -1)
        joined = F.concat(F.slice(done, 1, F.size(done) - 1), F.array(F.struct(last["lo"].alias("lo"), F.greatest(last["hi"], x["hi"]).alias("hi"))))
        return F.when((F.size(done) > 0) & (F.try_element_at(done, F.lit(-1))["hi"] >= x["lo"]), joined).otherwise(F.concat(done, F.array(x)))

    return F.aggregate(F.array_sort(runs), empty, add)


def query(spark, sf_dir):
    """op4_decontamination."""
    from tidemark.llm.shared import table

    found = find(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    hit = F.aggregate("runs", F.lit(0).cast("long"), lambda a, r: a + (r["hi"] - r["lo"]))
    return found.select(
        "doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), (F.size("runs") > 0).alias("contaminated")
    )


SQL = """
WITH grams AS (
  SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x{00}-\\x{2F}\\x{3A}-\\x{60}\\x{7B}-\\x{7F}]+') AS w
  FROM benchmark WHERE text IS NOT NULL),
wins AS (
  SELECT DISTINCT item_id, least(10, len(w)) AS n, list_slice(w, i, i + least(10, len(w)) - 1) AS g
  FROM (SELECT item_id, w, unnest(range(1, greatest(2, len(w) - 8))) AS i FROM grams WHERE len(w) > 0)),
dw AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x{00}-\\x{2F}\\x{3A}-\\x{60}\\x{7B}-\\x{7F}]+') AS w
  FROM documents),
sizes AS (SELECT DISTINCT n FROM wins),
pos AS (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM dw),
occ AS (
  SELECT p.doc_id, p.i, x.n, x.item_id
  FROM (SELECT doc_id, i, n, list_slice(w, i, i + n - 1) AS g FROM pos, sizes WHERE i + n - 1 <= len(w)) p
  JOIN wins x ON x.n = p.n AND x.g = p.g),
hit AS (
  SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS k FROM (SELECT DISTINCT doc_id, i, n FROM occ)) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(k, ',' ORDER BY k) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS k FROM occ) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(h.n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(t.n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(t.ids, '')) AS items_sha256, coalesce(h.n_hit, 0) > 0 AS contaminated
FROM dw d LEFT JOIN hit h USING (doc_id) LEFT JOIN its t USING (doc_id)
"""
