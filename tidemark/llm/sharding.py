"""Operator 10: a consistent-hash ring with virtual nodes and bounded loads.

Every row has a home on the ring, found from its id alone. The ring is cut into cells, and the
rows of each cell are counted in one pass that reads only the id. From these counts, whose number
is fixed by the ring and not by the data, the driver lays down which ranks of which cell go to
which shard: each shard takes the rows at home with it up to its capacity, in ring order; what
does not fit walks clockwise to the next virtual node whose shard has room. Capacities are n div k,
and one more in the first n mod k shards, so that they add up to n and the row counts of any two
shards differ by one at most (law `rows`). A second pass ranks rows inside their cell and joins the
plan. Everything runs as DataFrame expressions.

Defined results: a null id hashes as a value of its own; a null text has size 16 and the crc32 of
an empty one; rows alike in id and text get different slots; an empty table gives no rows; columns
other than the id and the text are not read.
"""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

SHARDS, VNODES, OVERHEAD = 40, 64, 16


def ring(n_shards: int, vnodes: int) -> tuple[int, list[int]]:
    """log2 of the number of cells, and the shard whose virtual node is the first at or after each cell."""
    bits = max(6, (n_shards * vnodes * 4 - 1).bit_length())
    cells = 1 << bits
    owner: list[int | None] = [None] * cells
    for shard in range(n_shards):
        for v in range(vnodes):
            at = int.from_bytes(hashlib.blake2b(f"{shard}/{v}".encode(), digest_size=8).digest(), "big") % cells
            while owner[at] is not None:
                at = (at + 1) % cells
            owner[at] = shard
    nearest = next(s for s in owner if s is not None)
    found = []
    for s in reversed(owner):
        nearest = nearest if s is None else s
        found.append(nearest)
    return bits, found[::-1]


def lay_out(counts: dict[int, int], homes: list[int], n_shards: int) -> list[tuple[int, int, int, int, int]]:
    """(cell, from rank, to rank, shard, first slot), from the rows of each cell."""
    total = sum(counts.values())
    room = [total // n_shards + (s < total % n_shards) for s in range(n_shards)]
    used = [0] * n_shards
    plan, over = [], []

    def take(cell: int, lo: int, n: int, shard: int) -> int:
        got = min(n, room[shard])
        if got:
            plan.append((cell, lo, lo + got, shard, used[shard]))
            room[shard] -= got
            used[shard] += got
        return got

    for cell in sorted(counts):
        got = take(cell, 0, counts[cell], homes[cell])
        if got < counts[cell]:
            over.append((cell, got, counts[cell]))
    for cell, lo, hi in over:
        at = cell
        while lo < hi:
            at = (at + 1) % len(homes)
            lo += take(cell, lo, hi - lo, homes[at])
    return plan


def assign(docs: DataFrame, n_shards: int = SHARDS, vnodes: int = VNODES, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Every row's id, size, text_crc32, home shard, shard and slot."""
    spark = docs.sparkSession
    bits, homes = ring(n_shards, vnodes)
    text = F.coalesce(F.col(text_column).cast("string"), F.lit(""))
    place = F.xxhash64(F.col(id_column).cast("string"))
    cell = F.shiftrightunsigned(place, 64 - bits).cast("int")
    counts = {r["c"]: r["n"] for r in docs.groupBy(cell.alias("c")).agg(F.count(F.lit(1)).alias("n")).collect()}
    plan = [list(x) for x in lay_out(counts, homes, n_shards)]
    kind = "array<struct<_cell:int,_lo:bigint,_hi:bigint,shard:int,_slot:bigint,home_shard:int>>"
    rows = json.dumps([dict(zip(("_cell", "_lo", "_hi", "shard", "_slot", "home_shard"), [*x, homes[x[0]]], strict=True)) for x in plan])
    plan_df = spark.range(1).select(F.inline(F.from_json(F.lit(rows), kind)))
    keyed = docs.select(
        F.col(id_column),
        (F.octet_length(text) + OVERHEAD).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        place.alias("_place"),
        cell.alias("_cell"),
    )
    order = Window.partitionBy("_cell").orderBy("_place", F.col(id_column), "size", "text_crc32")
    ranked = keyed.withColumn("_rank", (F.row_number().over(order) - 1).cast("long"))
    # The plan has a row for each cell and one more for each shard that fills up: its size is bound by the ring.
    here = F.broadcast(plan_df)
    joined = ranked.join(here, (ranked["_cell"] == here["_cell"]) & (F.col("_rank") >= F.col("_lo")) & (F.col("_rank") < F.col("_hi")))
    return joined.select(F.col(id_column), "size", "text_crc32", "home_shard", "shard", (F.col("_slot") + F.col("_rank") - F.col("_lo")).alias("slot"))


def query(spark, sf_dir):
    """op10_sharding."""
    from tidemark.llm.shared import table

    return assign(table(spark, sf_dir, "documents")).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "home_shard"
    )
