"""Ordered partitions: workloads, layoffs, ledgers, chains and folds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.session import shared_folder

DAY = 86_400_000_000


def trailing_workload(rows: DataFrame, by: list[str], micros: str, minutes: str, days: int = 21, short: float = 0.7, short_half: float = 3.0, long_half: float = 14.0, unit: float = 300.0) -> DataFrame:
    """workload before each row from the rows of the days before, decayed by age; null if one of them has no minutes; n_recent counts them.

    The decay 2 ** (-age / half life) is taken out of the sum, from the start of a block of time, so that sums of numbers do and no row carries its window. Numbers would
    overflow over years, so a block is ten windows long, and rows of a block's last window stand in the next block, too."""
    length = 10 * days * DAY
    block = F.floor(F.col(micros) / F.lit(length)).cast("long")
    late = F.col(micros) >= (block + 1) * length - days * DAY
    rows = rows.withColumn("_own", block).withColumn("_block", F.explode(F.array_compact(F.array(block, F.when(late, block + 1)))))
    w = Window.partitionBy(*by, "_block").orderBy(micros).rangeBetween(-days * DAY, -1)
    since = (F.col(micros) - F.col("_block") * length) / F.lit(float(DAY))
    m, total = F.col(minutes).cast("double"), F.lit(0.0)
    for share, half in ((short, short_half), (1 - short, long_half)):
        total = total + share / unit * F.pow(F.lit(2.0), -since / F.lit(half)) * F.coalesce(F.sum(m * F.pow(F.lit(2.0), since / F.lit(half))).over(w), F.lit(0.0))
    n = F.count(F.lit(1)).over(w)
    rows = rows.withColumns({"n_recent": n, "workload": F.when(F.count(m).over(w) == n, total)})
    return rows.filter("_own = _block").drop("_own", "_block")


def gaps(rows: DataFrame, by: list[str], micros: str) -> DataFrame:
    """gap_days since the row before."""
    return rows.withColumn("gap_days", (F.col(micros) - F.lag(micros).over(Window.partitionBy(*by).orderBy(micros))) / F.lit(float(DAY)))


def short_recovery(gap: Column, normal: float = 2.0) -> Column:
    return F.greatest(F.lit(0.0), normal - gap) / normal


def layoff_islands(rows: DataFrame, by: list[str], micros: str, threshold: float, unit: float = 30.0, most: int = 12) -> DataFrame:
    """A gap over the threshold starts an island: its severity, and the matches since the return, which end it at `most`."""
    rows = gaps(rows, by, micros)
    starts = (F.col("gap_days") > threshold).cast("int")
    run = Window.partitionBy(*by).orderBy(micros).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("_s", F.coalesce(starts, F.lit(0))).withColumn("island", F.sum("_s").over(run))
    inside = Window.partitionBy(*by, "island").orderBy(micros)
    rows = rows.withColumn("_k", F.row_number().over(inside)).withColumn("_g", F.first("gap_days").over(inside))
    on = (F.col("island") > 0) & (F.col("_k") < most)
    return rows.withColumn("severity", F.when(on, F.log1p((F.col("_g") - threshold) / unit)).otherwise(0.0)).withColumn("since_return", F.when(on, F.col("_k")).otherwise(0).cast("long")).drop("_s", "_k", "_g")


def chain(rows: DataFrame, by: list[str], order: str, previous: str, own: str, content: Column) -> DataFrame:
    """Each entry's position, whether its number is gapless, whether it points to the entry before and whether its hash is right."""
    w = Window.partitionBy(*by).orderBy(order)
    before = F.lag(own).over(w)
    return rows.withColumn("gapless", F.col(order) == F.row_number().over(w)).withColumn("linked", F.col(previous).eqNullSafe(before)).withColumn("hash_ok", F.col(own) == F.sha2(F.concat_ws("|", F.coalesce(F.col(previous), F.lit("")), content), 256))


def roots(rows: DataFrame, row_id: str, parent: str) -> DataFrame:
    """(row_id, root) by pointer jumping: chains halve in each round, so a chain of length n takes log2 n joins. A cycle has no root and is an error."""
    if not rows.filter(F.col(parent) == F.col(row_id)).isEmpty():
        raise ValueError("a row is its own parent")
    at = rows.select(F.col(row_id).alias("id"), F.coalesce(F.col(parent), F.col(row_id)).alias("root"))
    rounds = rows.count().bit_length() + 1
    for _ in range(rounds):
        up = at.select(F.col("id").alias("_i"), F.col("root").alias("_r"))
        new = at.join(up, at["root"] == up["_i"], "left").select("id", F.coalesce("_r", "root").alias("root"), (F.coalesce("_r", "root") != F.col("root")).alias("_moved"))
        new = _cut(new)
        moved = not new.filter("_moved").isEmpty()
        at = new.drop("_moved")
        if not moved:
            break
        # All rows of a chain of length 2 ** n have their root after n rounds; who points to itself and has a parent is on a cycle.
        back = at.filter("root = id").join(rows.filter(F.col(parent).isNotNull()).select(F.col(row_id).alias("id")), "id", "left_semi")
        if not back.isEmpty():
            raise ValueError("the chain runs in a circle")
    else:
        raise ValueError(f"no root after {rounds} rounds: the chain runs in a circle")
    return at.select(F.col("id").alias(row_id), "root")


def effective_rows(rows: DataFrame, row_id: str, parent: str, order: str) -> DataFrame:
    """Of each correction chain the row that was appended last."""
    found = rows.join(roots(rows, row_id, parent), row_id)
    return found.withColumn("_n", F.row_number().over(Window.partitionBy("root").orderBy(F.col(order).desc()))).filter("_n = 1").drop("_n")


def _cut(df: DataFrame) -> DataFrame:
    """df with its lineage cut by a checkpoint in the folder that the session names; a session on one machine gets a folder of its own."""
    context = df.sparkSession.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, component): the least node that can be reached. Large-star and small-star in turn, until no edge changes."""
    links = _cut(edges.select(F.least(a, b).alias("x"), F.greatest(a, b).alias("y")).filter("x != y").distinct())
    alone = edges.select(F.col(a).alias("node")).filter(F.col(a) == F.col(b)).distinct()
    while True:
        both = links.unionAll(links.select(F.col("y").alias("x"), F.col("x").alias("y")))
        least = both.groupBy("x").agg(F.least(F.min("y"), F.first("x")).alias("m"))
        large = both.filter("y > x").join(least, "x").select(F.col("m").alias("x"), "y").filter("x != y").distinct()
        up = large.groupBy("y").agg(F.min("x").alias("m"))
        ends = F.explode(F.array(F.struct(F.col("m").alias("x"), F.col("y").alias("y")), F.struct(F.col("m").alias("x"), F.col("x").alias("y"))))
        now = _cut(large.join(up, "y").select(ends.alias("e")).select("e.x", "e.y").filter("x != y").distinct())
        same = now.count() == links.count() and now.join(links, ["x", "y"], "left_anti").isEmpty()
        links = now
        if same:
            out = links.select(F.col("y").alias("node"), F.col("x").alias("component")).unionAll(links.select(F.col("x").alias("node"), F.col("x").alias("component")).distinct())
            return out.unionAll(alone.join(out, "node", "left_anti").select("node", F.col("node").alias("component")))
