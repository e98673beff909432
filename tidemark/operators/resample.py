"""Bootstrap intervals over event blocks.

Events are brought down to sums first; a replicate draws as many events as there are, by md5 of (seed, replicate, slot, group), so
that the draws are the same on any cluster and in SQL. Work is replicates times events, dealt out by replicate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def hashed(n: Column, *parts) -> Column:
    """A number from 0 below n from the parts' text: the first 13 hexadecimal digits of its md5, modulo n."""
    text = F.concat_ws("|", *[p.cast("string") if isinstance(p, Column) else F.lit(str(p)) for p in parts])
    return F.pmod(F.conv(F.substring(F.md5(text.cast("binary")), 1, 13), 16, 10).cast("long"), n.cast("long"))


def uniform(*parts) -> Column:
    """A number between 0 and 1 from the parts' text, never either of them."""
    return (hashed(F.lit(1 << 52), *parts) + 0.5) / float(1 << 52)


def event_bootstrap(rows: DataFrame, event: str, value: Column, by: list[str], replicates: int = 200, seed: int = 0, strata: list[str] | None = None, low: float = 0.025, high: float = 0.975) -> DataFrame:
    """For each group: events, the mean, and the interval between two percentiles of the replicates; no interval for fewer than two events.

    A replicate draws whole events, as many as there are, within each stratum of the group if there are strata. With a row's key as event it is the bootstrap of rows."""
    within = [*by, *(strata or [])]
    events = rows.groupBy(*within, event).agg(F.sum(value).alias("_s"), F.count(value).alias("_n"))
    n = F.count(F.lit(1)).over(Window.partitionBy(*within))
    events = events.withColumn("_i", F.row_number().over(Window.partitionBy(*within).orderBy(event)) - 1).withColumn("_of", n)
    slots = events.select(*within, "_i", "_of").withColumn("_r", F.explode(F.sequence(F.lit(1), F.lit(replicates))))
    drawn = slots.withColumn("_pick", hashed(F.col("_of"), seed, F.col("_r"), F.col("_i"), *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in within]).cast("int"))
    got = drawn.alias("d").join(events.alias("e"), [F.col(f"d.{c}").eqNullSafe(F.col(f"e.{c}")) for c in within] + [F.col("d._pick") == F.col("e._i")])
    each = got.groupBy(*[F.col(f"d.{c}").alias(c) for c in by], F.col("d._r").alias("_r")).agg((F.sum("e._s") / F.sum("e._n")).alias("m"))
    # A group has as many of these as there are replicates, so its percentiles are exact and bounded.
    ends = each.groupBy(*by).agg(F.percentile("m", F.array(F.lit(low), F.lit(high))).alias("_q"))
    total = events.groupBy(*by).agg(F.count(F.lit(1)).alias("n_events"), (F.sum("_s") / F.sum("_n")).alias("mean"))
    two = F.col("n_events") >= 2
    met = total.join(ends, by) if by else total.crossJoin(ends)
    return met.select(*by, "n_events", "mean", F.when(two, F.col("_q")[0]).alias("low"), F.when(two, F.col("_q")[1]).alias("high"))


def randomised_pit(below: Column, mass: Column, *key) -> Column:
    """The place of an outcome in its discrete forecast: what lies below it, and a share of its own mass by the key's hash."""
    return below + uniform(*key) * mass
