"""Forecast evaluation: scores, reliability, ranks, strata, skill and settlement."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.operators.timeline import _cut

CLIP = 1e-15


def brier(p: Column, y: Column) -> Column:
    return (p - y) * (p - y)


def log_loss(p: Column, y: Column) -> Column:
    q = F.least(F.lit(1 - CLIP), F.greatest(F.lit(CLIP), p))
    return -F.when(y == 1, F.log(q)).otherwise(F.log(1 - q))


def tenths(p: Column) -> Column:
    """Bins closed on the left; 1 is in the last one."""
    return F.least(F.floor(p * 10), F.lit(9)).cast("int")


def reliability(rows: DataFrame, p: str, y: str) -> DataFrame:
    """All ten bins, empty ones too."""
    bins = rows.sparkSession.range(10).select(F.col("id").cast("int").alias("bin"))
    got = rows.groupBy(tenths(F.col(p)).alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.avg(p).alias("mean_p"), F.avg(y).alias("frequency"), F.avg(brier(F.col(p), F.col(y))).alias("brier"))
    # Ten rows on the one side and ten at most on the other.
    return bins.join(got, "bin", "left").withColumn("n", F.coalesce("n", F.lit(0)))


def right_closed(p: Column, edges: list[float]) -> Column:
    """Number of the band (lo, hi]; the first is closed on both sides."""
    out = F.when((p >= edges[0]) & (p <= edges[1]), 0)
    for i in range(1, len(edges) - 1):
        out = out.when((p > edges[i]) & (p <= edges[i + 1]), i)
    return out


def prefix_counts(counted: DataFrame, by: list[str], value: str, n: str, descending: bool = False) -> DataFrame:
    """counted (by, value, n, ...), one row for each value of a group, with _before: the sum of n over the group's smaller (or larger) values.

    Rows are dealt out by ranges of (by, value), so a group of any size is spread; sums run within a range, and what the ranges before hold of the group is a
    table of one row for each range and group that begins or ends in it. The dealt-out rows are cut from their lineage, as a range is not the same twice."""
    order = F.col(value).desc() if descending else F.col(value).asc()
    dealt = _cut(counted.repartitionByRange(*[F.col(c).asc() for c in by], order).withColumn("_p", F.spark_partition_id()))
    inside = Window.partitionBy("_p", *by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    earlier = Window.partitionBy(*by).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    totals = dealt.groupBy("_p", *by).agg(F.sum(n).alias("_s")).withColumn("_start", F.coalesce(F.sum("_s").over(earlier), F.lit(0))).drop("_s")
    rows, sums = dealt.withColumn("_inside", F.coalesce(F.sum(n).over(inside), F.lit(0))).alias("r"), totals.alias("t")
    same = [F.col("r._p") == F.col("t._p")] + [F.col(f"r.{c}").eqNullSafe(F.col(f"t.{c}")) for c in by]
    return rows.join(sums, same).select("r.*", (F.col("t._start") + F.col("r._inside")).alias("_before")).drop("_p", "_inside")


def average_ranks(rows: DataFrame, value: str, by: list[str], out: str) -> DataFrame:
    """Rank of value, ties by their mean, within each group: the rows before and half of the ties."""
    counted = rows.groupBy(*by, value).agg(F.count(F.lit(1)).alias("_n"))
    ranks = prefix_counts(counted, by, value, "_n").withColumn(out, F.col("_before") + (F.col("_n") + 1) / 2).drop("_n", "_before")
    return rows.join(ranks, [*by, value])


def auc(rows: DataFrame, p: str, y: str, by: list[str]) -> DataFrame:
    """Mann-Whitney with mean ranks; null where there is one class only."""
    counted = rows.groupBy(*by, p).agg(F.count(F.lit(1)).alias("n"), F.sum(y).alias("n1"))
    ranked = prefix_counts(counted, by, p, "n").withColumn("r", F.col("_before") + (F.col("n") + 1) / 2)
    total = ranked.groupBy(*by).agg(F.sum("n").alias("n"), F.sum("n1").alias("n1"), F.sum(F.col("r") * F.col("n1")).alias("s"))
    n1, n0 = F.col("n1"), F.col("n") - F.col("n1")
    return total.select(*by, "n", F.try_divide(F.col("s") - n1 * (n1 + 1) / 2, (n1 * n0).cast("double")).alias("auc"))


def worst_share(rows: DataFrame, error: str, by: list[str], share: float = 0.1) -> DataFrame:
    """Mean of the largest errors, one at least. Of the last value that counts, only as many rows as are left."""
    size = rows.groupBy(*by).agg(F.count(error).alias("_size"))
    counted = rows.filter(F.col(error).isNotNull()).groupBy(*by, error).agg(F.count(F.lit(1)).alias("_n"))
    ranked = prefix_counts(counted, by, error, "_n", descending=True).join(size, by)
    left = F.greatest(F.lit(1), F.ceil(F.lit(share) * F.col("_size"))) - F.col("_before")
    taken = F.greatest(F.lit(0), F.least(F.col("_n"), left))
    return ranked.filter(taken > 0).groupBy(*by).agg((F.sum(F.col(error) * taken) / F.sum(taken)).alias("worst"), F.sum(taken).cast("long").alias("n_worst"))


def stratified(rows: DataFrame, p: str, y: str, strata: list[str]) -> DataFrame:
    """Scores overall and by each stratum: one scan with grouping sets."""
    sets = [[], *[[s] for s in strata]]
    scored = rows.withColumn("_b", brier(F.col(p), F.col(y))).withColumn("_l", log_loss(F.col(p), F.col(y))).withColumn("_h", ((F.col(p) >= 0.5).cast("int") == F.col(y)).cast("int"))
    return scored.groupingSets(sets, *strata).agg(F.count(F.lit(1)).alias("n"), F.avg("_b").alias("brier"), F.avg("_l").alias("log_loss"), F.avg("_h").alias("accuracy"))


def skill(rows: DataFrame, target: str, comparator: str, p: str, y: str, baseline: str) -> DataFrame:
    """Of each comparator its score and its skill over the baseline on the targets that both have."""
    scored = rows.withColumn("_b", brier(F.col(p), F.col(y)))
    base = scored.filter(F.col(comparator) == baseline).select(target, F.col("_b").alias("_base"))
    both = scored.join(base, target, "left")
    own, other = F.avg(F.when(F.col("_base").isNotNull(), F.col("_b"))), F.avg("_base")
    return both.groupBy(comparator).agg(F.count(F.lit(1)).alias("n"), F.count("_base").alias("n_paired"), F.avg("_b").alias("brier"), F.when(other != 0, 1 - own / other).alias("skill"))


def incidence(rows: DataFrame, p: str, y: str, sets: list[list[str]], columns: list[str]) -> DataFrame:
    """Observed and expected counts, their rates and the standard score."""
    o, e, v = F.sum(y), F.sum(p), F.sum(F.col(p) * (1 - F.col(p)))
    z = F.when(v > 0, (o - e) / F.sqrt(v))
    return rows.groupingSets([[F.col(c) for c in s] for s in sets], *columns).agg(F.count(F.lit(1)).alias("n"), o.cast("long").alias("observed"), e.alias("expected"), z.alias("z"), F.when(F.abs(z) <= 2, "CONSISTENT").when(z > 2, "MORE").otherwise("FEWER").alias("status"))


def quantile_bins(rows: DataFrame, value: str, by: list[str], n: int = 10) -> DataFrame:
    """Bin of the value among the group's linear quantiles: closed on the left, the last on both sides.

    The edges come from counts of values: each lies between the values at two places of the group's order."""
    counted = rows.filter(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count(F.lit(1)).alias("_n"))
    size = counted.groupBy(*by).agg(F.sum("_n").alias("_size"))
    ranked = prefix_counts(counted, by, value, "_n").join(size, by)
    place = lambda i: (F.col("_size") - 1) * F.lit(i / n)
    holds = lambda k: (F.col("_before") <= k) & (k < F.col("_before") + F.col("_n"))
    low = [F.max(F.when(holds(F.floor(place(i))), F.col(value))) for i in range(1, n)]
    high = [F.max(F.when(holds(F.ceil(place(i))), F.col(value))) for i in range(1, n)]
    part = [F.max(place(i) - F.floor(place(i))) for i in range(1, n)]
    edges = ranked.groupBy(*by).agg(F.array(*[a + (b - a) * f for a, b, f in zip(low, high, part, strict=True)]).alias("_e"))
    met = rows.join(edges, by)
    bin_ = F.aggregate("_e", F.lit(0), lambda s, x: s + (F.col(value) >= x).cast("int"))
    return met.withColumn("bin", bin_).drop("_e")


def ks_uniform(rows: DataFrame, value: str, by: list[str]) -> DataFrame:
    """Largest distance of the values' distribution from the uniform one."""
    counted = rows.groupBy(*by, value).agg(F.count(F.lit(1)).alias("k"))
    size = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"))
    c = prefix_counts(counted, by, value, "k").join(size, by)
    high, low = (F.col("_before") + F.col("k")) / F.col("n") - F.col(value), F.col(value) - F.col("_before") / F.col("n")
    return c.groupBy(*by).agg(F.max("n").alias("n"), F.max(F.greatest(high, low)).alias("ks"))
