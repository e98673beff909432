"""Joins that check their cardinality, directories, version choices and set comparisons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.operators.timeline import _cut


def attach(rows: DataFrame, mapping: DataFrame, key: str, values: list[str]) -> DataFrame:
    """rows with the values of a mapping that must have each key once and every key of rows; else an error."""
    if not mapping.groupBy(key).count().filter("count > 1").isEmpty():
        raise ValueError("the mapping has a key more than once")
    if not rows.join(mapping, key, "left_anti").isEmpty():
        raise ValueError("the mapping lacks a row")
    return rows.join(mapping.select(key, *values), key)


def paired(rows: DataFrame, key: list[str], kind: str, left: str, right: str, value: str, same: list[str]) -> DataFrame:
    """The values of two kinds of one key side by side, where the key has both once and they agree in `same`. One aggregate, no self-join."""
    is_left, is_right = F.col(kind) == left, F.col(kind) == right
    got = rows.filter(is_left | is_right).groupBy(*key).agg(
        F.max(F.when(is_left, F.col(value))).alias("left_value"), F.max(F.when(is_right, F.col(value))).alias("right_value"), F.count_if(is_left).alias("_l"), F.count_if(is_right).alias("_r"),
        *[F.min(F.struct(F.col(c).isNull(), F.col(c))).alias(f"_lo_{c}") for c in same], *[F.max(F.struct(F.col(c).isNull(), F.col(c))).alias(f"_hi_{c}") for c in same],
    )
    agree = F.lit(True)
    for c in same:
        agree = agree & (F.col(f"_lo_{c}") == F.col(f"_hi_{c}"))
    return got.filter((F.col("_l") == 1) & (F.col("_r") == 1) & agree).select(*key, *[F.col(f"_lo_{c}.{c}").alias(c) for c in same], "left_value", "right_value")


def changed_fields(old: DataFrame, new: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """One row for each field that differs, null against null being the same; a key that one side lacks differs in the field 'row'."""
    o, n = old.alias("o"), new.alias("n")
    met = o.join(n, F.col(f"o.{key}") == F.col(f"n.{key}"), "full_outer")
    cells = [F.struct(F.lit(f).alias("field"), F.col(f"o.{f}").cast("string").alias("old"), F.col(f"n.{f}").cast("string").alias("new")) for f in fields]
    side = F.when(F.col(f"o.{key}").isNull(), F.array(F.struct(F.lit("row").alias("field"), F.lit(None).cast("string").alias("old"), F.lit("added").alias("new"))))
    side = side.when(F.col(f"n.{key}").isNull(), F.array(F.struct(F.lit("row").alias("field"), F.lit("removed").alias("old"), F.lit(None).cast("string").alias("new"))))
    return met.select(F.coalesce(F.col(f"o.{key}"), F.col(f"n.{key}")).alias(key), F.explode(side.otherwise(F.array(*cells))).alias("c")).select(key, "c.*").filter(~F.col("old").eqNullSafe(F.col("new")))


def deltas(old: DataFrame, new: DataFrame, key: str, value: str) -> DataFrame:
    """Differences of a value on the keys that both have."""
    return old.select(key, F.col(value).alias("old")).join(new.select(key, F.col(value).alias("new")), key).withColumn("delta", F.col("new") - F.col("old"))


def same_sets(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """One row: keys of both sides, of the first only and of the second only, and whether the sets are equal."""
    ends = a.select(key).distinct().withColumn("_a", F.lit(1)).join(b.select(key).distinct().withColumn("_b", F.lit(1)), key, "full_outer")
    n = ends.agg(F.count_if(F.col("_a").isNotNull() & F.col("_b").isNotNull()).alias("n_both"), F.count_if(F.col("_b").isNull()).alias("n_first"), F.count_if(F.col("_a").isNull()).alias("n_second"))
    return n.withColumn("equal", (F.col("n_first") == 0) & (F.col("n_second") == 0))


def added_counts(batches: list[DataFrame], key: str, yes: str, settled: str) -> DataFrame:
    """Counts of batches of simulated paths added up, with the share and its standard error; a key that not every batch has is an error."""
    rows = batches[0].select(key, yes, settled)
    for b in batches[1:]:
        rows = rows.unionByName(b.select(key, yes, settled))
    total = rows.groupBy(key).agg(F.sum(yes).alias(yes), F.sum(settled).alias(settled), F.count(F.lit(1)).alias("_n"))
    short = F.when(F.col("_n") != len(batches), F.raise_error(F.lit("a batch has other keys")).cast("boolean")).otherwise(True)
    p = F.try_divide(F.col(yes).cast("double"), F.col(settled).cast("double"))
    return total.filter(short).select(key, yes, settled, p.alias("p"), F.sqrt(p * (1 - p) / F.col(settled)).alias("se"))


def looked_up(rows: DataFrame, dimension: DataFrame, columns: list[str], key: str, value: str, default: float) -> DataFrame:
    """rows with the dimension's value for each of several key columns. The rows are spread by column, so each is one join whatever the dimension's size."""
    for c in columns:
        rows = rows.join(dimension.select(F.col(key).alias(c), F.col(value).alias(f"{c}_{value}")), c, "left").withColumn(f"{c}_{value}", F.coalesce(f"{c}_{value}", F.lit(default)))
    return rows


def complete_wide(rows: DataFrame, key: list[str], kind: str, kinds: list[str], value: str, meta: DataFrame) -> DataFrame:
    """One row for each key with a column for each kind and the key's metadata; keys that lack one of them are left out."""
    wide = rows.groupBy(*key).pivot(kind, kinds).agg(F.max(value))
    return wide.join(meta, key).na.drop(subset=[*kinds, *[c for c in meta.columns if c not in key]])


def directory(rows: DataFrame, key: list[str], id_column: str, order: list[Column]) -> DataFrame:
    """The id of each key that was seen last."""
    return rows.groupBy(*key).agg(F.max_by(id_column, F.struct(*order, F.col(id_column))).alias("found_id"))


def resolved(wanted: DataFrame, known: DataFrame, key: list[str], name: str) -> DataFrame:
    """wanted with the id from the directory, or UNSEEN and the name in small letters with hyphens."""
    slug = F.concat(F.lit("UNSEEN-"), F.trim(F.regexp_replace(F.lower(name), "[^a-z0-9]+", "-"), F.lit("-")))
    return wanted.join(known, key, "left").withColumn("seen", F.col("found_id").isNotNull()).withColumn("found_id", F.coalesce(F.col("found_id").cast("string"), slug))


def resolve_or_insert(ratings: DataFrame, wanted: DataFrame, key: list[str], order: list[str], defaults: dict[str, float]) -> DataFrame:
    """The ratings with a row of the defaults for each wanted key that has none; of several rows of a key the largest in that order stays."""
    best = ratings.withColumn("_n", F.row_number().over(Window.partitionBy(*key).orderBy(*[F.col(c).desc() for c in order]))).filter("_n = 1").drop("_n").withColumn("inserted", F.lit(False))
    new = wanted.select(*key).distinct().join(best, key, "left_anti")
    return best.unionByName(new.withColumns({k: F.lit(v) for k, v in defaults.items()}).withColumn("inserted", F.lit(True)), allowMissingColumns=True)


def by_alias(wanted: DataFrame, known: DataFrame, name: str, id_column: str, aliases: str, fold) -> DataFrame:
    """wanted with resolved_id: the id itself if it is known, else that of the only row with such a folded alias."""
    exact = known.select(F.col(id_column).alias(name), F.lit(True).alias("_exact")).distinct()
    names = known.select(id_column, F.explode(aliases).alias("_a")).select(fold(F.col("_a")).alias("_key"), id_column).distinct()
    alone = names.groupBy("_key").agg(F.count(F.lit(1)).alias("_n"), F.min(id_column).alias("_id")).filter("_n = 1").drop("_n")
    met = wanted.join(exact, name, "left").withColumn("_key", fold(F.col(name))).join(alone, "_key", "left")
    return met.withColumn("resolved_id", F.when(F.col("_exact"), F.col(name)).otherwise(F.col("_id"))).drop("_exact", "_key", "_id")


def latest_ready(builds: DataFrame, rejected: DataFrame, by: list[str], run: str, at: str, status: str) -> DataFrame:
    """The build of each group that was made last among those that are READY and not rejected."""
    ok = builds.filter(F.col(status) == "READY").join(rejected, run, "left_anti")
    return ok.groupBy(*by).agg(F.max(F.struct(at, run)).alias("_x")).select(*by, "_x.*")


def only_one(rows: DataFrame, by: list[str], wanted: Column) -> DataFrame:
    """Groups with exactly one wanted row, and that row; others are an error when they are read."""
    found = rows.filter(wanted).withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(*by)))
    return found.filter(F.when(F.col("_n") != 1, F.raise_error(F.lit("not exactly one row")).cast("boolean")).otherwise(True)).drop("_n")


def version_as_of(versions: DataFrame, wanted: DataFrame, by: list[str], cutoff: str, at: str, version: str, strict: bool = True) -> DataFrame:
    """wanted with asof_version: the last version of its group whose data end before its cutoff (or at it, if not strict), ties by the larger id; null, the static fit, if there is none.

    Only the different times of versions and rows are put in order, dealt out by ranges of (group, time): within a range a running maximum meets them, and what the
    ranges before hold of the group is a table of one row for each range and group. Each row then takes its time's version by an equal join, so none meets a list."""
    keys = [F.col(f"`{c}`").alias(f"_k{n}") for n, c in enumerate(by)]
    names = [f"_k{n}" for n in range(len(by))]
    known = versions.filter(F.col(at).isNotNull()).groupBy(*keys, F.col(at).alias("_t")).agg(F.max(version).alias("v")).select(*names, "_t", F.struct(F.col("_t").alias("t"), "v").alias("_v"))
    asked = wanted.select(*keys, F.col(cutoff).alias("_t")).filter("_t IS NOT NULL").distinct().withColumn("_asked", F.lit(True))
    times = known.unionByName(asked, allowMissingColumns=True).groupBy(*names, "_t").agg(F.max("_v").alias("_v"), F.max("_asked").alias("_asked"))
    dealt = _cut(times.repartitionByRange(*names, "_t").withColumn("_p", F.spark_partition_id()))
    inside = Window.partitionBy("_p", *names).orderBy("_t").rowsBetween(Window.unboundedPreceding, -1 if strict else 0)
    earlier = Window.partitionBy(*names).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    before = dealt.groupBy("_p", *names).agg(F.max("_v").alias("_v")).withColumn("_before", F.max("_v").over(earlier)).drop("_v").alias("b")
    rows = dealt.withColumn("_last", F.max("_v").over(inside)).filter("_asked").alias("r")
    same = [F.col(f"r.{c}").eqNullSafe(F.col(f"b.{c}")) for c in ("_p", *names)]
    found = rows.join(before, same).select(*[f"r.{c}" for c in names], "r._t", F.coalesce("r._last", "b._before")["v"].alias("asof_version")).alias("f")
    left = wanted.alias("w")
    met = [F.col(f"w.`{c}`") == F.col(f"f.{n}") for c, n in zip(by, names)] + [F.col(f"w.`{cutoff}`") == F.col("f._t")]
    return left.join(found, met, "left").select("w.*", "f.asof_version")


def with_both_sides(parts: list[DataFrame], match: str) -> DataFrame:
    """The rows of all parts together, of the matches that then have exactly two."""
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p, allowMissingColumns=True)
    good = rows.groupBy(match).agg(F.count(F.lit(1)).alias("_n")).filter("_n = 2").select(match)
    return rows.join(good, match, "left_semi")


def set_hash(rows: DataFrame, by: list[str], member: str) -> DataFrame:
    """sha256 of each group's distinct members in order, as a JSON list of strings. The members are ids of sources, a bounded list."""
    listed = F.array_sort(F.collect_set(F.col(member).cast("string")))
    return rows.groupBy(*by).agg(F.count_distinct(member).alias("n"), F.sha2(F.concat(F.lit("["), F.array_join(F.transform(listed, lambda x: F.concat(F.lit('"'), x, F.lit('"'))), ","), F.lit("]")), 256).alias("set_sha256"))


def extended_state(state: DataFrame, rows: DataFrame, key: str, prior: dict[str, float]) -> DataFrame:
    """The state with the prior for each key of rows that it lacks."""
    new = rows.select(key).distinct().join(state, key, "left_anti")
    return state.withColumn("is_new", F.lit(False)).unionByName(new.withColumns({k: F.lit(v) for k, v in prior.items()}).withColumn("is_new", F.lit(True)))
