"""Point-in-time selection, duplicates, revisions and consistency checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def cutoff_codes(rows: DataFrame, group: str, available: str, cutoff: Column) -> DataFrame:
    """cutoff_code for each row: null if its whole group was known strictly before the cutoff. A null group is a group."""
    w = Window.partitionBy(group)
    n, known = F.count(F.lit(1)).over(w), F.count(available).over(w)
    lo, hi = F.min(available).over(w), F.max(available).over(w)
    code = F.when(known < n, "UNKNOWN_AVAILABILITY").when(lo != hi, "INCONSISTENT_MATCH_AVAILABILITY").when(lo >= cutoff, "AT_OR_AFTER_INFORMATION_CUTOFF")
    return rows.withColumn("cutoff_code", code)


def select_before_cutoff(rows: DataFrame, group: str, available: str, cutoff: Column) -> tuple[DataFrame, DataFrame]:
    """(selected, excluded with cutoff_code)."""
    coded = cutoff_codes(rows, group, available, cutoff)
    return coded.filter("cutoff_code IS NULL").drop("cutoff_code"), coded.filter("cutoff_code IS NOT NULL")


def assert_before(rows: DataFrame, available: str, cutoff: Column) -> DataFrame:
    """The rows, with an error at run time for any that was not known before the cutoff. The check is a filter, so no choice of columns takes it away."""
    return rows.filter(F.when(F.col(available) < cutoff, F.lit(True)).otherwise(F.raise_error(F.lit(f"{available} is not before the cutoff")).cast("boolean")))


def availability(source_date: Column, lag_days: int) -> Column:
    """Midnight UTC of the date and lag_days, of one at least, later."""
    if lag_days < 1:
        raise ValueError("the lag is one day at least")
    return F.date_add(source_date.cast("date"), lag_days).cast("timestamp")


def first_reason(reasons: list[tuple[str, Column]]) -> Column:
    """The first reason that holds, null if none does; a test that is null does not hold."""
    out = None
    for name, test in reasons:
        test = F.coalesce(test, F.lit(False))
        out = F.when(test, name) if out is None else out.when(test, name)
    return out


def keep(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in that order."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("_n = 1").drop("_n")


def duplicate_classes(rows: DataFrame, key: list[str], fingerprint: Column, participants: Column) -> DataFrame:
    """Class of each key with two rows or more."""
    grouped = rows.groupBy(*key).agg(F.count(F.lit(1)).alias("n_rows"), F.countDistinct(fingerprint).alias("n_prints"), F.countDistinct(participants).alias("n_pairs"))
    kind = F.when(F.col("n_pairs") > 1, "MATCH_KEY_COLLISION").when(F.col("n_prints") == 1, "EXACT_DUPLICATE").otherwise("CONFLICTING_RECORDS")
    return grouped.filter("n_rows >= 2").withColumn("duplicate_class", kind)


def latest_revision(rows: DataFrame, key: str, available: str, payload: list[str], cutoff: Column) -> DataFrame:
    """The row of each key that became known last before the cutoff; conflict says that rows of that time differ."""
    seen = rows.filter(F.col(available) < cutoff)
    top = seen.withColumn("_r", F.dense_rank().over(Window.partitionBy(key).orderBy(F.col(available).desc()))).filter("_r = 1")
    one = F.min(F.struct(*payload))
    return top.groupBy(key, available).agg(one.alias("p"), (F.count_distinct(F.struct(*payload)) > 1).alias("conflict")).select(key, available, "p.*", "conflict")


def as_of(left: DataFrame, right: DataFrame, on: list[str], left_time: str, right_time: str, values: list[str], strict: bool = True) -> DataFrame:
    """Each left row with the values of the last right row before it (or at it, if not strict), found in one pass over both, sorted by key and time.

    Rows of the left and right sides share one window, so a key's rows are read once and no pair is formed. Of right rows of one time the largest values count."""
    payload = F.struct(F.col(right_time).alias("t"), *[F.col(v) for v in values])
    a = left.select(*on, F.col(left_time).alias("_t"), F.lit(0 if strict else 1).alias("_side"), F.struct(*left.columns).alias("_l"), F.lit(None).cast(right.select(payload.alias("p")).schema["p"].dataType).alias("_r"))
    b = right.select(*on, F.col(right_time).alias("_t"), F.lit(1 if strict else 0).alias("_side"), F.lit(None).cast(a.schema["_l"].dataType).alias("_l"), payload.alias("_r"))
    order = Window.partitionBy(*on).orderBy("_t", "_side", F.col("_r").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    met = a.unionByName(b).withColumn("_last", F.last("_r", ignorenulls=True).over(order)).filter("_l IS NOT NULL")
    return met.select("_l.*", F.col("_last.t").alias(f"asof_{right_time}"), *[F.col(f"_last.{v}").alias(f"asof_{v}") for v in values])


def consistent(column: str) -> Column:
    """Aggregate: all rows of the group agree, null with null."""
    return (F.count_distinct(column) + F.max(F.col(column).isNull().cast("int"))) <= 1
