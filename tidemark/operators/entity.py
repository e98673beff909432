"""Entity resolution: names, signatures, unordered pairs and the one-to-one date crosswalk."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType
from pyspark.sql.window import Window


def tokens(text: Column) -> Column:
    """Runs of ASCII letters and digits, lower-cased."""
    return F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0))


def surname_keys(words: Column, most: int = 4) -> Column:
    """The last 1, 2, ... tokens joined, each with the first token's initial; a name of one token has none."""
    n = F.least(F.lit(most), F.size(words) - 1)
    keys = F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda k: F.concat(F.array_join(F.slice(words, -k, k), ""), F.lit("|"), F.left(F.element_at(words, 1), F.lit(1))))
    return F.when(F.size(words) >= 2, keys).otherwise(F.array().cast("array<string>"))


def signature(words: Column) -> Column:
    """First initial and last token."""
    return F.when(F.size(words) >= 1, F.concat_ws("|", F.left(F.element_at(words, 1), F.lit(1)), F.element_at(words, -1)))


def pair(a: Column, b: Column) -> Column:
    """The two in order, so that a pair is the same from both sides."""
    return F.array_sort(F.array(a, b))


def unordered_join(left: DataFrame, right: DataFrame, left_pair: tuple[str, str], right_pair: tuple[str, str], on: list[str], p: str) -> DataFrame:
    """Left and right rows of the same two sides in any order, equal in `on`. The right's p, a probability of its first side, is turned to the left's first side.

    A pair that a side holds more than once, or of one name twice, is not joined."""
    key = lambda a, b: pair(F.col(a), F.col(b)).alias("_key")
    one = lambda df, ends: df.select("*", key(*ends)).filter(F.col(ends[0]) != F.col(ends[1])).withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(*on, "_key"))).filter("_n = 1").drop("_n")
    other = one(right, right_pair).select(*on, "_key", F.col(right_pair[0]).alias("_first"), F.col(p).alias("_p"))
    met = one(left, left_pair).join(other, [*on, "_key"])
    same = F.col("_first") == F.col(left_pair[0])
    return met.withColumn(p, F.when(same, F.col("_p")).otherwise(1 - F.col("_p"))).withColumn("turned", ~same).drop("_key", "_first", "_p")


def resolve_names(known: DataFrame, wanted: DataFrame, key: str, id_column: str) -> DataFrame:
    """wanted with n_ids, resolved_id and resolution: MATCHED for one id of the key, AMBIGUOUS for more, NEW for none."""
    ids = known.groupBy(key).agg(F.array_sort(F.collect_set(id_column)).alias("_ids"))
    n = F.coalesce(F.size("_ids"), F.lit(0))
    out = wanted.join(ids, key, "left").withColumn("n_ids", n.cast("long"))
    return out.withColumn("resolved_id", F.when(n == 1, F.element_at("_ids", 1))).withColumn("resolution", F.when(n == 1, "MATCHED").when(n > 1, "AMBIGUOUS").otherwise("NEW")).drop("_ids")


def crosswalk(source: DataFrame, other: DataFrame, keys: list[str], day: str, before: int, after: int, structure: list[str], source_id: str, other_id: str) -> DataFrame:
    """One row for each source row: status and other_id.

    Keys that are arrays (names with several keys) meet if any of their members do; a pair that meets by more than one of them counts once.
    Candidates have equal keys and a date from `before` days before to `after` days after the source's; strict ones agree in structure as well.
    One strict candidate is MATCHED, more AMBIGUOUS; candidates but no strict one STRUCTURAL_CONFLICT; none UNMATCHED. Then all
    source rows that share keys, date and structure with another are DUPLICATE_SOURCE_MATCH, and of rows still MATCHED those that share
    a candidate REUSED_AUGMENTATION_ROW. Only a MATCHED row keeps other_id."""
    several = [k for k in keys if isinstance(source.schema[k].dataType, ArrayType)]
    s, o = ((lambda d: d.withColumns({k: F.explode(k) for k in several}) if several else d)(x).alias(n) for x, n in ((source, "s"), (other, "o")))
    gap = F.date_diff(F.col(f"o.{day}"), F.col(f"s.{day}"))
    same = [F.col(f"s.{k}") == F.col(f"o.{k}") for k in keys] + [gap >= -before, gap <= after]
    strict = F.lit(True)
    for c in structure:
        strict = strict & F.col(f"s.{c}").eqNullSafe(F.col(f"o.{c}"))
    pairs = s.join(o, same).select(F.col(f"s.{source_id}").alias(source_id), F.col(f"o.{other_id}").alias("_id"), strict.alias("_strict"))
    pairs = pairs.distinct() if several else pairs
    met = pairs.groupBy(source_id).agg(F.count(F.lit(1)).alias("n"), F.count_if("_strict").alias("n_strict"), F.min(F.when(F.col("_strict"), F.col("_id"))).alias("_o"))
    rows = source.join(met, source_id, "left")
    status = F.when(F.col("n_strict") == 1, "MATCHED").when(F.col("n_strict") > 1, "AMBIGUOUS").when(F.col("n") > 0, "STRUCTURAL_CONFLICT").otherwise("UNMATCHED")
    twin = F.count(F.lit(1)).over(Window.partitionBy(*keys, day, *structure))
    rows = rows.withColumn("status", F.when(twin > 1, "DUPLICATE_SOURCE_MATCH").otherwise(status))
    # Only the candidates of MATCHED rows are counted, so rows without one meet in no place.
    uses = rows.filter("status = 'MATCHED'").groupBy("_o").agg(F.count(F.lit(1)).alias("_uses")).filter("_uses > 1")
    rows = rows.join(uses, "_o", "left")
    rows = rows.withColumn("status", F.when((F.col("status") == "MATCHED") & F.col("_uses").isNotNull(), "REUSED_AUGMENTATION_ROW").otherwise(F.col("status")))
    return rows.select(source_id, "status", F.when(F.col("status") == "MATCHED", F.col("_o")).alias("matched_id"))
