"""From raw rows to typed candidates: cutoffs before anything is parsed, coverage, codes and eligibility."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import scalar as S
from tidemark.functions import text as T
from tidemark.operators.counts import INPUTS
from tidemark.operators.selection import first_reason

#: The raw statistics of a side and what they are called from here on.
STATS = {
    "ace": "aces", "df": "double_faults", "svpt": "service_points", "1stIn": "first_serves_in", "1stWon": "first_serve_points_won", "2ndWon": "second_serve_points_won",
    "SvGms": "service_games", "bpSaved": "break_points_saved", "bpFaced": "break_points_faced",
}
#: Of these no count can be made without.
CORE = sorted({c for names in INPUTS.values() for c in names})


def known_at(source_date: Column, lag_days: int, source_available: Column | None = None) -> Column:
    """When a row was known: its date and the lag, or later if the whole source came later."""
    derived = F.date_add(source_date, lag_days).cast("timestamp")
    return derived if source_available is None else F.when(derived.isNotNull(), F.greatest(derived, source_available))


def raw_before_cutoff(raw: DataFrame, date: str, lag_days: int, cutoff: Column, source_available: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """(rows known before the cutoff, the others with cutoff_exclusion_code); only the date's text is parsed."""
    at = known_at(S.parse_date(F.col(date)), lag_days, source_available)
    coded = raw.withColumn("available_at", at).withColumn("cutoff_exclusion_code", first_reason([("UNKNOWN_AVAILABILITY", F.col("available_at").isNull()), ("AT_OR_AFTER_INFORMATION_CUTOFF", F.col("available_at") >= cutoff)]))
    return coded.filter("cutoff_exclusion_code IS NULL").drop("cutoff_exclusion_code"), coded.filter("cutoff_exclusion_code IS NOT NULL")


def exact_before_cutoff(raw: DataFrame, date: str, status: str, cutoff: Column) -> tuple[DataFrame, DataFrame]:
    """Rows whose exact date was found count from the next midnight on; one that ends at the cutoff itself is in."""
    done = F.date_add(S.parse_date(F.col(date)), 1).cast("timestamp")
    missing = done.isNull() | ~F.col(status).eqNullSafe("MATCHED")
    coded = raw.withColumn("completed_at", F.when(~missing, done)).withColumn("cutoff_exclusion_code", first_reason([("MISSING_EXACT_MATCH_DATE", missing), ("AT_OR_AFTER_FORECAST_CUTOFF", done > cutoff)]))
    return coded.filter("cutoff_exclusion_code IS NULL").drop("cutoff_exclusion_code"), coded.filter("cutoff_exclusion_code IS NOT NULL")


def retrospective(rows: DataFrame, match: str, date: str, cutoff: Column, policy: str) -> tuple[DataFrame, DataFrame]:
    """Whole matches by their date: none missing, all the same, before the cutoff's day. Both parts name the policy."""
    facts = rows.groupBy(match).agg(F.count(F.lit(1)).alias("_n"), F.count(date).alias("_k"), F.min(date).alias("_lo"), F.max(date).alias("_hi"))
    code = first_reason([("MISSING_MATCH_DATE", F.col("_k") < F.col("_n")), ("INCONSISTENT_MATCH_DATE", F.col("_lo") != F.col("_hi")), ("AT_OR_AFTER_FORECAST_CUTOFF", F.col("_hi") >= cutoff)])
    coded = rows.join(facts.select(F.col(match).alias("_m"), code.alias("exclusion_code")), F.col(match).eqNullSafe(F.col("_m"))).drop("_m").withColumn("policy", F.lit(policy))
    return coded.filter("exclusion_code IS NULL").drop("exclusion_code"), coded.filter("exclusion_code IS NOT NULL")


def coverage(rows: DataFrame, date: str, first: str, last: str) -> DataFrame:
    """One row: the rows, those without a date, and those outside of what the source says it covers."""
    d = F.col(date)
    return rows.agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(d.isNull()).alias("n_missing"), F.count_if(~d.between(F.to_date(F.lit(first)), F.to_date(F.lit(last)))).alias("n_outside"), F.min(d).alias("first"), F.max(d).alias("last"))


def covered(rows: DataFrame, date: str, first: str, last: str) -> DataFrame:
    """The rows, or an error that counts those outside of the declared days."""
    n = coverage(rows, date, first, last).head()["n_outside"]
    if n:
        raise ValueError(f"{n} rows outside of the declared coverage")
    return rows


def first_present(rows: DataFrame, names: list[str]) -> Column:
    """The first of these columns that the table has (not the first that is not null); null if it has none."""
    known = next((n for n in names if n in rows.columns), None)
    return F.lit(None).cast("string") if known is None else F.col(f"`{known}`")


def side_stats(raw: DataFrame, prefix: str, keep: list[str]) -> DataFrame:
    """The statistics of a side as integers by their names, and in invalid_fields the core ones that are malformed."""
    parsed = {name: S.optional_integer(first_present(raw, [f"{prefix}{column}"]).cast("string")) for column, name in STATS.items()}
    bad = F.array_compact(F.array(*[F.when(parsed[c][1], F.lit(c)) for c in CORE]))
    return raw.select(*keep, *[v.alias(n) for n, (v, _) in parsed.items()], bad.alias("invalid_fields"))


def candidates(raw: DataFrame, lag_days: int, namespace: str, tour: str, source_available: Column | None = None) -> DataFrame:
    """Raw rows with identity_code, fatal_codes, warning_codes, match_id, source_date, best_of, score and available_at.

    A row without its identities gets only the first code that is missing; what is wrong with the rest is told all at once. A missing score is a warning."""
    text = {c: S.optional_text(F.col(c).cast("string")) for c in ("winner_id", "loser_id", "tourney_id", "match_num", "winner_name", "loser_name")}
    identity = first_reason([
        ("MISSING_WINNER_ID", text["winner_id"].isNull()), ("MISSING_LOSER_ID", text["loser_id"].isNull()), ("SAME_PLAYER", text["winner_id"] == text["loser_id"]),
        ("MISSING_TOURNAMENT_ID", text["tourney_id"].isNull()), ("MISSING_MATCH_NUMBER", text["match_num"].isNull()),
    ])
    date = S.parse_date(F.col("tourney_date").cast("string"))
    best_text = S.optional_text(F.col("best_of").cast("string"))
    best = F.when(best_text.isin("3", "5"), best_text).cast("int")
    rows = T.with_scores(raw.withColumns({"identity_code": identity, "source_date": date, "_valid_best": best}), "score", F.coalesce(best, F.lit(3)), "score_check")
    codes = F.when(~F.col("score_check.valid"), F.col("score_check.anomaly_codes")).otherwise(F.array().cast("array<string>"))
    own = F.array_compact(F.array(F.when(F.col("source_date").isNull(), F.lit("MALFORMED_MATCH_DATE")), F.when(F.col("_valid_best").isNull(), F.lit("MALFORMED_BEST_OF"))))
    ok = F.col("identity_code").isNull()
    empty = F.array().cast("array<string>")
    match_id = S.stable_id(F.lit(namespace), F.lit(tour), text["tourney_id"], text["match_num"], F.array_join(F.array_sort(F.array(text["winner_id"], text["loser_id"])), ","))
    return rows.withColumns({
        "fatal_codes": F.when(ok, F.concat(own, F.array_remove(codes, "SCORE_MISSING"))).otherwise(empty), "warning_codes": F.when(ok, F.filter(codes, lambda c: c == "SCORE_MISSING")).otherwise(empty),
        "match_id": F.when(ok, match_id), "best_of": F.coalesce("_valid_best", F.lit(3)), "available_at": known_at(F.col("source_date"), lag_days, source_available),
    }).drop("_valid_best")


def prepared(counts: DataFrame, component: str, cutoff: Column, available: str, observed: str, keys: list[str], window: int = 1095, half_life: float = 365.0) -> tuple[DataFrame, DataFrame]:
    """(rows of one component that a fit takes, with weight, in the one order that a fit sees them; the count of rows for each reason to leave one out).

    Equal keys and a status that does not agree with eligible are errors of the table and are counted as such."""
    rows = counts.filter(F.col("component") == component)
    age = F.date_diff(cutoff.cast("date"), F.col(observed).cast("date"))
    twins = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_twins"))
    rows = rows.join(twins, keys)
    reason = first_reason([
        ("DUPLICATE_KEY", F.col("_twins") > 1), ("STATUS_DISAGREES", F.col("eligible") != (F.col("status") == "valid")), ("NOT_ELIGIBLE", ~F.col("eligible")), ("UNKNOWN_AVAILABILITY", F.col(available).isNull()),
        ("AT_OR_AFTER_INFORMATION_CUTOFF", F.col(available) >= cutoff), ("NO_OBSERVATION_TIME", F.col(observed).isNull()), ("AFTER_CUTOFF_DATE", age < 0), ("OUTSIDE_WINDOW", age > window),
    ])
    rows = rows.withColumn("weight", S.recency_weight(age, half_life, window)).withColumn("reason", reason).drop("_twins")
    return rows.filter("reason IS NULL").drop("reason").orderBy(observed, *keys), rows.groupBy(F.coalesce("reason", F.lit("INCLUDED")).alias("reason")).agg(F.count(F.lit(1)).alias("n_rows"))


def observation_time(match_date: Column, source_date: Column) -> tuple[Column, Column]:
    """The match's own date, else the source's; and whether it is the source's."""
    return F.coalesce(match_date, source_date), match_date.isNull() & source_date.isNotNull()


def elo_eligible(date: Column, cutoff: Column, surface: Column, winner: Column, loser: Column, score: Column, level: Column, denied: list[str]) -> Column:
    """Whether a match moves ratings: before the cutoff, on a known surface, between two named singles players, with a played score, at a level that counts."""
    named = lambda n: F.coalesce(F.trim(n), F.lit("")) != ""
    played = score.rlike(r"\d+-\d+") & ~F.upper(score).rlike(r"W/O|WALKOVER|BYE")
    return F.coalesce((date < cutoff) & T.surface(surface).isNotNull() & named(winner) & named(loser) & ~F.concat(winner, loser).contains("/") & played & ~F.coalesce(F.upper(level), F.lit("")).isin(denied), F.lit(False))
