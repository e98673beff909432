"""Training rows with their exclusions and provenance, target cohorts, rally counts, and predictions from fitted effects."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.selection import first_reason


def duration_rows(rows: DataFrame, tour: str, cutoff: Column, window: int = 1826, half_life: float = 730.0) -> tuple[DataFrame, DataFrame]:
    """(one row for each match that a duration model learns from, the others with the first reason against them).

    rows: two for each match, with match_id, tour, player_id, opponent_id, match_date, available_at, status, minutes, points, games, sets, tiebreaks. All facts of a match are
    brought down by one aggregate; both rows must agree in all that belongs to the match."""
    same = ["match_date", "available_at", "status", "minutes", "games", "sets", "tiebreaks"]
    facts = rows.groupBy("match_id").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("tour") == tour).alias("n_tour"), F.min("player_id").alias("a"), F.max("player_id").alias("b"), F.min("opponent_id").alias("oa"), F.max("opponent_id").alias("ob"),
        F.count_if(F.col("player_id") == F.col("opponent_id")).alias("n_self"), F.count("player_id").alias("n_players"), F.sum("points").alias("points"), F.count("points").alias("k_points"), F.min("points").alias("least_points"),
        *[F.min(c).alias(c) for c in same], *[F.max(c).alias(f"_hi_{c}") for c in same], *[F.count(c).alias(f"_k_{c}") for c in same],
    )
    whole = lambda c: (F.col(f"_k_{c}") == F.col("n")) & (F.col(c) == F.col(f"_hi_{c}"))
    age = F.date_diff(cutoff.cast("date"), F.col("match_date"))
    reason = first_reason([
        ("WRONG_OR_AMBIGUOUS_TOUR", F.col("n_tour") != F.col("n")), ("RECIPROCAL_ROW_COUNT", F.col("n") != 2),
        ("NONRECIPROCAL_PLAYERS", ~F.coalesce((F.col("n_players") == 2) & (F.col("a") != F.col("b")) & (F.col("a") == F.col("oa")) & (F.col("b") == F.col("ob")) & (F.col("n_self") == 0), F.lit(False))),
        ("MISSING_OR_INCONSISTENT_EXACT_DATE", ~whole("match_date")), ("MISSING_OR_INVALID_AVAILABILITY", ~whole("available_at")), ("AT_OR_AFTER_INFORMATION_CUTOFF", F.col("available_at") >= cutoff), ("MATCH_DATE_AFTER_CUTOFF", age < 0),
        ("OUTSIDE_TRAINING_WINDOW", age > window), ("NOT_COMPLETED", ~(whole("status") & (F.col("status") == "completed"))), ("MISSING_OR_INCONSISTENT_DURATION", ~whole("minutes")), ("NONPOSITIVE_DURATION", F.col("minutes") <= 0),
        ("MISSING_OR_NONPOSITIVE_POINTS", (F.col("k_points") != 2) | (F.col("least_points") <= 0)), ("MISSING_OR_INCONSISTENT_GAMES", ~whole("games")), ("MISSING_OR_INCONSISTENT_SETS", ~whole("sets")), ("MISSING_OR_INCONSISTENT_TIEBREAKS", ~whole("tiebreaks")),
        ("IMPOSSIBLE_EXPOSURES", (F.col("games") < 6 * F.col("sets")) | (F.col("tiebreaks") > F.col("sets")) | (F.col("points") < 4 * F.col("games"))),
    ])
    out = facts.withColumn("reason", reason).withColumn("weight", F.pow(F.lit(2.0), -age / F.lit(half_life)))
    return out.filter("reason IS NULL").select("match_id", F.col("a").alias("player_a_id"), F.col("b").alias("player_b_id"), "match_date", "minutes", "points", "games", "sets", "tiebreaks", "weight"), out.filter("reason IS NOT NULL").select("match_id", "n", "reason")


def provenance(rows: DataFrame, match: str, source: str, snapshot: str, date_source: str) -> DataFrame:
    """For each match the sorted sets of its sources and snapshots, and of the sources of its dates that are not among the snapshots."""
    got = rows.groupBy(match).agg(F.array_sort(F.collect_set(source)).alias("sources"), F.array_sort(F.collect_set(snapshot)).alias("snapshots"), F.array_sort(F.collect_set(date_source)).alias("_dates"))
    return got.withColumn("crosswalks", F.array_sort(F.array_except("_dates", "snapshots"))).drop("_dates")


def frozen_cohort(targets: DataFrame, key: list[str], wanted: Column) -> DataFrame:
    """The wanted targets with their hash, and the cohort's id: the sha256 of the hashes in order. A key that stands twice is an error.

    The id is of the hash of each of 256 classes of hashes, so no task holds more than such a class."""
    chosen = targets.filter(wanted).select(*key).withColumn("target_sha256", F.sha2(F.concat_ws("\x1f", *[F.coalesce(F.col(k).cast("string"), F.lit("")) for k in key]), 256))
    if not chosen.groupBy("target_sha256").count().filter("count > 1").isEmpty():
        raise ValueError("a target stands twice")
    parts = chosen.groupBy(F.left("target_sha256", F.lit(2)).alias("c")).agg(F.sha2(F.array_join(F.array_sort(F.collect_list("target_sha256")), ""), 256).alias("h"))
    cohort = parts.agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("c", "h"))), lambda x: x["h"]), ""), 256).alias("cohort_id"))
    return chosen.crossJoin(F.broadcast(cohort))


def rally_counts(won_first: Column, won_second: Column, won_return: Column, aces: Column, opponent_faults: Column, winners: Column, opponent_errors: Column) -> Column:
    """Points that a player won in a rally, split into own winners (without aces), the other's errors (without double faults) and the rest; status says whether they can be used."""
    eligible = won_first + won_second + won_return - aces - opponent_faults
    hit, gift = winners - aces, opponent_errors - opponent_faults
    other = eligible - hit - gift
    status = F.when(eligible.isNull() | hit.isNull() | gift.isNull(), "missing_input").when((eligible < 0) | (hit < 0) | (gift < 0) | (other < 0), "quarantined").otherwise("valid")
    return F.struct(eligible.alias("eligible"), hit.alias("winners"), gift.alias("errors"), other.alias("other"), status.alias("status"))


def predicted(contexts: DataFrame, effects: DataFrame, intercept: float, terms: list[tuple[str, str, float, float]]) -> DataFrame:
    """The linear predictor of each context and its variance from fitted effects (kind, level, mean, variance).

    terms: (kind, the context's column with the level, sign, prior variance). A level that the fit has not seen adds nothing to the mean and its prior variance."""
    out = contexts.withColumn("eta", F.lit(intercept)).withColumn("variance", F.lit(0.0))
    for i, (kind, column, sign, prior) in enumerate(terms):
        level = effects.filter(F.col("kind") == kind).select(F.col("level").alias(f"_l{i}"), F.col("mean").alias(f"_m{i}"), F.col("variance").alias(f"_v{i}"))
        out = out.join(level, F.col(column) == F.col(f"_l{i}"), "left").withColumn("eta", F.col("eta") + sign * F.coalesce(f"_m{i}", F.lit(0.0))).withColumn("variance", F.col("variance") + F.coalesce(f"_v{i}", F.lit(prior))).drop(f"_l{i}", f"_m{i}", f"_v{i}")
    return out


def inactive_posterior(mean: np.ndarray, covariance: np.ndarray, affected: np.ndarray, multiplier: float | None, inflation: float = 1.0) -> tuple[np.ndarray, np.ndarray]:
    """Means and covariance after a layoff: affected means shrink by the multiplier and their deviations grow by the root of the inflation.

    A player never seen (None) goes to 0 without more variance. The covariance stays positive semidefinite, as it is scaled from both sides."""
    affected = np.asarray(affected, bool)
    shrink = np.where(affected, 0.0 if multiplier is None else multiplier, 1.0)
    grow = np.where(affected, 1.0 if multiplier is None else np.sqrt(inflation), 1.0)
    out = covariance * np.outer(grow, grow)
    if np.linalg.eigvalsh((out + out.T) / 2).min() < -1e-9 * max(1.0, np.abs(out).max()):
        raise ValueError("the covariance is not positive semidefinite")
    return mean * shrink, out


def calibration_summary(rows: DataFrame, lock: list[str], order: str, status: str, p: str, y: str, se: str, tolerance: float) -> DataFrame:
    """One row: targets by status, scores of the settled ones, the Monte Carlo errors' median, 95th percentile and share within tolerance, and how many of the locks' first rows are retirements."""
    from tidemark.operators.evaluate import brier, log_loss

    settled = F.col(status) == "SETTLED"
    first = rows.groupBy(*lock).agg(F.min_by(status, F.col(order)).alias("_s"))
    of = lambda x: F.avg(F.when(settled, x))
    total = rows.agg(
        F.count(F.lit(1)).alias("n"), F.count_if(settled).alias("n_settled"), F.count_if(F.col(status) == "VOID").alias("n_void"), of(brier(F.col(p), F.col(y))).alias("brier"), of(log_loss(F.col(p), F.col(y))).alias("log_loss"),
        F.percentile_approx(se, F.array(F.lit(0.5), F.lit(0.95)), 100_000).alias("_q"), F.avg((F.col(se) <= tolerance).cast("double")).alias("within_tolerance"),
    )
    return total.crossJoin(first.agg(F.count(F.lit(1)).alias("n_locks"), F.avg((F.col("_s") == "VOID").cast("double")).alias("void_first_share"))).select("*", F.col("_q")[0].alias("se_median"), F.col("_q")[1].alias("se_p95")).drop("_q")
