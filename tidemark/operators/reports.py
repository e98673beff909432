"""Reports on forecasts, settlements, durations and simulated paths, and the gates that read them."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.functions import scalar as S
from tidemark.operators.evaluate import brier, log_loss
from tidemark.operators.selection import first_reason


def family_report(rows: DataFrame, family: str, status: str, p: str, y: str) -> DataFrame:
    """For each family its targets by status, and the score and calibration of the settled ones."""
    settled = F.col(status) == "SETTLED"
    of = lambda x: F.avg(F.when(settled, x))
    return rows.groupBy(family).agg(
        F.count(F.lit(1)).alias("n_targets"), F.count_if(settled).alias("n_settled"), F.count_if(F.col(status) == "VOID").alias("n_void"), F.count_if(F.col(status) == "UNAVAILABLE").alias("n_unavailable"),
        F.count_if(F.col(status) == "DISABLED").alias("n_disabled"), of(brier(F.col(p), F.col(y))).alias("brier"), of(F.col(p)).alias("mean_p"), of(F.col(y)).alias("frequency"),
    )


def metric_rows(rows: DataFrame, y: str, variants: dict[str, str], by: str) -> DataFrame:
    """Scores of several forecasts of the same outcomes, overall and by group: forecasts are unpivoted and one scan serves all sets."""
    long = rows.select(y, by, F.explode(F.array(*[F.struct(F.lit(v).alias("variant"), F.col(c).alias("p")) for v, c in variants.items()])).alias("x")).select(y, by, "x.*")
    p, t = F.col("p"), F.col(y)
    scored = long.withColumns({"_b": brier(p, t), "_l": log_loss(p, t), "_h": ((p >= 0.5).cast("int") == t).cast("int")})
    return scored.groupingSets([["variant"], ["variant", by]], "variant", by).agg(F.count(F.lit(1)).alias("n"), F.avg("_b").alias("brier"), F.avg("_l").alias("log_loss"), F.avg("_h").alias("accuracy"))


def compared(rows: DataFrame, y: str, a: str, b: str, by: list[str]) -> DataFrame:
    """Mean scores of two forecasts and how often each is nearer."""
    x, z = brier(F.col(a), F.col(y)), brier(F.col(b), F.col(y))
    return rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.avg(x).alias("brier_a"), F.avg(z).alias("brier_b"), F.count_if(x < z).alias("a_better"), F.count_if(z < x).alias("b_better"), F.count_if(x == z).alias("tied"))


def audit(rows: DataFrame, p: str, y: str, sets: list[list[str]], columns: list[str]) -> DataFrame:
    """Bias with its standard error, score, skill over a half and accuracy."""
    e, b = F.col(y) - F.col(p), brier(F.col(p), F.col(y))
    hit = ((F.col(p) >= 0.5).cast("int") == F.col(y)).cast("int")
    n = F.count(F.lit(1))
    return rows.withColumns({"_e": e, "_b": b, "_hit": hit}).groupingSets([[F.col(c) for c in s] for s in sets], *columns).agg(
        n.alias("n"), F.avg("_e").alias("bias"), F.sqrt(F.try_divide(F.var_samp("_e"), F.count(F.lit(1)).cast("double"))).alias("bias_se"), F.avg("_b").alias("brier"), (1 - F.avg("_b") / 0.25).alias("skill"), F.avg("_hit").alias("accuracy")
    )


def score_distribution(paths: DataFrame, winner: str, sets_a: str, sets_b: str, games: str, target: int) -> DataFrame:
    """Paths by winner and sets, each with the checks that the winner has the target of sets and the games lie in their bounds."""
    won = F.when(F.col(winner) == 0, F.col(sets_a)).otherwise(F.col(sets_b))
    lost = F.when(F.col(winner) == 0, F.col(sets_b)).otherwise(F.col(sets_a))
    n_sets = F.col(sets_a) + F.col(sets_b)
    ok = (won == target) & (lost < target) & F.col(games).between(6 * n_sets, 13 * n_sets)
    rows = paths.withColumn("_ok", F.coalesce(ok, F.lit(False)))
    return rows.groupBy(winner, sets_a, sets_b).agg(F.count(F.lit(1)).alias("n_paths"), F.count_if(~F.col("_ok")).alias("n_incoherent"), F.avg(games).alias("mean_games"))


def service_totals(points: DataFrame, by: list[str], first_in: str, ace: str, double: str, won: str) -> DataFrame:
    """Point records as the counts that components are made of: each with its own denominator."""
    f, a, d, w = (F.col(c) for c in (first_in, ace, double, won))
    return points.groupBy(*by).agg(
        F.count(F.lit(1)).alias("service_points"), F.count_if(f).alias("first_serves_in"), F.count_if(f & a).alias("aces"), F.count_if(f & w).alias("first_serve_points_won"), F.count_if(~f & d).alias("double_faults"), F.count_if(~f & ~d & w).alias("second_serve_points_won")
    )


def residual_summary(rows: DataFrame, actual: str, center: str, bands: Column, x: str) -> DataFrame:
    """By band: errors' mean and median, absolute and squared; and their correlation with x."""
    e = F.col(actual) - F.col(center)
    rows = rows.withColumn("_e", e).withColumn("band", bands)
    return rows.groupBy("band").agg(F.count(F.lit(1)).alias("n"), F.avg("_e").alias("mean_error"), F.percentile_approx("_e", 0.5, 10_000).alias("_m"), F.avg(F.abs("_e")).alias("mae"), F.sqrt(F.avg(F.col("_e") * F.col("_e"))).alias("rmse"), F.corr("_e", x).alias("r")).drop("_m")


def interval_coverage(rows: DataFrame, actual: str, center: str, scale: str, levels: dict[float, float]) -> DataFrame:
    """For each level, whose quantile of the residual is given, the share of rows within, and the mean width."""
    each = F.explode(F.array(*[F.struct(F.lit(level).alias("level"), F.lit(q).alias("q")) for level, q in levels.items()]))
    far = F.abs(F.col(actual) - F.col(center)) / F.col(scale)
    return rows.select(far.alias("_z"), F.col(scale).alias("_s"), each.alias("x")).groupBy(F.col("x.level").alias("level")).agg(F.count(F.lit(1)).alias("n"), F.avg((F.col("_z") <= F.col("x.q")).cast("double")).alias("coverage"), F.avg(2 * F.col("_s") * F.col("x.q")).alias("width"))


def match_audit(rows: DataFrame, match: str, player: str, minutes: str, points: str, date: str, retired: Column) -> DataFrame:
    """Of each event's matches: usable ones (two rows, both with minutes and points), their days, players and retirements. Two levels of aggregates."""
    each = rows.groupBy(match).agg(F.count(F.lit(1)).alias("n"), F.min(minutes).alias("m"), F.min(points).alias("p"), F.count(minutes).alias("km"), F.count(points).alias("kp"), F.min(date).alias("d"), F.max(retired.cast("int")).alias("r"))
    good = (F.col("n") == 2) & (F.col("km") == 2) & (F.col("kp") == 2) & (F.col("m") > 0) & (F.col("p") > 0)
    total = each.agg(F.count(F.lit(1)).alias("n_matches"), F.count_if(good).alias("n_usable"), F.min("d").alias("first"), F.max("d").alias("last"), F.sum("r").alias("n_retired"))
    return total.crossJoin(rows.agg(F.count_distinct(player).alias("n_players")))


def coverage_report(rows: DataFrame, reason: str, known: Column, band: str) -> DataFrame:
    """Counts by reason and by band, and of both how many have a known time."""
    long = rows.select(F.explode(F.array(F.struct(F.lit("reason").alias("kind"), F.coalesce(reason, F.lit("INCLUDED")).alias("name")), F.struct(F.lit("band").alias("kind"), F.col(band).alias("name")))).alias("x"), known.cast("int").alias("k"))
    return long.groupBy("x.kind", "x.name").agg(F.count(F.lit(1)).alias("n"), F.sum("k").alias("n_known"))


def reconciled(included: DataFrame, excluded: DataFrame, total: DataFrame) -> DataFrame:
    """One row: what is in, what is out, all there were, and whether they add up."""
    n = [df.agg(F.count(F.lit(1)).alias(name)) for df, name in ((included, "n_included"), (excluded, "n_excluded"), (total, "n_all"))]
    return n[0].crossJoin(n[1]).crossJoin(n[2]).withColumn("adds_up", F.col("n_included") + F.col("n_excluded") == F.col("n_all"))


def settlement_frequency(rows: DataFrame, by: list[str], p_settled: str, p_void: str, resolution: str) -> DataFrame:
    """Predicted and observed shares of settled and void targets among those that could be either."""
    settled, void = F.col(resolution).isin("YES", "NO"), F.col(resolution) == "VOID"
    rows = rows.filter(settled | void)
    return rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.avg(p_settled).alias("predicted_settled"), F.avg(settled.cast("double")).alias("observed_settled"), F.avg(p_void).alias("predicted_void"), F.avg(void.cast("double")).alias("observed_void"))


def settled_job(job: DataFrame, official: DataFrame, match: str) -> DataFrame:
    """Forecasts with the official result: a reason where it cannot be settled, the outcome where it can."""
    met = job.join(official, match, "left")
    reason = first_reason([("NO_OFFICIAL_RESULT", F.col("official_status").isNull()), ("NOT_COMPLETED", F.col("official_status") != "completed"), ("NO_VALUE", F.col("official_value").isNull())])
    over = F.col("official_value") > F.col("threshold")
    return met.withColumn("reason", reason).withColumn("outcome", F.when(F.col("reason").isNull(), F.when(over, "YES").otherwise("NO")))


def ordered_folds(rows: DataFrame, fold: str, at: str) -> DataFrame:
    """The bounds of each fold, and whether the next one begins after it ends. A table of a few folds."""
    bounds = rows.groupBy(fold).agg(F.count(F.lit(1)).alias("n"), F.min(at).alias("first"), F.max(at).alias("last"))
    following = bounds.select((F.col(fold) - 1).alias(fold), F.col("first").alias("_next"))
    return bounds.join(following, fold, "left").withColumn("in_order", F.coalesce(F.col("last") < F.col("_next"), F.lit(True))).drop("_next")


def hash_sample(rows: DataFrame, by: list[str], key: Column, n: int) -> DataFrame:
    """The n rows of each group with the smallest hashes of their key."""
    return rows.withColumn("_h", F.sha2(key.cast("string"), 256)).withColumn("_n", F.row_number().over(Window.partitionBy(*by).orderBy("_h"))).filter(F.col("_n") <= n).drop("_n", "_h")


def best_ridge(candidates: DataFrame, by: list[str], l2: str, score: str, null_score: str, least_gain: float) -> DataFrame:
    """The candidate of the least score, ties to the stronger ridge; none where it gains less than least_gain on the null model."""
    best = candidates.groupBy(*by).agg(F.min(F.struct(F.col(score).alias("s"), (-F.col(l2)).alias("l"))).alias("b"), F.max(null_score).alias("null_score"))
    gain = F.col("null_score") - F.col("b.s")
    return best.select(*by, F.when(gain >= least_gain, -F.col("b.l")).alias("l2"), F.col("b.s").alias("score"), gain.alias("gain"), (gain >= least_gain).alias("adjusted"))


def recommendation(intervals: DataFrame, by: list[str], better: dict[str, float], margin: str, complete: Column) -> DataFrame:
    """PASS, FAIL or INCONCLUSIVE from rows (metric, difference, ci_upper, margin): a gated metric must be better by its gate with an interval under 0, every other must not pass its margin."""
    gate = F.create_map(*[F.lit(x) for kv in better.items() for x in kv])
    need = F.try_element_at(gate, F.col("metric"))
    bad = F.when(need.isNotNull(), (F.col("difference") > -need) | (F.col("ci_upper") >= 0)).otherwise(F.col("ci_upper") > F.col(margin))
    out = intervals.groupBy(*by).agg(F.array_sort(F.collect_set(F.when(bad, F.col("metric")))).alias("failed"), F.min(complete.cast("int")).alias("_c"))
    return out.select(*by, F.array_join("failed", ",").alias("failed"), F.when(F.size("failed") > 0, "FAIL").when(F.col("_c") == 0, "INCONCLUSIVE").otherwise("PASS").alias("recommendation"))


# Simulated shares: when more paths are needed.


def integer_bucket(k: Column) -> tuple[Column, Column]:
    """The share from which and to which a whole percent stands."""
    return F.greatest(F.lit(0.0), (k - 0.5) / 100), F.least(F.lit(1.0), (k + 0.5) / 100)


def interval_integer(low: Column, high: Column) -> Column:
    """The whole percent that all of an interval stands for, or null."""
    a, b = S.percent_half_up(low), S.percent_half_up(high)
    return F.when(a == b, a)


def escalation(p: Column, settled: Column, se: Column, extreme: float = 0.03, least: int = 1000, window: float = 0.001, errors: float = 2.0) -> Column:
    """The sorted reasons to simulate more: an extreme share, few settled paths, a whole percent that hangs on chance."""
    far = F.abs(p * 100 - (F.floor(p * 100) + 0.5)) / 100
    near_edge = F.least(far, 1 / F.lit(100.0) - far)
    reasons = [("FEWER_THAN_%d_SETTLED_PATHS" % least, settled < least), ("INTEGER_SUBMISSION_MC_SENSITIVITY", (near_edge <= window) & (near_edge <= errors * se)), ("PROBABILITY_ABOVE_97_PERCENT", p > 1 - extreme), ("PROBABILITY_BELOW_3_PERCENT", p < extreme)]
    return F.array_compact(F.array(*[F.when(test, F.lit(name)) for name, test in reasons]))


def stopping(settled: Column, p: Column, low: Column, high: Column, terminal: Column) -> Column:
    """INTEGER_STABLE once the interval stands for the share's own whole percent; else CONTINUE, or what it is called when paths are used up."""
    stable = F.coalesce(interval_integer(low, high) == S.percent_half_up(p), F.lit(False))
    return F.when(settled == 0, F.when(terminal, "UNAVAILABLE").otherwise("CONTINUE")).when(stable, "INTEGER_STABLE").when(terminal, "INTEGER_BOUNDARY_SENSITIVE").otherwise("CONTINUE")


# Strength and durations.


def reliability_weight(eta: list[float], component_variance: Column, anchor_variance: Column, instability: Column, sparsity: Column) -> Column:
    x = eta[0] + eta[1] * F.log((component_variance + 1e-12) / (anchor_variance + 1e-12)) + eta[2] * instability + eta[3] * sparsity
    return F.least(F.lit(1 - 1e-12), F.greatest(F.lit(1e-12), S.logistic(x)))


def decayed(mean: Column, variance: Column, days: Column, decay: float, process_sd: float) -> tuple[Column, Column]:
    """A state brought forward: the mean shrinks, the variance goes to that of the process."""
    rho = F.exp(-F.greatest(F.lit(0.0), days) / decay)
    return rho * mean, rho * rho * variance + process_sd**2 * (1 - rho * rho)


def strength(mean_a: Column, variance_a: Column, mean_b: Column, variance_b: Column, scale: Column, head_mean: Column, head_variance: Column, floor: float = 1e-6) -> tuple[Column, Column, Column]:
    """Logit, its variance and the win probability by the logistic-normal approximation, the same from both sides."""
    logit = scale * (mean_a - mean_b + head_mean)
    variance = F.greatest(F.lit(floor), scale * scale * (variance_a + variance_b + head_variance))
    return logit, variance, F.least(F.lit(1 - 1e-12), F.greatest(F.lit(1e-12), S.logistic(logit / F.sqrt(1 + math.pi * variance / 8))))


def tilted(q: Column, delta: Column, weight: float, direction: int) -> Column:
    """A serve probability moved on the logit scale by half of the weighted gap."""
    return S.logistic(S.logit(q) + direction * delta * weight / 2)


def duration_center(theta: dict[str, float], points: Column, games: Column, sets: Column, tiebreaks: Column, pace: Column) -> Column:
    return theta["theta0"] + theta["points"] * points + theta["games"] * games + theta["sets"] * sets + theta["tiebreaks"] * tiebreaks + pace


def duration_scale(sigma0: float, sigma1: float, points: Column) -> Column:
    return sigma0 + sigma1 * F.sqrt(points)


def duration_minutes(center: Column, scale: Column, residual: Column) -> Column:
    """The latent minutes, one at least, and what three ways to round them show."""
    latent = F.greatest(F.lit(1.0), center + scale * residual)
    at_least = lambda x: F.greatest(F.lit(1), x.cast("long"))
    return F.struct(latent.alias("latent"), at_least(F.floor(latent)).alias("floor"), at_least(F.floor(latent + 0.5)).alias("nearest"), at_least(F.ceil(latent)).alias("ceiling"))
