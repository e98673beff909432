"""How matches ended, player starts for retirement models, and what counts against a layoff."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.selection import first_reason

#: Fixed values.
NORMAL, RETIRED, WALKOVER, ADMINISTRATIVE, AMBIGUOUS = "normal_completion", "started_retirement", "walkover", "administrative_termination", "ambiguous"
DEFAULTED, WITHDRAWN = "default_disqualification_or_misconduct", "walkover_or_prestart_withdrawal"


def classified(records: DataFrame) -> DataFrame:
    """terminal_class, anomaly_code and incidence_eligible of records with player_a_id, player_b_id, official_status, started_evidence (array),
    retiring_player_id, advancing_winner_id, retirement_completed_games and upstream_anomaly_code. Facts that contradict one another are ambiguous; none is repaired."""
    status, started = F.col("official_status"), F.size(F.coalesce("started_evidence", F.array().cast("array<string>"))) > 0
    retiring, winner = F.col("retiring_player_id"), F.col("advancing_winner_id")
    stranger = lambda p: p.isNotNull() & (p != F.col("player_a_id")) & (p != F.col("player_b_id"))
    facts = retiring.isNotNull() | F.col("retirement_completed_games").isNotNull()
    known = [
        ("UNRESOLVED_PLAYER_IDENTITY", stranger(retiring) | stranger(winner)),
        ("NORMAL_COMPLETION_WITH_RETIREMENT_FACTS", (status == NORMAL) & facts), ("NORMAL_COMPLETION_WITHOUT_STARTED_EVIDENCE", (status == NORMAL) & ~started),
        ("RETIREMENT_WITHOUT_STARTED_EVIDENCE", (status == "retirement") & ~started), ("RETIRING_PLAYER_NOT_RELIABLY_IDENTIFIED", (status == "retirement") & retiring.isNull()),
        ("RETIRING_PLAYER_RECORDED_AS_ADVANCING_WINNER", (status == "retirement") & (retiring == winner)),
        ("WALKOVER_WITH_STARTED_OR_RETIREMENT_FACTS", (status == WITHDRAWN) & (started | facts)), ("ADMINISTRATIVE_TERMINATION_WITH_RETIREMENT_FACTS", (status == DEFAULTED) & facts),
    ]
    own = first_reason(known)
    upstream = F.col("upstream_anomaly_code")
    kinds = F.create_map(*[F.lit(x) for kv in ((NORMAL, NORMAL), ("retirement", RETIRED), (WITHDRAWN, WALKOVER), (DEFAULTED, ADMINISTRATIVE)) for x in kv])
    kind = F.try_element_at(kinds, status)
    anomaly = F.when(own == "UNRESOLVED_PLAYER_IDENTITY", own).otherwise(F.coalesce(upstream, own, F.when(kind.isNull(), F.upper(F.coalesce(status, F.lit("unknown"))))))
    rows = records.withColumn("play_started", started).withColumn("anomaly_code", anomaly).withColumn("terminal_class", F.when(anomaly.isNotNull(), AMBIGUOUS).otherwise(kind))
    return rows.withColumn("incidence_eligible", F.col("terminal_class").isin(NORMAL, RETIRED)).withColumn("timing_available", F.col("retirement_completed_games").isNotNull())


def retirement_weight(age_days: Column, half_life: float = 730.0) -> Column:
    return F.pow(F.lit(2.0), -age_days / F.lit(half_life))


def starts(records: DataFrame, cutoff: Column, window: int = 1826) -> tuple[DataFrame, DataFrame]:
    """(two rows of player starts for each match that counts, response 1 for who retired; the matches left out with exclusion_reason)."""
    age = F.date_diff(cutoff.cast("date"), F.col("match_date"))
    left_out = F.concat_ws(":", F.lit("EXCLUDED"), F.upper("terminal_class"), F.upper("official_status"), "anomaly_code")
    reason = F.when(F.col("available_at") >= cutoff, "AT_OR_AFTER_INFORMATION_CUTOFF").when(age < 0, "MATCH_DATE_AFTER_CUTOFF_DATE").when(age > window, F.lit(f"OUTSIDE_{window}_DAY_WINDOW")).when(~F.col("incidence_eligible"), left_out)
    weight = F.when(F.col("available_at") >= cutoff, None).when(age < 0, None).when(age > window, F.lit(0.0)).otherwise(retirement_weight(age))
    rows = records.withColumn("age_days", age).withColumn("exclusion_reason", reason).withColumn("recency_weight", weight)
    a, b = F.col("player_a_id"), F.col("player_b_id")
    side = lambda p, o: F.struct(p.alias("player_id"), o.alias("opponent_id"))
    pairs = rows.filter("exclusion_reason IS NULL").withColumn("_s", F.explode(F.array(side(a, b), side(b, a))))
    response = ((F.col("terminal_class") == RETIRED) & (F.col("_s.player_id") == F.col("retiring_player_id"))).cast("int")
    pairs = pairs.withColumn("response", F.coalesce(response, F.lit(0))).withColumn("retirement_completed_games", F.when(F.col("response") == 1, F.col("retirement_completed_games")))
    return pairs.select("match_id", "match_date", "_s.*", "response", "recency_weight", "age_days", "terminal_class", "retirement_completed_games"), rows.filter("exclusion_reason IS NOT NULL").drop("age_days")


def reason_counts(included: DataFrame, excluded: DataFrame) -> DataFrame:
    """Matches, player starts and weight by class for what counts, and by reason for what does not; a match left out has two starts."""
    a = included.groupBy(F.col("terminal_class").alias("name")).agg(F.count_distinct("match_id").alias("n_matches"), F.count(F.lit(1)).alias("n_starts"), F.sum("recency_weight").alias("weight")).withColumn("side", F.lit("included"))
    b = excluded.groupBy(F.col("exclusion_reason").alias("name")).agg(F.count(F.lit(1)).alias("n_matches"), (2 * F.count(F.lit(1))).alias("n_starts"), F.sum(2 * F.col("recency_weight")).alias("weight")).withColumn("side", F.lit("excluded"))
    return a.unionByName(b)


def terminal_records(rows: DataFrame, match: str, player: str, orientation: str, evidence: list[tuple[str, Column]]) -> DataFrame:
    """One record for each match of exactly one winner's and one loser's row: the players, and the sorted names of what proves that play started."""
    won, lost = F.col(orientation) == "winner", F.col(orientation) == "loser"
    marks = F.array_compact(F.array(*[F.when(F.coalesce(test, F.lit(False)), F.lit(name)) for name, test in evidence]))
    facts = rows.withColumn("_marks", marks).groupBy(match).agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_if(won).alias("_w"), F.count_if(lost).alias("_l"), F.max(F.when(won, F.col(player))).alias("winner_id"), F.max(F.when(lost, F.col(player))).alias("loser_id"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("_marks")))).alias("started_evidence"),
    )
    ok = (F.col("n_rows") == 2) & (F.col("_w") == 1) & (F.col("_l") == 1) & (F.col("winner_id") != F.col("loser_id"))
    return facts.withColumn("usable", F.coalesce(ok, F.lit(False))).drop("_w", "_l")


def last_match_eligibility(player: Column, tour: Column, manifest: Column, wanted_player: Column, wanted_tour: Column, wanted_manifest: Column, available: Column, cutoff: Column, resolved: Column, discipline: Column, competition: Column, status: Column, started: Column) -> Column:
    """The first of nine reasons why a match does not end a player's time without one, or ELIGIBLE."""
    reasons = [
        ("PLAYER_MISMATCH", player != wanted_player), ("TOUR_MISMATCH", tour != wanted_tour), ("SOURCE_NOT_IN_COVERAGE_ASSERTION", manifest != wanted_manifest), ("AT_OR_AFTER_INFORMATION_CUTOFF", available >= cutoff),
        ("UNRESOLVED_IDENTITY", ~resolved), ("DOUBLES", discipline != "singles"), ("EXHIBITION", competition == "exhibition"), ("WALKOVER_OR_PRE_START_WITHDRAWAL", status.isin("walkover", "pre_start_withdrawal")), ("NO_STARTED_MATCH_EVIDENCE", ~started),
    ]
    return F.coalesce(first_reason(reasons), F.lit("ELIGIBLE"))
