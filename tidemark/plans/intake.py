"""Queries from raw rows to typed candidates, over terminations, names and scores.

orders stand for raw match rows; texts are made of their numbers by rules that Spark and SQL share."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import scalar as S
from tidemark.functions import text as T
from tidemark.operators import counts, intake, selection, termination
from tidemark.plans.ingest import _COUNTS, KEYS, service
from tidemark.sources.tables import load

#: Scores for best of three, and by hand what they mean: valid, completed, termination, wins, service and official games, codes.
SCORES = [
    ("6-4 6-3", True, True, "completed", 2, 0, 19, 19, ""),
    ("7-6(5) 6-7(3) 7-5", True, True, "completed", 2, 1, 36, 38, ""),
    ("6-4 3-6 [10-8]", True, True, "completed", 2, 1, 19, 19, ""),
    ("6-3 4-1 RET", True, False, "retirement", 1, 0, 14, 14, ""),
    ("W/O", True, False, "walkover", 0, 0, 0, 0, ""),
    ("6-4", False, False, "completed", 1, 0, 10, 10, "SCORE_INCOMPLETE_MATCH"),
    ("4-6 3-6", False, True, "completed", 0, 2, 19, 19, "SCORE_WINNER_ORIENTATION_MISMATCH"),
    ("6-4 6-4 6-1", False, False, "completed", 3, 0, 27, 27, "SCORE_INCOMPLETE_MATCH,SCORE_SET_AFTER_MATCH_END"),
    ("6-5 6-4", False, False, "completed", 1, 0, 21, 21, "SCORE_ILLEGAL_SET,SCORE_INCOMPLETE_MATCH"),
    ("6-4 abc", False, False, "completed", 0, 0, None, None, "SCORE_MALFORMED"),
    ("RET 6-4", False, False, "retirement", 0, 0, None, None, "SCORE_INVALID_STATUS"),
    ("", False, False, "completed", 0, 0, None, None, "SCORE_MISSING"),
    ("6-4 W/O", False, False, "walkover", 0, 0, None, None, "SCORE_WALKOVER_WITH_SCORE"),
    ("6-4 6-4 RET", False, False, "retirement", 2, 0, 20, 20, "SCORE_STATUS_AFTER_COMPLETION"),
    ("[10-5] 6-4 6-2", False, False, "completed", 3, 0, 18, 18, "SCORE_INCOMPLETE_MATCH,SCORE_MATCH_TIEBREAK_CONTEXT,SCORE_SET_AFTER_MATCH_END"),
    ("6-4(5) 6-3", False, True, "completed", 2, 0, 19, 19, "SCORE_ILLEGAL_SET"),
    ("0-0 DEF", True, False, "default", 0, 0, 0, 0, ""),
]
#: By hand: why a match of that score does not count.
STATUS = [None, None, None, "RETIREMENT", "WALKOVER", "INVALID_OR_INCOMPLETE_SCORE", "INVALID_OR_INCOMPLETE_SCORE", "INVALID_OR_INCOMPLETE_SCORE", "INVALID_OR_INCOMPLETE_SCORE", "INVALID_OR_INCOMPLETE_SCORE",
          "RETIREMENT", "INVALID_OR_INCOMPLETE_SCORE", "WALKOVER", "RETIREMENT", "INVALID_OR_INCOMPLETE_SCORE", "INVALID_OR_INCOMPLETE_SCORE", "DEFAULT"]


def _sql(v) -> str:
    return "NULL" if v is None else f"'{v}'" if isinstance(v, str) else str(v)


_N = len(SCORES)
_GOLDEN = "g(i, score, valid, completed, termination, wins_a, wins_b, service_games, official_games, codes, reason) AS (VALUES " + ", ".join(f"({i}, {', '.join(map(_sql, row))}, {_sql(STATUS[i])})" for i, row in enumerate(SCORES)) + ")"
_CUT = "TIMESTAMP '1999-01-01 00:00:00'"


def _score():
    return F.element_at(F.array(*[F.lit(s[0]) for s in SCORES]), (F.col("o_orderkey") % _N + 1).cast("int"))


def raw(spark, sf):
    """Match rows as text, with missing, malformed and contradicting values."""
    o = load(spark, sf, "orders")
    k = F.col("o_orderkey")
    date = F.when(k % 19 == 0, "unknown").when(k % 5 == 1, F.date_format("o_orderdate", "yyyy-MM-dd")).otherwise(F.date_format("o_orderdate", "yyyyMMdd"))
    return o.select(
        "o_orderkey", "o_orderdate", "o_orderpriority", date.alias("tourney_date"), F.when(k % 29 == 0, "NA").otherwise(F.col("o_custkey").cast("string")).alias("winner_id"), ((F.col("o_custkey") * 7 + k) % 1500).cast("string").alias("loser_id"),
        F.when(k % 31 == 0, "").otherwise(F.col("o_orderpriority")).alias("tourney_id"), F.when(k % 37 == 0, None).otherwise(k.cast("string")).alias("match_num"), F.lit("A").alias("winner_name"), F.lit("B").alias("loser_name"),
        F.when(k % 23 == 0, "4").otherwise("3").alias("best_of"), _score().alias("score"),
    )


_RAW = f"""raw AS (SELECT *, CASE WHEN o_orderkey % 19 = 0 THEN NULL ELSE CAST(o_orderdate AS DATE) END AS d, CASE WHEN o_orderkey % 29 = 0 THEN NULL ELSE o_custkey END AS w, (o_custkey * 7 + o_orderkey) % 1500 AS l,
  CASE WHEN o_orderkey % 31 = 0 THEN NULL ELSE o_orderpriority END AS t, CASE WHEN o_orderkey % 37 = 0 THEN NULL ELSE o_orderkey END AS m, o_orderkey % 23 = 0 AS bad_best, o_orderkey % {_N} AS i FROM orders)"""


def q_scores(spark, sf):
    x = T.with_scores(load(spark, sf, "orders").select("o_orderkey", _score().alias("score")), "score", F.lit(3), "s")
    return x.select("o_orderkey", "s.valid", "s.completed", "s.termination", "s.wins_a", "s.wins_b", "s.service_games", "s.official_games", F.array_join(F.array_sort("s.anomaly_codes"), ",").alias("codes"))


def q_status(spark, sf):
    x = T.with_scores(load(spark, sf, "orders").select("o_orderkey", _score().alias("score")), "score", F.lit(3), "s")
    counts_, reason = T.score_status(F.col("score"), F.col("s"))
    return x.groupBy(F.coalesce(reason, F.lit("COUNTS")).alias("reason"), counts_.alias("counts")).agg(F.count(F.lit(1)).alias("n"))


def q_raw_cutoff(spark, sf):
    kept, out = intake.raw_before_cutoff(raw(spark, sf), "tourney_date", 3, F.expr(_CUT), F.when(F.col("o_orderkey") % 41 == 0, F.expr(_CUT)).otherwise(F.expr("TIMESTAMP '1990-01-01 00:00:00'")))
    both = kept.withColumn("cutoff_exclusion_code", F.lit("SELECTED")).unionByName(out)
    return both.groupBy(F.col("cutoff_exclusion_code").alias("code")).agg(F.count(F.lit(1)).alias("n"), F.max("available_at").cast("date").cast("string").alias("latest"))


def q_exact_cutoff(spark, sf):
    r = raw(spark, sf).withColumn("status", F.when(F.col("o_orderkey") % 7 == 0, "AMBIGUOUS").otherwise("MATCHED"))
    kept, out = intake.exact_before_cutoff(r, "tourney_date", "status", F.expr(_CUT))
    both = kept.withColumn("cutoff_exclusion_code", F.lit("SELECTED")).unionByName(out)
    return both.groupBy(F.col("cutoff_exclusion_code").alias("code")).agg(F.count(F.lit(1)).alias("n"), F.max("completed_at").cast("date").cast("string").alias("latest"))


def q_retrospective(spark, sf):
    d = F.when(F.col("l_tax") == 0.08, None).when(F.col("l_orderkey") % 3 == 0, F.col("l_shipdate").cast("date")).otherwise(F.lit("1998-06-01").cast("date"))
    li = load(spark, sf, "lineitem").withColumn("day", d)
    kept, out = intake.retrospective(li, "l_orderkey", "day", F.lit("1999-01-01").cast("date"), "finalized")
    both = kept.withColumn("exclusion_code", F.lit("SELECTED")).unionByName(out)
    return both.groupBy("policy", F.col("exclusion_code").alias("code")).agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct("l_orderkey").alias("n_matches"))


def q_coverage(spark, sf):
    c = intake.coverage(raw(spark, sf).withColumn("day", S.parse_date(F.col("tourney_date"))), "day", "1996-01-01", "1999-12-31")
    return c.select("n_rows", "n_missing", "n_outside", F.col("first").cast("string").alias("first"), F.col("last").cast("string").alias("last"))


def q_candidates(spark, sf):
    c = intake.candidates(raw(spark, sf), 1, "ns", "atp")
    codes = F.when(F.col("identity_code").isNotNull(), F.array("identity_code")).otherwise(F.concat("fatal_codes", F.transform("warning_codes", lambda x: F.concat(F.lit("warning:"), x))))
    return c.select("o_orderkey", F.explode_outer(codes).alias("code")).groupBy(F.coalesce("code", F.lit("CLEAN")).alias("code")).agg(F.count(F.lit(1)).alias("n"), F.min("o_orderkey").alias("first"))


def q_sides(spark, sf):
    li = load(spark, sf, "lineitem")
    wide = li.select("l_orderkey", "l_linenumber", F.col("l_quantity").cast("int").cast("string").alias("w_svpt"), F.when(F.col("l_linenumber") == 7, "x1").otherwise(F.col("l_linenumber").cast("string")).alias("w_df"), F.when(F.col("l_tax") == 0, "").otherwise(F.col("l_suppkey").cast("string")).alias("w_ace"))
    s = intake.side_stats(wide, "w_", ["l_orderkey", "l_linenumber"])
    return s.groupBy(F.array_join("invalid_fields", ",").alias("invalid")).agg(F.count(F.lit(1)).alias("n"), F.sum("service_points").alias("points"), F.sum("double_faults").alias("double_faults"), F.count("aces").alias("n_aces"), F.count("first_serves_in").alias("n_first"))


def q_prepared(spark, sf):
    c = counts.component_counts(service(spark, sf), KEYS).withColumn("available", F.when(F.col("l_suppkey") % 50 == 0, None).otherwise(F.col("l_shipdate")))
    cut = F.expr(_CUT)
    kept, reasons = intake.prepared(c, "Q1", cut, "available", "l_shipdate", KEYS)
    total = kept.agg(F.lit("WEIGHT").alias("reason"), F.round(F.sum("weight"), 6).alias("weight"))
    return reasons.withColumn("weight", F.lit(None).cast("double")).unionByName(total.withColumn("n_rows", F.lit(None).cast("long")).select("reason", "n_rows", "weight"))


_PREPARED = f"""WITH {_COUNTS}, v AS (SELECT *, CASE WHEN l_suppkey % 50 = 0 THEN NULL ELSE l_shipdate END AS available, date_diff('day', CAST(l_shipdate AS DATE), DATE '1999-01-01') AS age,
  count(*) OVER (PARTITION BY l_orderkey, l_linenumber, l_suppkey, l_shipdate) AS twins FROM c WHERE component = 'Q1'),
u AS (SELECT *, CASE WHEN twins > 1 THEN 'DUPLICATE_KEY' WHEN status <> 'valid' THEN 'NOT_ELIGIBLE' WHEN available IS NULL THEN 'UNKNOWN_AVAILABILITY' WHEN available >= {_CUT} THEN 'AT_OR_AFTER_INFORMATION_CUTOFF'
  WHEN age < 0 THEN 'AFTER_CUTOFF_DATE' WHEN age > 1095 THEN 'OUTSIDE_WINDOW' ELSE 'INCLUDED' END AS reason FROM v)
SELECT reason, count(*) AS n_rows, CAST(NULL AS DOUBLE) AS weight FROM u GROUP BY 1 UNION ALL SELECT 'WEIGHT', NULL, round(sum(pow(2.0, -age / 365.0)), 6) FROM u WHERE reason = 'INCLUDED'"""


_ACCENT = "replace(replace(replace(c_name, 'e', 'é'), 'o', 'ö'), '#', ' d''Á-')"


def q_names(spark, sf):
    n = F.expr(_ACCENT)
    return load(spark, sf, "customer").select("c_custkey", T.spaced_name(n).alias("spaced"), T.joined_name(n).alias("joined"), T.hyphen_name(n).alias("hyphen"), T.name_signature(n).alias("signature"))


def q_surfaces(spark, sf):
    p = load(spark, sf, "part")
    words = F.array(*map(F.lit, ["hard court", "CLAY", " grass (outdoor)", "carpet", "ice", "", "Hardcourt"]))
    text = F.element_at(words, (F.col("p_partkey") % 7 + 1).cast("int"))
    ids = F.when(F.col("p_partkey") % 11 == 0, " nan ").when(F.col("p_partkey") % 3 == 0, F.concat(F.col("p_partkey").cast("string"), F.lit(".0"))).otherwise(F.concat(F.lit(" "), F.col("p_partkey").cast("string")))
    return p.select("p_partkey", T.surface(text).alias("surface"), T.clean_id(ids).alias("clean"), T.match_number(ids).alias("number"))


_ROUND = ["R128", "R64", "QF", "F", "q2", "BR"]


def q_rounds(spark, sf):
    o = load(spark, sf, "orders")
    name = F.element_at(F.array(*map(F.lit, _ROUND)), (F.col("o_orderkey") % 6 + 1).cast("int"))
    day, known = T.played_on(F.col("o_orderdate").cast("date"), name, F.when(F.col("o_custkey") % 2 == 0, "G").otherwise("A"))
    return o.select("o_orderkey", day.cast("string").alias("day"), known.alias("known"))


def q_elo_eligible(spark, sf):
    r = raw(spark, sf)
    ok = intake.elo_eligible(S.parse_date(F.col("tourney_date")), F.lit("1999-01-01").cast("date"), F.when(F.col("o_orderkey") % 6 == 0, "ice").otherwise("Hard"), F.when(F.col("o_orderkey") % 8 == 0, "A/C").otherwise("A"), F.lit("B"), F.col("score"), F.substring("o_orderpriority", 1, 1), ["5"])
    return r.groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("n"), F.count_if(ok).alias("n_eligible"))


# Terminations.

_TERMINATION = """z AS (SELECT o_orderkey AS match_id, CAST(o_custkey AS VARCHAR) AS player_a_id, CAST(o_custkey + 1 AS VARCHAR) AS player_b_id, CAST(o_orderdate AS DATE) AS match_date,
  CASE o_orderkey % 6 WHEN 0 THEN 'retirement' WHEN 1 THEN 'walkover_or_prestart_withdrawal' WHEN 2 THEN 'default_disqualification_or_misconduct' WHEN 3 THEN 'suspended' ELSE 'normal_completion' END AS official_status,
  o_orderkey % 10 <> 0 AS started, CASE WHEN o_orderkey % 6 = 0 AND o_orderkey % 7 <> 0 THEN CAST(o_custkey + o_orderkey % 3 AS VARCHAR) WHEN o_orderkey % 43 = 0 THEN CAST(o_custkey AS VARCHAR) END AS retiring_player_id,
  CAST(o_custkey + 1 AS VARCHAR) AS advancing_winner_id, CASE WHEN o_orderkey % 6 = 0 AND o_orderkey % 4 = 0 THEN 9 END AS retirement_completed_games, CASE WHEN o_orderkey % 47 = 0 THEN 'UPSTREAM' END AS upstream_anomaly_code,
  o_orderdate + INTERVAL 1 DAY AS available_at FROM orders)"""
_ANOMALY = """y AS (SELECT *, retiring_player_id IS NOT NULL OR retirement_completed_games IS NOT NULL AS facts, retiring_player_id IS NOT NULL AND retiring_player_id NOT IN (player_a_id, player_b_id) AS stranger FROM z),
x AS (SELECT *, CASE WHEN stranger THEN 'UNRESOLVED_PLAYER_IDENTITY' WHEN upstream_anomaly_code IS NOT NULL THEN upstream_anomaly_code
  WHEN official_status = 'normal_completion' AND facts THEN 'NORMAL_COMPLETION_WITH_RETIREMENT_FACTS' WHEN official_status = 'normal_completion' AND NOT started THEN 'NORMAL_COMPLETION_WITHOUT_STARTED_EVIDENCE'
  WHEN official_status = 'retirement' AND NOT started THEN 'RETIREMENT_WITHOUT_STARTED_EVIDENCE' WHEN official_status = 'retirement' AND retiring_player_id IS NULL THEN 'RETIRING_PLAYER_NOT_RELIABLY_IDENTIFIED'
  WHEN official_status = 'retirement' AND retiring_player_id = advancing_winner_id THEN 'RETIRING_PLAYER_RECORDED_AS_ADVANCING_WINNER'
  WHEN official_status LIKE 'walkover%' AND (started OR facts) THEN 'WALKOVER_WITH_STARTED_OR_RETIREMENT_FACTS' WHEN official_status LIKE 'default%' AND facts THEN 'ADMINISTRATIVE_TERMINATION_WITH_RETIREMENT_FACTS'
  WHEN official_status = 'suspended' THEN 'SUSPENDED' END AS anomaly_code FROM y),
w AS (SELECT *, CASE WHEN anomaly_code IS NOT NULL THEN 'ambiguous' WHEN official_status = 'normal_completion' THEN 'normal_completion' WHEN official_status = 'retirement' THEN 'started_retirement' WHEN official_status LIKE 'walkover%' THEN 'walkover' ELSE 'administrative_termination' END AS terminal_class FROM x)"""
_STARTS = """, v AS (SELECT *, date_diff('day', match_date, DATE '2001-01-01') AS age FROM w),
u AS (SELECT *, CASE WHEN available_at >= TIMESTAMP '2001-01-01 00:00:00' THEN 'AT_OR_AFTER_INFORMATION_CUTOFF' WHEN age < 0 THEN 'MATCH_DATE_AFTER_CUTOFF_DATE' WHEN age > 1826 THEN 'OUTSIDE_1826_DAY_WINDOW'
  WHEN terminal_class NOT IN ('normal_completion', 'started_retirement') THEN concat_ws(':', 'EXCLUDED', upper(terminal_class), upper(official_status), anomaly_code) END AS reason,
  CASE WHEN available_at >= TIMESTAMP '2001-01-01 00:00:00' OR age < 0 THEN NULL WHEN age > 1826 THEN 0.0 ELSE pow(2.0, -age / 730.0) END AS weight FROM v)"""


def records(spark, sf):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    status = F.when(k % 6 == 0, "retirement").when(k % 6 == 1, termination.WITHDRAWN).when(k % 6 == 2, termination.DEFAULTED).when(k % 6 == 3, "suspended").otherwise(termination.NORMAL)
    retiring = F.when((k % 6 == 0) & (k % 7 != 0), (c + k % 3).cast("string")).when(k % 43 == 0, c.cast("string"))
    return load(spark, sf, "orders").select(
        k.alias("match_id"), c.cast("string").alias("player_a_id"), (c + 1).cast("string").alias("player_b_id"), F.col("o_orderdate").cast("date").alias("match_date"), status.alias("official_status"),
        F.when(k % 10 != 0, F.array(F.lit("points"))).otherwise(F.array().cast("array<string>")).alias("started_evidence"), retiring.alias("retiring_player_id"), (c + 1).cast("string").alias("advancing_winner_id"),
        F.when((k % 6 == 0) & (k % 4 == 0), 9).alias("retirement_completed_games"), F.when(k % 47 == 0, "UPSTREAM").alias("upstream_anomaly_code"), F.expr("o_orderdate + INTERVAL 1 DAY").alias("available_at"),
    )


def q_terminal(spark, sf):
    c = termination.classified(records(spark, sf))
    return c.groupBy("terminal_class", "anomaly_code", "incidence_eligible").agg(F.count(F.lit(1)).alias("n"), F.count_if("timing_available").alias("n_timed"))


def _split(spark, sf):
    return termination.starts(termination.classified(records(spark, sf)), F.expr("TIMESTAMP '2001-01-01 00:00:00'"))


def q_starts(spark, sf):
    return _split(spark, sf)[0].groupBy("player_id").agg(F.count(F.lit(1)).alias("n"), F.sum("response").alias("n_retired"), F.round(F.sum("recency_weight"), 6).alias("weight"), F.count("retirement_completed_games").alias("n_timed"))


def q_reason_counts(spark, sf):
    c = termination.reason_counts(*_split(spark, sf))
    return c.select("side", "name", "n_matches", "n_starts", F.round("weight", 6).alias("weight"))


def q_records(spark, sf):
    li = load(spark, sf, "lineitem").withColumn("side", F.when(F.col("l_linenumber") % 2 == 1, "winner").otherwise("loser"))
    got = termination.terminal_records(li, "l_orderkey", "l_suppkey", "side", [("points", F.col("l_quantity") > 25), ("time", F.col("l_tax") > 0.04)])
    return got.filter("n_rows <= 3").select("l_orderkey", "n_rows", "winner_id", "loser_id", F.array_join("started_evidence", ",").alias("evidence"), "usable")


_LAST = ["e.user_id % 7 = 0", "e.event_id % 11 = 0", "e.event_id % 13 = 0", "e.ts >= TIMESTAMP '2024-01-20 00:00:00'", "e.event_id % 17 = 0", "e.event_type = 'error'", "e.event_type = 'view'", "e.event_type = 'signup'", "e.value < 5"]
_REASON = ["PLAYER_MISMATCH", "TOUR_MISMATCH", "SOURCE_NOT_IN_COVERAGE_ASSERTION", "AT_OR_AFTER_INFORMATION_CUTOFF", "UNRESOLVED_IDENTITY", "DOUBLES", "EXHIBITION", "WALKOVER_OR_PRE_START_WITHDRAWAL", "NO_STARTED_MATCH_EVIDENCE"]


def q_last_eligible(spark, sf):
    """Days since the last match that ends a player's time without one, and how many matches did not and why."""
    e = load(spark, sf, "events").alias("e")
    t = [F.expr(x) for x in _LAST]
    reason = termination.last_match_eligibility(
        F.when(t[0], "x").otherwise("p"), F.when(t[1], "x").otherwise("t"), F.when(t[2], "x").otherwise("m"), F.lit("p"), F.lit("t"), F.lit("m"), F.col("ts"), F.expr("TIMESTAMP '2024-01-20 00:00:00'"), ~t[4],
        F.when(t[5], "doubles").otherwise("singles"), F.when(t[6], "exhibition").otherwise("tour"), F.when(t[7], "walkover").otherwise("completed"), ~t[8],
    )
    got = e.withColumn("reason", reason).groupBy("user_id").agg(F.max(F.when(F.col("reason") == "ELIGIBLE", F.col("ts"))).alias("last"), *[F.count_if(F.col("reason") == r).alias(r.lower()) for r in _REASON])
    days = F.date_diff(F.lit("2024-06-30").cast("date"), F.col("last").cast("date"))
    return got.select("user_id", days.cast("long").alias("days"), S.inactivity_band(days).alias("band"), *[r.lower() for r in _REASON])


_LAST_SQL = "WITH x AS (SELECT *, CASE " + " ".join(f"WHEN {c} THEN '{r}'" for c, r in zip(_LAST, _REASON, strict=True)) + " ELSE 'ELIGIBLE' END AS reason FROM events e), g AS (SELECT user_id, date_diff('day', CAST(max(CASE WHEN reason = 'ELIGIBLE' THEN ts END) AS DATE), DATE '2024-06-30') AS days, " + ", ".join(f"count(*) FILTER (reason = '{r}') AS {r.lower()}" for r in _REASON) + " FROM x GROUP BY 1) SELECT *, CASE WHEN days IS NULL THEN 'COLD_START' WHEN days <= 90 THEN 'D_LE_90' WHEN days <= 180 THEN 'D_91_180' WHEN days <= 365 THEN 'D_181_365' ELSE 'D_GT_365' END AS band FROM g"


def q_anomaly_union(spark, sf):
    """Anomalies of intake and of counts as one table."""
    c = intake.candidates(raw(spark, sf), 1, "ns", "atp").select(F.lit("candidate").alias("scope"), F.explode("fatal_codes").alias("code"), F.col("o_orderkey").alias("source_row"))
    a = counts.anomalies(counts.component_counts(service(spark, sf), KEYS), KEYS).select(F.lit("count").alias("scope"), "code", "component")
    return c.unionByName(a, allowMissingColumns=True).groupBy("scope", "code", "component").agg(F.count(F.lit(1)).alias("n"), F.count("source_row").alias("n_sourced"))


_CODES = f"""c0 AS (SELECT raw.*, CASE WHEN w IS NULL THEN 'MISSING_WINNER_ID' WHEN w = l THEN 'SAME_PLAYER' WHEN t IS NULL THEN 'MISSING_TOURNAMENT_ID' WHEN m IS NULL THEN 'MISSING_MATCH_NUMBER' END AS identity, string_split(nullif(g.codes, ''), ',') AS codes FROM raw JOIN g USING (i)),
c1 AS (SELECT o_orderkey, list_filter(list_concat([CASE WHEN d IS NULL THEN 'MALFORMED_MATCH_DATE' END, CASE WHEN bad_best THEN 'MALFORMED_BEST_OF' END], coalesce(codes, [])), lambda q: q IS NOT NULL) AS codes, identity FROM c0)"""
QUERIES = {
    "score_grammar": (q_scores, f"WITH {_GOLDEN} SELECT o_orderkey, valid, completed, termination, wins_a, wins_b, service_games, official_games, codes FROM orders JOIN g ON g.i = o_orderkey % {_N}"),
    "score_status": (q_status, f"WITH {_GOLDEN} SELECT coalesce(reason, 'COUNTS') AS reason, reason IS NULL AS counts, count(*) AS n FROM orders JOIN g ON g.i = o_orderkey % {_N} GROUP BY 1, 2"),
    "raw_cutoff": (q_raw_cutoff, f"WITH {_RAW}, a AS (SELECT *, greatest(CAST(d + 3 AS TIMESTAMP), CASE WHEN o_orderkey % 41 = 0 THEN {_CUT} ELSE TIMESTAMP '1990-01-01 00:00:00' END) AS seen FROM raw), b AS (SELECT CASE WHEN d IS NULL THEN 'UNKNOWN_AVAILABILITY' WHEN seen >= {_CUT} THEN 'AT_OR_AFTER_INFORMATION_CUTOFF' ELSE 'SELECTED' END AS code, CASE WHEN d IS NOT NULL THEN seen END AS seen FROM a) SELECT code, count(*) AS n, strftime(max(seen), '%Y-%m-%d') AS latest FROM b GROUP BY 1"),
    "exact_cutoff": (q_exact_cutoff, f"WITH {_RAW}, a AS (SELECT CASE WHEN d IS NULL OR o_orderkey % 7 = 0 THEN 'MISSING_EXACT_MATCH_DATE' WHEN CAST(d + 1 AS TIMESTAMP) > {_CUT} THEN 'AT_OR_AFTER_FORECAST_CUTOFF' ELSE 'SELECTED' END AS code, CASE WHEN o_orderkey % 7 <> 0 THEN d + 1 END AS seen FROM raw) SELECT code, count(*) AS n, strftime(max(seen), '%Y-%m-%d') AS latest FROM a GROUP BY 1"),
    "retrospective_selection": (q_retrospective, "WITH m AS (SELECT l_orderkey, CASE WHEN l_tax = 0.08 THEN NULL WHEN l_orderkey % 3 = 0 THEN CAST(l_shipdate AS DATE) ELSE DATE '1998-06-01' END AS day FROM lineitem), k AS (SELECT *, CASE WHEN count(day) OVER w < count(*) OVER w THEN 'MISSING_MATCH_DATE' WHEN min(day) OVER w <> max(day) OVER w THEN 'INCONSISTENT_MATCH_DATE' WHEN max(day) OVER w >= DATE '1999-01-01' THEN 'AT_OR_AFTER_FORECAST_CUTOFF' ELSE 'SELECTED' END AS code FROM m WINDOW w AS (PARTITION BY l_orderkey)) SELECT 'finalized' AS policy, code, count(*) AS n_rows, count(DISTINCT l_orderkey) AS n_matches FROM k GROUP BY 2"),
    "declared_coverage": (q_coverage, f"WITH {_RAW} SELECT count(*) AS n_rows, count(*) FILTER (d IS NULL) AS n_missing, count(*) FILTER (NOT d BETWEEN DATE '1996-01-01' AND DATE '1999-12-31') AS n_outside, CAST(min(d) AS VARCHAR) AS first, CAST(max(d) AS VARCHAR) AS last FROM raw"),
    "candidate_codes": (q_candidates, f"WITH {_GOLDEN}, {_RAW}, {_CODES}, c2 AS (SELECT o_orderkey, unnest(CASE WHEN identity IS NOT NULL THEN [identity] WHEN len(codes) = 0 THEN ['CLEAN'] ELSE list_transform(codes, lambda q: CASE WHEN q = 'SCORE_MISSING' THEN 'warning:SCORE_MISSING' ELSE q END) END) AS code FROM c1) SELECT code, count(*) AS n, min(o_orderkey) AS first FROM c2 GROUP BY 1"),
    "side_statistics": (q_sides, "SELECT CASE WHEN l_linenumber = 7 THEN 'double_faults' ELSE '' END AS invalid, count(*) AS n, CAST(sum(CAST(l_quantity AS INT)) AS BIGINT) AS points, CAST(sum(CASE WHEN l_linenumber <> 7 THEN l_linenumber END) AS BIGINT) AS double_faults, count(CASE WHEN l_tax <> 0 THEN 1 END) AS n_aces, CAST(0 AS BIGINT) AS n_first FROM lineitem GROUP BY 1"),
    "component_preparation": (q_prepared, _PREPARED),
    "folded_names": (q_names, f"WITH n AS (SELECT c_custkey, lower(strip_accents({_ACCENT})) AS x FROM customer), t AS (SELECT *, regexp_extract_all(x, '[a-z]+') AS w FROM n) SELECT c_custkey, array_to_string(regexp_extract_all(x, '[a-z0-9]+'), ' ') AS spaced, regexp_replace(x, '[^a-z0-9]+', '', 'g') AS joined, trim(regexp_replace(replace(x, '-', ' '), '\\s+', ' ', 'g')) AS hyphen, left(w[1], 1) || '|' || w[len(w)] AS signature FROM t"),
    "surfaces_and_ids": (q_surfaces, "SELECT p_partkey, CASE p_partkey % 7 WHEN 0 THEN 'Hard' WHEN 1 THEN 'Clay' WHEN 2 THEN 'Grass' WHEN 3 THEN 'Carpet' END AS surface, CASE WHEN p_partkey % 11 = 0 THEN '' ELSE CAST(p_partkey AS VARCHAR) END AS clean, CASE WHEN p_partkey % 11 <> 0 THEN p_partkey END AS number FROM part"),
    "round_dates": (q_rounds, "WITH r AS (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS d, CASE WHEN o_custkey % 2 = 0 THEN CASE o_orderkey % 6 WHEN 0 THEN 0 WHEN 1 THEN 2 WHEN 2 THEN 8 WHEN 3 THEN 13 WHEN 4 THEN -4 END ELSE CASE o_orderkey % 6 WHEN 0 THEN 0 WHEN 1 THEN 1 WHEN 2 THEN 4 WHEN 3 THEN 6 WHEN 4 THEN -2 END END AS n FROM orders) SELECT o_orderkey, CAST(d + coalesce(n, 0) AS VARCHAR) AS day, n IS NOT NULL AS known FROM r"),
    "elo_eligibility": (q_elo_eligible, f"WITH {_GOLDEN}, {_RAW} SELECT o_orderpriority, count(*) AS n, count(*) FILTER (d < DATE '1999-01-01' AND o_orderkey % 6 <> 0 AND o_orderkey % 8 <> 0 AND regexp_matches(g.score, '\\d+-\\d+') AND g.score NOT LIKE '%W/O%' AND left(o_orderpriority, 1) <> '5') AS n_eligible FROM raw JOIN g USING (i) GROUP BY 1"),
    "terminal_classes": (q_terminal, f"WITH {_TERMINATION}, {_ANOMALY} SELECT terminal_class, anomaly_code, terminal_class IN ('normal_completion', 'started_retirement') AS incidence_eligible, count(*) AS n, count(retirement_completed_games) AS n_timed FROM w GROUP BY 1, 2, 3"),
    "retirement_starts": (q_starts, f"WITH {_TERMINATION}, {_ANOMALY}{_STARTS}, p AS (SELECT unnest([player_a_id, player_b_id]) AS player_id, retiring_player_id, terminal_class, retirement_completed_games, weight FROM u WHERE reason IS NULL), q AS (SELECT *, coalesce(terminal_class = 'started_retirement' AND player_id = retiring_player_id, false) AS r FROM p) SELECT player_id, count(*) AS n, CAST(sum(r::INT) AS BIGINT) AS n_retired, round(sum(weight), 6) AS weight, count(CASE WHEN r THEN retirement_completed_games END) AS n_timed FROM q GROUP BY 1"),
    "reason_counts": (q_reason_counts, f"WITH {_TERMINATION}, {_ANOMALY}{_STARTS} SELECT 'included' AS side, terminal_class AS name, count(*) AS n_matches, 2 * count(*) AS n_starts, round(sum(2 * weight), 6) AS weight FROM u WHERE reason IS NULL GROUP BY 2 UNION ALL SELECT 'excluded', reason, count(*), 2 * count(*), round(sum(2 * weight), 6) FROM u WHERE reason IS NOT NULL GROUP BY 2"),
    "terminal_records": (q_records, "WITH g AS (SELECT l_orderkey, count(*) AS n_rows, count(*) FILTER (l_linenumber % 2 = 1) AS w, max(CASE WHEN l_linenumber % 2 = 1 THEN l_suppkey END) AS winner_id, max(CASE WHEN l_linenumber % 2 = 0 THEN l_suppkey END) AS loser_id, concat_ws(',', CASE WHEN bool_or(l_quantity > 25) THEN 'points' END, CASE WHEN bool_or(l_tax > 0.04) THEN 'time' END) AS evidence FROM lineitem GROUP BY 1) SELECT l_orderkey, n_rows, winner_id, loser_id, evidence, coalesce(n_rows = 2 AND w = 1 AND winner_id <> loser_id, false) AS usable FROM g WHERE n_rows <= 3"),
    "last_eligible_gap": (q_last_eligible, _LAST_SQL),
    "anomaly_union": (q_anomaly_union, f"WITH {_GOLDEN}, {_RAW}, {_CODES}, {_COUNTS} SELECT 'candidate' AS scope, code, NULL AS component, count(*) AS n, count(*) AS n_sourced FROM (SELECT unnest(list_filter(codes, lambda q: q <> 'SCORE_MISSING')) AS code FROM c1 WHERE identity IS NULL) GROUP BY 2 UNION ALL SELECT 'count', code, component, count(*), CAST(0 AS BIGINT) FROM (SELECT component, unnest(codes) AS code FROM c) GROUP BY 2, 3"),
}
