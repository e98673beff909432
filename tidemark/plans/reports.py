"""Queries over reports, gates, simulated shares, strength and durations."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import reports
from tidemark.plans.evaluation import _F, forecasts
from tidemark.sources.tables import load


def r(column, digits=6):
    return F.round(column, digits)


def _status():
    return F.when(F.col("doc_id") % 11 == 0, "VOID").when(F.col("doc_id") % 13 == 0, "UNAVAILABLE").when(F.col("doc_id") % 17 == 0, "DISABLED").otherwise("SETTLED")


_ST = "CASE WHEN doc_id % 11 = 0 THEN 'VOID' WHEN doc_id % 13 = 0 THEN 'UNAVAILABLE' WHEN doc_id % 17 = 0 THEN 'DISABLED' ELSE 'SETTLED' END"


def q_family(spark, sf):
    t = reports.family_report(forecasts(spark, sf).withColumn("status", _status()), "source", "status", "p", "y")
    return t.select("source", "n_targets", "n_settled", "n_void", "n_unavailable", "n_disabled", *[r(F.col(c)).alias(c) for c in ("brier", "mean_p", "frequency")])


def _two(spark, sf):
    return forecasts(spark, sf).withColumn("q", F.col("p") * 0.8 + 0.1)


def q_metrics(spark, sf):
    t = reports.metric_rows(_two(spark, sf), "y", {"v1": "p", "v2": "q"}, "lang")
    return t.select("variant", F.coalesce("lang", F.lit("ALL")).alias("lang"), "n", *[r(F.col(c)).alias(c) for c in ("brier", "log_loss", "accuracy")])


def q_compared(spark, sf):
    t = reports.compared(_two(spark, sf).withColumn("q", F.when(F.col("doc_id") % 5 == 0, F.col("p")).otherwise(F.col("q"))), "y", "p", "q", ["lang"])
    return t.select("lang", "n", r(F.col("brier_a")).alias("brier_a"), r(F.col("brier_b")).alias("brier_b"), "a_better", "b_better", "tied")


def q_audit(spark, sf):
    t = reports.audit(forecasts(spark, sf), "p", "y", [["lang"], ["lang", "source"]], ["lang", "source"])
    return t.select("lang", F.coalesce("source", F.lit("ALL")).alias("source"), "n", *[r(F.col(c)).alias(c) for c in ("bias", "bias_se", "brier", "skill", "accuracy")])


def q_scores(spark, sf):
    li = load(spark, sf, "lineitem")
    paths = li.select((F.col("l_suppkey") % 2).alias("winner"), F.when(F.col("l_suppkey") % 2 == 0, 2).otherwise(F.col("l_linenumber") % 3).alias("a"), F.when(F.col("l_suppkey") % 2 == 0, F.col("l_linenumber") % 2).otherwise(2).alias("b"), F.col("l_quantity").cast("int").alias("games"))
    return reports.score_distribution(paths, "winner", "a", "b", "games", 2).select("winner", F.col("a").cast("int").alias("a"), F.col("b").cast("int").alias("b"), "n_paths", "n_incoherent", r(F.col("mean_games")).alias("mean_games"))


def q_service(spark, sf):
    e = load(spark, sf, "events").select("user_id", (F.col("event_id") % 3 != 0).alias("f"), (F.col("event_type") == "purchase").alias("a"), (F.col("event_type") == "error").alias("d"), (F.col("value") > 10).alias("w"))
    return reports.service_totals(e, ["user_id"], "f", "a", "d", "w")


def q_residuals(spark, sf):
    e = load(spark, sf, "events").withColumn("center", F.lit(20.0) + F.col("user_id") % 7).withColumn("x", (F.col("event_id") % 100).cast("double"))
    t = reports.residual_summary(e, "value", "center", F.when(F.col("x") < 30, "low").when(F.col("x") < 70, "middle").otherwise("high"), "x")
    return t.select("band", "n", *[r(F.col(c)).alias(c) for c in ("mean_error", "mae", "rmse", "r")])


def q_intervals(spark, sf):
    e = load(spark, sf, "events").withColumn("center", F.lit(20.0)).withColumn("scale", 5.0 + F.col("user_id") % 3)
    t = reports.interval_coverage(e, "value", "center", "scale", {0.5: 0.741, 0.8: 1.533, 0.95: 2.776})
    return t.select("level", "n", r(F.col("coverage")).alias("coverage"), r(F.col("width")).alias("width"))


def q_match_audit(spark, sf):
    li = load(spark, sf, "lineitem").withColumn("minutes", F.when(F.col("l_tax") != 0, F.col("l_quantity"))).withColumn("day", F.col("l_shipdate").cast("date").cast("string"))
    t = reports.match_audit(li, "l_orderkey", "l_suppkey", "minutes", "l_extendedprice", "day", F.col("l_returnflag") == "R")
    return t.select("n_matches", "n_usable", "first", "last", F.col("n_retired").cast("long").alias("n_retired"), "n_players")


def q_coverage(spark, sf):
    f = load(spark, sf, "documents").withColumn("band", F.when(F.col("n_chars") < 500, "short").otherwise("long"))
    t = reports.coverage_report(f, F.when(F.col("doc_id") % 5 == 0, "NO_DATE").when(F.col("doc_id") % 7 == 0, "LATE"), F.col("lang") != "en", "band")
    return t.select("kind", "name", "n", F.col("n_known").cast("long").alias("n_known"))


def q_reconciled(spark, sf):
    li = load(spark, sf, "lineitem")
    return reports.reconciled(li.filter("l_tax > 0.03"), li.filter("NOT l_tax > 0.03"), li)


def q_frequency(spark, sf):
    f = forecasts(spark, sf).withColumn("resolution", F.when(_status() == "SETTLED", F.when(F.col("y") == 1, "YES").otherwise("NO")).otherwise(_status())).withColumn("ps", 0.9 - F.col("p") / 10).withColumn("pv", 1 - F.col("ps"))
    t = reports.settlement_frequency(f, ["lang"], "ps", "pv", "resolution")
    return t.select("lang", "n", *[r(F.col(c)).alias(c) for c in ("predicted_settled", "observed_settled", "predicted_void", "observed_void")])


def q_official(spark, sf):
    job = load(spark, sf, "orders").select("o_orderkey", (F.col("o_custkey") % 50).cast("double").alias("threshold"))
    official = load(spark, sf, "lineitem").filter("l_linenumber = 1").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.max(F.when(F.col("l_tax") > 0, F.col("l_quantity"))).alias("official_value"), F.max(F.when(F.col("l_linestatus") == "F", "completed").otherwise("abandoned")).alias("official_status"))
    return reports.settled_job(job, official, "o_orderkey").select("o_orderkey", "reason", "outcome")


def q_folds(spark, sf):
    o = load(spark, sf, "orders").withColumn("fold", F.year("o_orderdate") - 1990).withColumn("day", F.when(F.col("o_orderkey") == 77, F.lit("2003-01-01")).otherwise(F.col("o_orderdate").cast("date").cast("string")))
    return reports.ordered_folds(o, "fold", "day")


def q_sample(spark, sf):
    li = load(spark, sf, "lineitem").select("l_returnflag", "l_orderkey").distinct()
    return reports.hash_sample(li, ["l_returnflag"], F.col("l_orderkey"), 5).select("l_returnflag", "l_orderkey")


def q_ridge(spark, sf):
    c = load(spark, sf, "supplier").select("s_nationkey", (F.col("s_suppkey") % 4).cast("double").alias("l2"), r(F.floor(F.col("s_acctbal") / 500) / 100).alias("score"), F.lit(0.05).alias("null_score"))
    return reports.best_ridge(c, ["s_nationkey"], "l2", "score", "null_score", 0.02).select("s_nationkey", "l2", "score", r(F.col("gain")).alias("gain"), "adjusted")


def q_gate(spark, sf):
    s = load(spark, sf, "supplier")
    metric = F.element_at(F.array(*map(F.lit, ["brier", "log_loss", "aces", "games"])), (F.col("s_suppkey") % 4 + 1).cast("int"))
    i = s.select("s_nationkey", metric.alias("metric"), r(F.col("s_acctbal") / 1e6 - 0.006).alias("difference"), r(F.col("s_acctbal") / 1e6 - 0.005).alias("ci_upper"), F.lit(0.003).alias("margin"), (F.col("s_nationkey") % 2 == 0).alias("complete"))
    return reports.recommendation(i, ["s_nationkey"], {"brier": 0.001, "log_loss": 0.002}, "margin", F.col("complete"))


def q_shares(spark, sf):
    o = load(spark, sf, "orders").withColumn("p", r((F.col("o_orderkey") * 37 % 1000) / 1000.0)).withColumn("n", F.col("o_custkey") * 10 % 3000)
    p, n = F.col("p"), F.col("n")
    low, high = F.greatest(F.lit(0.0), p - 0.004), F.least(F.lit(1.0), p + 0.002)
    a, b = reports.integer_bucket(F.floor(p * 100 + 0.5))
    why = reports.escalation(p, n, F.lit(0.01))
    return o.select("o_orderkey", r(a).alias("bucket_low"), r(b).alias("bucket_high"), reports.interval_integer(low, high).alias("whole"), F.array_join(why, ",").alias("reasons"), reports.stopping(n, p, low, high, F.col("o_orderkey") % 2 == 0).alias("status"))


def q_strength(spark, sf):
    o = load(spark, sf, "orders")
    days, k = (F.col("o_orderkey") % 400).cast("double"), F.col("o_orderkey").cast("double")
    ma, va = reports.decayed(F.col("o_totalprice") / 1e5, F.lit(0.5), days, 180.0, 0.3)
    mb, vb = reports.decayed((F.col("o_custkey") % 10) / 5.0, F.lit(0.8), days / 2, 180.0, 0.3)
    logit, variance, p = reports.strength(ma, va, mb, vb, F.lit(1.1), F.lit(0.05), F.lit(0.02))
    w = reports.reliability_weight([0.2, -0.5, 0.3, -0.4], variance, F.lit(1.0), F.lit(0.1), days / 400)
    return o.select("o_orderkey", r(logit).alias("logit"), r(variance).alias("variance"), r(p).alias("p"), r(w).alias("weight"), r(reports.tilted((k % 90 + 5) / 100.0, logit, 0.75, -1)).alias("tilted"))


_THETA = {"theta0": 4.0, "points": 0.55, "games": 0.9, "sets": 2.0, "tiebreaks": 1.5}


def q_duration(spark, sf):
    """Minutes of a match of an order's lines, with a residual made from its key."""
    li = load(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.sum("l_quantity").alias("points"), F.count(F.lit(1)).alias("games"), F.max("l_linenumber").alias("sets"), F.count_if(F.col("l_tax") == 0).alias("tiebreaks"))
    pace = (F.col("l_orderkey") % 9 - 4) / 2.0
    center, scale = reports.duration_center(_THETA, F.col("points"), F.col("games"), F.col("sets"), F.col("tiebreaks"), pace), reports.duration_scale(1.0, 0.7, F.col("points"))
    m = reports.duration_minutes(center, scale, (F.col("l_orderkey") % 41 - 20) / 8.0)
    return li.select("l_orderkey", m.alias("m")).select("l_orderkey", r(F.col("m.latent")).alias("latent"), "m.floor", "m.nearest", "m.ceiling")


_TWO = f"{_F}, t AS (SELECT *, p * 0.8 + 0.1 AS q FROM f)"
_LOSS = "-CASE WHEN y = 1 THEN ln(least(1 - 1e-15, greatest(1e-15, x))) ELSE ln(1 - least(1 - 1e-15, greatest(1e-15, x))) END"
_LG = lambda x: f"(CASE WHEN {x} >= 0 THEN 1 / (1 + exp(-({x}))) ELSE exp({x}) / (1 + exp({x})) END)"
QUERIES = {
    "family_report": (q_family, f"WITH {_F}, s AS (SELECT *, {_ST} AS st, (p - y) * (p - y) AS b FROM f) SELECT source, count(*) AS n_targets, count(*) FILTER (st = 'SETTLED') AS n_settled, count(*) FILTER (st = 'VOID') AS n_void, count(*) FILTER (st = 'UNAVAILABLE') AS n_unavailable, count(*) FILTER (st = 'DISABLED') AS n_disabled, round(avg(b) FILTER (st = 'SETTLED'), 6) AS brier, round(avg(p) FILTER (st = 'SETTLED'), 6) AS mean_p, round(avg(y) FILTER (st = 'SETTLED'), 6) AS frequency FROM s GROUP BY 1"),
    "metric_rows": (q_metrics, f"WITH {_TWO}, u AS (SELECT lang, y, 'v1' AS variant, p AS x FROM t UNION ALL SELECT lang, y, 'v2', q FROM t) SELECT variant, coalesce(lang, 'ALL') AS lang, count(*) AS n, round(avg((x - y) * (x - y)), 6) AS brier, round(avg({_LOSS}), 6) AS log_loss, round(avg(((x >= 0.5)::INT = y)::INT), 6) AS accuracy FROM u GROUP BY GROUPING SETS ((variant), (variant, lang))"),
    "settlement_comparison": (q_compared, f"WITH {_F}, t AS (SELECT *, CASE WHEN doc_id % 5 = 0 THEN p ELSE p * 0.8 + 0.1 END AS q FROM f), b AS (SELECT lang, (p - y) * (p - y) AS a, (q - y) * (q - y) AS b FROM t) SELECT lang, count(*) AS n, round(avg(a), 6) AS brier_a, round(avg(b), 6) AS brier_b, count(*) FILTER (a < b) AS a_better, count(*) FILTER (b < a) AS b_better, count(*) FILTER (a = b) AS tied FROM b GROUP BY 1"),
    "audit_summary": (q_audit, f"WITH {_F} SELECT lang, coalesce(source, 'ALL') AS source, count(*) AS n, round(avg(y - p), 6) AS bias, round(sqrt(var_samp(y - p) / count(*)), 6) AS bias_se, round(avg((p - y) * (p - y)), 6) AS brier, round(1 - avg((p - y) * (p - y)) / 0.25, 6) AS skill, round(avg(((p >= 0.5)::INT = y)::INT), 6) AS accuracy FROM f GROUP BY GROUPING SETS ((lang), (lang, source))"),
    "exact_score_distribution": (q_scores, "WITH p AS (SELECT l_suppkey % 2 AS winner, CASE WHEN l_suppkey % 2 = 0 THEN 2 ELSE l_linenumber % 3 END AS a, CASE WHEN l_suppkey % 2 = 0 THEN l_linenumber % 2 ELSE 2 END AS b, CAST(trunc(l_quantity) AS INT) AS games FROM lineitem) SELECT winner, CAST(a AS INT) AS a, CAST(b AS INT) AS b, count(*) AS n_paths, count(*) FILTER (NOT (CASE WHEN winner = 0 THEN a ELSE b END = 2 AND CASE WHEN winner = 0 THEN b ELSE a END < 2 AND games BETWEEN 6 * (a + b) AND 13 * (a + b))) AS n_incoherent, round(avg(games), 6) AS mean_games FROM p GROUP BY 1, 2, 3"),
    "service_point_totals": (q_service, "WITH e AS (SELECT user_id, event_id % 3 <> 0 AS f, event_type = 'purchase' AS a, event_type = 'error' AS d, value > 10 AS w FROM events) SELECT user_id, count(*) AS service_points, count(*) FILTER (f) AS first_serves_in, count(*) FILTER (f AND a) AS aces, count(*) FILTER (f AND w) AS first_serve_points_won, count(*) FILTER (NOT f AND d) AS double_faults, count(*) FILTER (NOT f AND NOT d AND w) AS second_serve_points_won FROM e GROUP BY 1"),
    "residual_summary": (q_residuals, "WITH e AS (SELECT value - (20.0 + user_id % 7) AS e, event_id % 100 AS x FROM events) SELECT CASE WHEN x < 30 THEN 'low' WHEN x < 70 THEN 'middle' ELSE 'high' END AS band, count(*) AS n, round(avg(e), 6) AS mean_error, round(avg(abs(e)), 6) AS mae, round(sqrt(avg(e * e)), 6) AS rmse, round(corr(e, x), 6) AS r FROM e GROUP BY 1"),
    "interval_coverage": (q_intervals, "WITH e AS (SELECT abs(value - 20.0) / (5.0 + user_id % 3) AS z, 5.0 + user_id % 3 AS s FROM events), l(level, q) AS (VALUES (0.5, 0.741), (0.8, 1.533), (0.95, 2.776)) SELECT CAST(level AS DOUBLE) AS level, count(*) AS n, round(avg((z <= q)::INT), 6) AS coverage, round(avg(2 * s * q), 6) AS width FROM e, l GROUP BY 1"),
    "event_match_audit": (q_match_audit, "WITH m AS (SELECT l_orderkey, count(*) AS n, min(CASE WHEN l_tax <> 0 THEN l_quantity END) AS m, count(CASE WHEN l_tax <> 0 THEN 1 END) AS k, min(l_extendedprice) AS p, min(CAST(CAST(l_shipdate AS DATE) AS VARCHAR)) AS d, max((l_returnflag = 'R')::INT) AS r FROM lineitem GROUP BY 1) SELECT count(*) AS n_matches, count(*) FILTER (n = 2 AND k = 2 AND m > 0 AND p > 0) AS n_usable, min(d) AS first, max(d) AS last, CAST(sum(r) AS BIGINT) AS n_retired, (SELECT count(DISTINCT l_suppkey) FROM lineitem) AS n_players FROM m"),
    "coverage_report": (q_coverage, "WITH d AS (SELECT CASE WHEN doc_id % 5 = 0 THEN 'NO_DATE' WHEN doc_id % 7 = 0 THEN 'LATE' ELSE 'INCLUDED' END AS a, CASE WHEN n_chars < 500 THEN 'short' ELSE 'long' END AS b, (lang <> 'en')::INT AS k FROM documents) SELECT 'reason' AS kind, a AS name, count(*) AS n, CAST(sum(k) AS BIGINT) AS n_known FROM d GROUP BY 2 UNION ALL SELECT 'band', b, count(*), CAST(sum(k) AS BIGINT) FROM d GROUP BY 2"),
    "audit_reconciliation": (q_reconciled, "SELECT count(*) FILTER (l_tax > 0.03) AS n_included, count(*) FILTER (NOT l_tax > 0.03) AS n_excluded, count(*) AS n_all, true AS adds_up FROM lineitem"),
    "settlement_frequency_check": (q_frequency, f"WITH {_F}, s AS (SELECT *, {_ST} AS st, 0.9 - p / 10 AS ps FROM f) SELECT lang, count(*) AS n, round(avg(ps), 6) AS predicted_settled, round(avg((st = 'SETTLED')::INT), 6) AS observed_settled, round(avg(1 - ps), 6) AS predicted_void, round(avg((st = 'VOID')::INT), 6) AS observed_void FROM s WHERE st IN ('SETTLED', 'VOID') GROUP BY 1"),
    "official_settlement": (q_official, "WITH l AS (SELECT l_orderkey, max(CASE WHEN l_tax > 0 THEN l_quantity END) AS v, max(CASE WHEN l_linestatus = 'F' THEN 'completed' ELSE 'abandoned' END) AS st FROM lineitem WHERE l_linenumber = 1 GROUP BY 1), j AS (SELECT o_orderkey, CASE WHEN st IS NULL THEN 'NO_OFFICIAL_RESULT' WHEN st <> 'completed' THEN 'NOT_COMPLETED' WHEN v IS NULL THEN 'NO_VALUE' END AS reason, v > o_custkey % 50 AS over FROM orders LEFT JOIN l ON l_orderkey = o_orderkey) SELECT o_orderkey, reason, CASE WHEN reason IS NULL THEN CASE WHEN over THEN 'YES' ELSE 'NO' END END AS outcome FROM j"),
    "fold_bounds": (q_folds, "WITH o AS (SELECT year(o_orderdate) - 1990 AS fold, CASE WHEN o_orderkey = 77 THEN '2003-01-01' ELSE CAST(CAST(o_orderdate AS DATE) AS VARCHAR) END AS day FROM orders), b AS (SELECT fold, count(*) AS n, min(day) AS first, max(day) AS last FROM o GROUP BY 1) SELECT *, coalesce(last < lead(first) OVER (ORDER BY fold), true) AS in_order FROM b"),
    "group_hash_sample": (q_sample, "SELECT l_returnflag, l_orderkey FROM (SELECT DISTINCT l_returnflag, l_orderkey FROM lineitem) QUALIFY row_number() OVER (PARTITION BY l_returnflag ORDER BY sha256(CAST(l_orderkey AS VARCHAR))) <= 5"),
    "ridge_pick": (q_ridge, "WITH c AS (SELECT s_nationkey, CAST(s_suppkey % 4 AS DOUBLE) AS l2, round(floor(s_acctbal / 500) / 100, 6) AS score FROM supplier), b AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY s_nationkey ORDER BY score, l2 DESC) = 1) SELECT s_nationkey, CASE WHEN 0.05 - score >= 0.02 THEN l2 END AS l2, score, round(0.05 - score, 6) AS gain, 0.05 - score >= 0.02 AS adjusted FROM b"),
    "promotion_gate": (q_gate, "WITH i AS (SELECT s_nationkey, CASE s_suppkey % 4 WHEN 0 THEN 'brier' WHEN 1 THEN 'log_loss' WHEN 2 THEN 'aces' ELSE 'games' END AS metric, round(s_acctbal / 1e6 - 0.006, 6) AS d, round(s_acctbal / 1e6 - 0.005, 6) AS u FROM supplier), g AS (SELECT s_nationkey, string_agg(DISTINCT metric, ',' ORDER BY metric) FILTER (CASE metric WHEN 'brier' THEN d > -0.001 OR u >= 0 WHEN 'log_loss' THEN d > -0.002 OR u >= 0 ELSE u > 0.003 END) AS failed FROM i GROUP BY 1) SELECT s_nationkey, coalesce(failed, '') AS failed, CASE WHEN failed IS NOT NULL THEN 'FAIL' WHEN s_nationkey % 2 = 1 THEN 'INCONCLUSIVE' ELSE 'PASS' END AS recommendation FROM g"),
    "simulated_share_states": (q_shares, "WITH o AS (SELECT o_orderkey, CAST((o_orderkey * 37 % 1000) AS DOUBLE) / 1000 AS p, o_custkey * 10 % 3000 AS n FROM orders), i AS (SELECT *, floor(p * 100 + 0.5) AS k, floor(greatest(0, p - 0.004) * 100 + 0.5) AS a, floor(least(1, p + 0.002) * 100 + 0.5) AS b, abs(p * 100 - (floor(p * 100) + 0.5)) / 100 AS far FROM o) SELECT o_orderkey, round(greatest(0, (k - 0.5) / 100), 6) AS bucket_low, round(least(1, (k + 0.5) / 100), 6) AS bucket_high, CAST(CASE WHEN a = b THEN a END AS BIGINT) AS whole, concat_ws(',', CASE WHEN n < 1000 THEN 'FEWER_THAN_1000_SETTLED_PATHS' END, CASE WHEN least(far, 1 / 100.0 - far) <= 0.001 THEN 'INTEGER_SUBMISSION_MC_SENSITIVITY' END, CASE WHEN p > 0.97 THEN 'PROBABILITY_ABOVE_97_PERCENT' END, CASE WHEN p < 0.03 THEN 'PROBABILITY_BELOW_3_PERCENT' END) AS reasons, CASE WHEN n = 0 THEN CASE WHEN o_orderkey % 2 = 0 THEN 'UNAVAILABLE' ELSE 'CONTINUE' END WHEN a = b AND a = k THEN 'INTEGER_STABLE' WHEN o_orderkey % 2 = 0 THEN 'INTEGER_BOUNDARY_SENSITIVE' ELSE 'CONTINUE' END AS status FROM i"),
    "strength_prediction": (q_strength, f"WITH o AS (SELECT o_orderkey, o_orderkey % 400 AS d, exp(-(o_orderkey % 400) / 180.0) AS ra, exp(-(o_orderkey % 400) / 2.0 / 180.0) AS rb, o_totalprice / 1e5 AS ma, (o_custkey % 10) / 5.0 AS mb FROM orders), s AS (SELECT *, 1.1 * (ra * ma - rb * mb + 0.05) AS logit, 1.1 * 1.1 * (ra * ra * 0.5 + 0.09 * (1 - ra * ra) + rb * rb * 0.8 + 0.09 * (1 - rb * rb) + 0.02) AS variance FROM o), u AS (SELECT *, logit / sqrt(1 + pi() * variance / 8) AS z, 0.2 - 0.5 * ln((variance + 1e-12) / (1.0 + 1e-12)) + 0.3 * 0.1 - 0.4 * d / 400.0 AS e, ln((o_orderkey % 90 + 5) / 100.0 / (1 - (o_orderkey % 90 + 5) / 100.0)) - logit * 0.75 / 2 AS t FROM s) SELECT o_orderkey, round(logit, 6) AS logit, round(variance, 6) AS variance, round({_LG('z')}, 6) AS p, round({_LG('e')}, 6) AS weight, round({_LG('t')}, 6) AS tilted FROM u"),
    "duration_minutes": (q_duration, "WITH m AS (SELECT l_orderkey, sum(l_quantity) AS points, count(*) AS games, max(l_linenumber) AS sets, count(*) FILTER (l_tax = 0) AS tb FROM lineitem GROUP BY 1), x AS (SELECT l_orderkey, greatest(1.0, 4.0 + 0.55 * points + 0.9 * games + 2.0 * sets + 1.5 * tb + (l_orderkey % 9 - 4) / 2.0 + (1.0 + 0.7 * sqrt(points)) * (l_orderkey % 41 - 20) / 8.0) AS v FROM m) SELECT l_orderkey, round(v, 6) AS latent, CAST(greatest(1, floor(v)) AS BIGINT) AS floor, CAST(greatest(1, floor(v + 0.5)) AS BIGINT) AS nearest, CAST(greatest(1, ceil(v)) AS BIGINT) AS ceiling FROM x"),
}
