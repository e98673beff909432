"""Queries over training rows, provenance, cohorts, rally counts and effect predictions."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import matching, training
from tidemark.plans.evaluation import _F, forecasts
from tidemark.plans.reports import _ST, _status
from tidemark.sources.tables import load


def r(column, digits=6):
    return F.round(column, digits)


def player_rows(spark, sf):
    """Two rows for each order as those of its players, with gaps and contradictions."""
    o = load(spark, sf, "orders")
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    side = F.explode(F.array(*map(F.lit, [0, 1])))
    o = o.select("*", side.alias("s")).filter("NOT (o_orderkey % 31 = 0 AND s = 1)")
    s = F.col("s")
    when = lambda test, value: F.when(~test, value)
    return o.select(
        k.alias("match_id"), F.when((k % 37 == 0) & (s == 1), "B").otherwise("A").alias("tour"), (c + s).alias("player_id"), F.when((k % 29 == 0) & (s == 1), c + 5).otherwise(c + 1 - s).alias("opponent_id"),
        when((k % 23 == 0) & (s == 0), F.col("o_orderdate").cast("date")).alias("match_date"), F.date_add(F.col("o_orderdate").cast("date"), 1).cast("timestamp").alias("available_at"), F.when(k % 19 == 0, "retired").otherwise("completed").alias("status"),
        when(k % 17 == 0, F.when(k % 13 == 0, 0).otherwise(k % 150 + 30)).alias("minutes"), when((k % 11 == 0) & (s == 1), k % 90 + 40).alias("points"), (k % 30 + 12).alias("games"), (k % 3 + 1 + F.when((k % 43 == 0) & (s == 1), 1).otherwise(0)).alias("sets"), (k % 4).alias("tiebreaks"),
        F.concat(F.lit("s"), (k % 3).cast("string")).alias("source"), F.concat(F.lit("h"), (k % 5 + s).cast("string")).alias("snapshot"), F.concat(F.lit("h"), (k % 7).cast("string")).alias("dates"),
    )


_ROWS = """z AS (SELECT o_orderkey AS k, o_custkey AS c, s, CAST(o_orderdate AS DATE) AS d FROM orders, range(2) t(s) WHERE NOT (o_orderkey % 31 = 0 AND s = 1)),
f AS (SELECT k, count(*) AS n, bool_and(NOT (k % 37 = 0 AND s = 1)) AS tour, bool_and(NOT (k % 29 = 0 AND s = 1)) AS players, any_value(c) AS c, any_value(d) AS d FROM z GROUP BY 1),
x AS (SELECT *, date_diff('day', d, DATE '2001-01-01') AS age, CASE WHEN NOT tour THEN 'WRONG_OR_AMBIGUOUS_TOUR' WHEN n <> 2 THEN 'RECIPROCAL_ROW_COUNT' WHEN NOT players THEN 'NONRECIPROCAL_PLAYERS' WHEN k % 23 = 0 THEN 'MISSING_OR_INCONSISTENT_EXACT_DATE'
  WHEN d + 1 >= DATE '2001-01-01' THEN 'AT_OR_AFTER_INFORMATION_CUTOFF' WHEN date_diff('day', d, DATE '2001-01-01') < 0 THEN 'MATCH_DATE_AFTER_CUTOFF' WHEN date_diff('day', d, DATE '2001-01-01') > 1826 THEN 'OUTSIDE_TRAINING_WINDOW'
  WHEN k % 19 = 0 THEN 'NOT_COMPLETED' WHEN k % 17 = 0 THEN 'MISSING_OR_INCONSISTENT_DURATION' WHEN k % 13 = 0 THEN 'NONPOSITIVE_DURATION' WHEN k % 11 = 0 THEN 'MISSING_OR_NONPOSITIVE_POINTS' WHEN k % 43 = 0 THEN 'MISSING_OR_INCONSISTENT_SETS'
  WHEN k % 30 + 12 < 6 * (k % 3 + 1) OR k % 4 > k % 3 + 1 OR 2 * (k % 90 + 40) < 4 * (k % 30 + 12) THEN 'IMPOSSIBLE_EXPOSURES' END AS reason FROM f)"""


def _training(spark, sf):
    return training.duration_rows(player_rows(spark, sf), "A", F.expr("TIMESTAMP '2001-01-01 00:00:00'"))


def q_training(spark, sf):
    return _training(spark, sf)[0].select("match_id", "player_a_id", "player_b_id", "minutes", "points", "games", r(F.col("weight")).alias("weight"))


def q_training_reasons(spark, sf):
    return _training(spark, sf)[1].groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


def q_provenance(spark, sf):
    p = training.provenance(player_rows(spark, sf), "match_id", "source", "snapshot", "dates")
    return p.select("match_id", *[F.array_join(c, ",").alias(c) for c in ("sources", "snapshots", "crosswalks")])


def q_cohort(spark, sf):
    o = load(spark, sf, "orders").select("o_orderkey", "o_orderpriority", F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"))
    c = training.frozen_cohort(o, ["day", "o_orderkey"], F.col("o_orderpriority").isin("1-URGENT", "5-LOW") & F.col("day").between("1996-01-01", "1998-12-31"))
    return c.select("o_orderkey", "day", "target_sha256", "cohort_id")


def q_rally(spark, sf):
    e = load(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_quantity").cast("long") % 30 + 5).alias("w1"), (F.col("l_suppkey") % 15).alias("w2"), (F.col("l_partkey") % 20).alias("wr"), (F.col("l_linenumber") % 4).cast("long").alias("aces"), (F.col("l_suppkey") % 3).alias("df"), F.when(F.col("l_tax") != 0, F.col("l_partkey") % 25).alias("winners"), (F.col("l_orderkey") % 18).alias("errors"))
    s = training.rally_counts(*[F.col(c) for c in ("w1", "w2", "wr", "aces", "df", "winners", "errors")])
    return e.select("l_linenumber", s.alias("s")).groupBy("l_linenumber", "s.status").agg(F.count(F.lit(1)).alias("n"), F.sum("s.eligible").alias("eligible"), F.sum("s.other").alias("other"))


def q_predicted(spark, sf):
    s = load(spark, sf, "supplier").select(F.lit("server").alias("kind"), F.col("s_suppkey").alias("level"), (F.col("s_acctbal") / 1e5).alias("mean"), F.lit(0.02).alias("variance"))
    n = s.select(F.lit("returner").alias("kind"), (F.col("level") * 2).alias("level"), (-F.col("mean") / 2).alias("mean"), F.lit(0.03).alias("variance"))
    li = load(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", "l_partkey")
    p = training.predicted(li, s.unionByName(n), 0.3, [("server", "l_suppkey", 1.0, 0.1), ("returner", "l_partkey", -1.0, 0.2)])
    return p.groupBy("l_linenumber").agg(F.count(F.lit(1)).alias("n"), r(F.avg("eta")).alias("eta"), r(F.avg("variance")).alias("variance"))


def q_summary(spark, sf):
    f = forecasts(spark, sf).withColumn("status", _status()).withColumn("se", F.sqrt(F.col("p") * (1 - F.col("p")) / 1000))
    t = training.calibration_summary(f, ["lang", "source"], "doc_id", "status", "p", "y", "se", 0.015)
    return t.select("n", "n_settled", "n_void", "n_locks", *[r(F.col(c)).alias(c) for c in ("brier", "log_loss", "within_tolerance", "void_first_share")])


def q_snapshot(spark, sf):
    o = load(spark, sf, "orders").select("o_orderkey", F.col("o_orderdate").alias("at"))
    snaps = o.filter("o_orderkey % 40 = 0").select(F.col("at").alias("data_end"), F.col("o_orderkey").alias("snapshot"))
    got = matching.version_as_of(snaps, o.filter("o_orderkey % 9 = 1"), [], "at", "data_end", "snapshot", strict=False)
    return got.select("o_orderkey", F.col("asof_version").alias("snapshot"))


QUERIES = {
    "duration_training_rows": (q_training, f"WITH {_ROWS} SELECT k AS match_id, c AS player_a_id, c + 1 AS player_b_id, k % 150 + 30 AS minutes, 2 * (k % 90 + 40) AS points, k % 30 + 12 AS games, round(pow(2.0, -age / 730.0), 6) AS weight FROM x WHERE reason IS NULL"),
    "duration_training_reasons": (q_training_reasons, f"WITH {_ROWS} SELECT reason, count(*) AS n FROM x WHERE reason IS NOT NULL GROUP BY 1"),
    "match_provenance": (q_provenance, "WITH z AS (SELECT o_orderkey AS k, s FROM orders, range(2) t(s) WHERE NOT (o_orderkey % 31 = 0 AND s = 1)), g AS (SELECT k, list_sort(list(DISTINCT 'h' || (k % 5 + s))) AS h FROM z GROUP BY 1) SELECT k AS match_id, 's' || (k % 3) AS sources, array_to_string(h, ',') AS snapshots, CASE WHEN list_contains(h, 'h' || (k % 7)) THEN '' ELSE 'h' || (k % 7) END AS crosswalks FROM g"),
    "target_cohort": (q_cohort, "WITH t AS (SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS day FROM orders WHERE o_orderpriority IN ('1-URGENT', '5-LOW') AND o_orderdate BETWEEN TIMESTAMP '1996-01-01' AND TIMESTAMP '1998-12-31 23:59:59'), h AS (SELECT *, sha256(day || chr(31) || o_orderkey) AS target_sha256 FROM t), p AS (SELECT left(target_sha256, 2) AS c, sha256(string_agg(target_sha256, '' ORDER BY target_sha256)) AS h FROM h GROUP BY 1) SELECT o_orderkey, day, target_sha256, (SELECT sha256(string_agg(h, '' ORDER BY c)) FROM p) AS cohort_id FROM h"),
    "rally_directional_counts": (q_rally, "WITH e AS (SELECT l_linenumber, CAST(trunc(l_quantity) AS BIGINT) % 30 + 5 + l_suppkey % 15 + l_partkey % 20 - l_linenumber % 4 - l_suppkey % 3 AS eligible, CASE WHEN l_tax <> 0 THEN l_partkey % 25 END - l_linenumber % 4 AS w, l_orderkey % 18 - l_suppkey % 3 AS g FROM lineitem), s AS (SELECT *, eligible - w - g AS other, CASE WHEN w IS NULL THEN 'missing_input' WHEN eligible < 0 OR w < 0 OR g < 0 OR eligible - w - g < 0 THEN 'quarantined' ELSE 'valid' END AS status FROM e) SELECT l_linenumber, status, count(*) AS n, CAST(sum(eligible) AS BIGINT) AS eligible, CAST(sum(other) AS BIGINT) AS other FROM s GROUP BY 1, 2"),
    "effect_prediction": (q_predicted, "WITH p AS (SELECT l_linenumber, 0.3 + coalesce(a.s_acctbal / 1e5, 0) + coalesce(b.s_acctbal / 2e5, 0) AS eta, CASE WHEN a.s_suppkey IS NULL THEN 0.1 ELSE 0.02 END + CASE WHEN b.s_suppkey IS NULL THEN 0.2 ELSE 0.03 END AS v FROM lineitem LEFT JOIN supplier a ON a.s_suppkey = l_suppkey LEFT JOIN supplier b ON b.s_suppkey * 2 = l_partkey) SELECT l_linenumber, count(*) AS n, round(avg(eta), 6) AS eta, round(avg(v), 6) AS variance FROM p GROUP BY 1"),
    "calibration_status_summary": (q_summary, f"WITH {_F}, s AS (SELECT *, {_ST} AS st, (p - y) * (p - y) AS b, -CASE WHEN y = 1 THEN ln(least(1 - 1e-15, greatest(1e-15, p))) ELSE ln(1 - least(1 - 1e-15, greatest(1e-15, p))) END AS l FROM f), k AS (SELECT arg_min(st, doc_id) AS st FROM s GROUP BY lang, source) SELECT count(*) AS n, count(*) FILTER (st = 'SETTLED') AS n_settled, count(*) FILTER (st = 'VOID') AS n_void, (SELECT count(*) FROM k) AS n_locks, round(avg(b) FILTER (st = 'SETTLED'), 6) AS brier, round(avg(l) FILTER (st = 'SETTLED'), 6) AS log_loss, round(avg((sqrt(p * (1 - p) / 1000) <= 0.015)::INT), 6) AS within_tolerance, round((SELECT avg((st = 'VOID')::INT) FROM k), 6) AS void_first_share FROM s"),
    "snapshot_as_of": (q_snapshot, "SELECT o.o_orderkey, arg_max(v.o_orderkey, (v.o_orderdate, v.o_orderkey)) AS snapshot FROM orders o LEFT JOIN orders v ON v.o_orderkey % 40 = 0 AND v.o_orderdate <= o.o_orderdate WHERE o.o_orderkey % 9 = 1 GROUP BY 1"),
}
