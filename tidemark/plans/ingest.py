"""Queries over scans, selection, duplicates and entity resolution.

lineitem stands for service rows, orders for match headers, events for player timelines."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import scalar as S
from tidemark.operators import counts, entity, selection
from tidemark.sources.tables import load

#: Service counts from lineitem's numbers; the same text holds in Spark and in DuckDB.
SERVICE = {
    "service_points": "CAST(l_quantity AS BIGINT)",
    "first_serves_in": "CASE WHEN l_linenumber = 7 THEN NULL ELSE CAST(floor(l_quantity * (0.5 + l_tax * 8)) AS BIGINT) END",
    "aces": "CAST(floor(l_discount * 50) AS BIGINT)",
    "first_serve_points_won": "CAST(floor(l_quantity * 0.4) AS BIGINT)",
    "double_faults": "CAST(l_linenumber - 1 AS BIGINT)",
    "second_serve_points_won": "CAST(floor(l_quantity * 0.15) AS BIGINT)",
}
_SERVICE_SQL = ", ".join(f"{v} AS {k}" for k, v in SERVICE.items())


def service(spark, sf):
    rows = load(spark, sf, "lineitem")
    return rows.select("l_orderkey", "l_linenumber", "l_suppkey", "l_partkey", "l_shipdate", *[F.expr(v).alias(k) for k, v in SERVICE.items()])


_ROWS = f"r AS (SELECT l_orderkey, l_linenumber, l_suppkey, l_shipdate, {_SERVICE_SQL} FROM lineitem)"
_COUNTS = f"""{_ROWS},
x AS (
  SELECT *, 'F' AS component, first_serves_in AS successes, service_points AS trials, service_points IS NULL OR first_serves_in IS NULL AS missing,
    [CASE WHEN first_serves_in > service_points THEN 'FIRST_SERVES_IN_GT_SERVICE_POINTS' END] AS own FROM r
  UNION ALL SELECT *, 'A', aces, first_serves_in, aces IS NULL OR first_serves_in IS NULL, [CASE WHEN aces > first_serves_in THEN 'ACES_GT_FIRST_SERVES_IN' END] FROM r
  UNION ALL SELECT *, 'Q1', first_serve_points_won - aces, first_serves_in - aces, first_serves_in IS NULL,
    [CASE WHEN aces > first_serves_in THEN 'ACES_GT_FIRST_SERVES_IN' END, CASE WHEN aces > first_serve_points_won THEN 'ACES_GT_FIRST_SERVE_POINTS_WON' END,
     CASE WHEN first_serve_points_won > first_serves_in THEN 'FIRST_SERVE_POINTS_WON_GT_FIRST_SERVES_IN' END] FROM r
  UNION ALL SELECT *, 'D', double_faults, service_points - first_serves_in, first_serves_in IS NULL,
    [CASE WHEN first_serves_in > service_points THEN 'FIRST_SERVES_IN_GT_SERVICE_POINTS' END, CASE WHEN double_faults > service_points - first_serves_in THEN 'DOUBLE_FAULTS_GT_SECOND_SERVE_OPPORTUNITIES' END] FROM r
  UNION ALL SELECT *, 'Q2', second_serve_points_won, service_points - first_serves_in - double_faults, first_serves_in IS NULL,
    [CASE WHEN first_serves_in > service_points THEN 'FIRST_SERVES_IN_GT_SERVICE_POINTS' END, CASE WHEN double_faults > service_points - first_serves_in THEN 'DOUBLE_FAULTS_GT_SECOND_SERVE_OPPORTUNITIES' END,
     CASE WHEN second_serve_points_won > service_points - first_serves_in - double_faults THEN 'SECOND_SERVE_POINTS_WON_GT_PLAYABLE_SECOND_SERVES' END] FROM r),
y AS (SELECT *, CASE WHEN missing THEN [] ELSE list_filter(list_concat(own, [CASE WHEN trials < 0 THEN 'NEGATIVE_TRIALS' END, CASE WHEN successes < 0 THEN 'NEGATIVE_SUCCESSES' END, CASE WHEN successes > trials THEN 'SUCCESSES_GT_TRIALS' END]), lambda q: q IS NOT NULL) END AS codes FROM x),
c AS (SELECT *, CASE WHEN missing THEN 'missing_input' WHEN len(codes) > 0 THEN 'quarantined' WHEN trials = 0 THEN 'zero_denominator' ELSE 'valid' END AS status FROM y)"""
KEYS = ["l_orderkey", "l_linenumber", "l_suppkey", "l_shipdate"]
_CUT = "TIMESTAMP '1999-01-01 00:00:00'"


def q_component_counts(spark, sf):
    c = counts.component_counts(service(spark, sf), KEYS)
    return c.select("l_orderkey", "l_linenumber", "component", "successes", "trials", "status", "eligible", F.array_join("anomaly_codes", ",").alias("codes"))


def q_status(spark, sf):
    return counts.status_summary(counts.component_counts(service(spark, sf), KEYS))


def q_anomalies(spark, sf):
    a = counts.anomalies(counts.component_counts(service(spark, sf), KEYS), KEYS)
    return a.groupBy("component", "code").agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct("l_orderkey").alias("n_matches"))


def q_unpivot(spark, sf):
    li = load(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_suppkey").alias("w_id"), F.col("l_partkey").alias("l_id"), F.col("l_quantity").alias("w_points"), F.col("l_extendedprice").alias("l_points"))
    return counts.unpivot_sides(li, ["l_orderkey", "l_linenumber"], {"winner": "w_", "loser": "l_"}, ["points"])


def _matches(spark, sf):
    """Service rows with a time at which each became known: unknown for some, and not the same for all rows of some matches."""
    li, o = load(spark, sf, "lineitem"), load(spark, sf, "orders")
    known = F.when(F.col("l_tax") == 0.08, None).when(F.col("l_orderkey") % 5 == 0, F.col("l_shipdate")).otherwise(F.col("o_orderdate"))
    return li.join(o, li.l_orderkey == o.o_orderkey).select("l_orderkey", "l_linenumber", "l_suppkey", "l_quantity", "l_extendedprice", known.alias("available"))


_MATCHES = """m AS (SELECT l_orderkey, l_linenumber, l_suppkey, l_quantity, l_extendedprice, CASE WHEN l_tax = 0.08 THEN NULL WHEN l_orderkey % 5 = 0 THEN l_shipdate ELSE o_orderdate END AS available
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
k AS (SELECT *, CASE WHEN count(available) OVER w < count(*) OVER w THEN 'UNKNOWN_AVAILABILITY' WHEN min(available) OVER w <> max(available) OVER w THEN 'INCONSISTENT_MATCH_AVAILABILITY'
  WHEN min(available) OVER w >= TIMESTAMP '1999-01-01 00:00:00' THEN 'AT_OR_AFTER_INFORMATION_CUTOFF' END AS code FROM m WINDOW w AS (PARTITION BY l_orderkey))"""


def q_cutoff_selected(spark, sf):
    chosen, _ = selection.select_before_cutoff(_matches(spark, sf), "l_orderkey", "available", F.expr(_CUT))
    return chosen.groupBy("l_suppkey").agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct("l_orderkey").alias("n_matches"), F.round(F.sum("l_extendedprice"), 2).alias("total"))


def q_cutoff_excluded(spark, sf):
    _, out = selection.select_before_cutoff(_matches(spark, sf), "l_orderkey", "available", F.expr(_CUT))
    return out.groupBy(F.col("cutoff_code").alias("code")).agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct("l_orderkey").alias("n_matches"))


def _reasons(spark, sf):
    li, o = load(spark, sf, "lineitem"), load(spark, sf, "orders")
    d = li.join(o, li.l_orderkey == o.o_orderkey, "left")
    return d.withColumn(
        "reason",
        selection.first_reason([("NO_HEADER", F.col("o_orderkey").isNull()), ("AFTER_CUTOFF", F.col("l_shipdate") >= F.expr(_CUT)), ("SHIPPED_BEFORE_ORDER", F.col("l_shipdate") < F.col("o_orderdate")), ("RETURNED", F.col("l_returnflag") == "R"), ("NO_POINTS", F.col("l_quantity") <= 1)]),
    )


def q_reasons(spark, sf):
    return _reasons(spark, sf).groupBy(F.coalesce("reason", F.lit("INCLUDED")).alias("reason")).agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct("l_orderkey").alias("n_matches"))


def q_reciprocal(spark, sf):
    return load(spark, sf, "lineitem").groupBy("l_orderkey").agg(
        F.count(F.lit(1)).alias("n_rows"), selection.consistent("l_returnflag").alias("same_flag"), selection.consistent("l_linestatus").alias("same_status"), (F.count_distinct("l_suppkey") == F.count(F.lit(1))).alias("all_different")
    )


def q_recency(spark, sf):
    c = counts.component_counts(service(spark, sf), KEYS).filter("eligible")
    age = F.date_diff(F.lit("2001-06-01").cast("date"), F.col("l_shipdate").cast("date"))
    w = S.recency_weight(age, 365, 1095)
    c = c.withColumn("w", F.when(age > 0, w).otherwise(0.0)).filter("w > 0")
    return c.groupBy("component").agg(F.count(F.lit(1)).alias("n_rows"), F.round(F.sum(F.col("w") * F.col("successes")) / F.sum(F.col("w") * F.col("trials")), 9).alias("rate"), F.round(F.sum("w"), 6).alias("weight"))


def q_information(spark, sf):
    c = counts.component_counts(service(spark, sf), KEYS).filter("eligible AND component = 'F'")
    age = F.date_diff(F.lit("2001-06-01").cast("date"), F.col("l_shipdate").cast("date"))
    c = c.withColumn("w", F.when(age > 0, S.recency_weight(age, 365, 1095)).otherwise(0.0)).filter("w > 0")
    wn = F.col("w") * F.col("trials")
    return c.groupBy("l_suppkey").agg(
        F.round(F.sum(wn), 6).alias("weighted_trials"), F.round(F.sum(wn) ** 2 / F.sum(wn * wn), 6).alias("effective_rows"), F.round(F.sum(wn / (1 + (F.col("trials") - 1) * 0.05)), 6).alias("information"), (F.sum(wn) < 400).alias("sparse")
    )


def q_duplicates(spark, sf):
    li = load(spark, sf, "lineitem")
    return selection.duplicate_classes(li, ["l_orderkey", "l_linenumber"], F.struct("l_partkey", "l_suppkey", "l_quantity"), entity.pair(F.col("l_partkey"), F.col("l_suppkey"))).select("l_orderkey", "l_linenumber", "n_rows", "duplicate_class")


def q_keep_first(spark, sf):
    li = load(spark, sf, "lineitem")
    return selection.keep(li, ["l_orderkey", "l_linenumber"], [F.col("l_extendedprice"), F.col("l_partkey"), F.col("l_suppkey")]).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.round("l_extendedprice", 2).alias("price"))


def q_keep_last(spark, sf):
    li = load(spark, sf, "lineitem")
    rank = F.when(F.col("l_returnflag") == "R", 2).when(F.col("l_returnflag") == "A", 1).otherwise(0)
    return selection.keep(li, ["l_orderkey", "l_linenumber"], [rank.desc(), F.col("l_shipdate").desc(), F.col("l_extendedprice").desc(), F.col("l_partkey")]).select("l_orderkey", "l_linenumber", "l_returnflag", F.round("l_extendedprice", 2).alias("price"))


def q_as_of(spark, sf):
    o = load(spark, sf, "orders").select("o_orderkey", (F.col("o_custkey") % 100).alias("user_id"), F.expr("TIMESTAMP '2024-01-01 00:00:00' + make_interval(0, 0, 0, CAST(o_orderkey % 30 AS INT), CAST(o_orderkey % 24 AS INT), 0, 0)").alias("start"))
    e = load(spark, sf, "events").select("user_id", "ts", "event_id", "value")
    return selection.as_of(o, e, ["user_id"], "start", "ts", ["event_id", "value"]).select("o_orderkey", "user_id", F.col("asof_event_id").alias("event_id"), F.round("asof_value", 4).alias("price"))


def q_latest(spark, sf):
    e = load(spark, sf, "events").withColumn("hour", F.date_trunc("hour", "ts"))
    out = selection.latest_revision(e, "user_id", "hour", ["event_type", "value"], F.expr("TIMESTAMP '2024-01-20 00:00:00'"))
    return out.select("user_id", F.date_format("hour", "yyyy-MM-dd HH").alias("hour"), "event_type", F.round("value", 4).alias("value"), "conflict")


def q_inactive(spark, sf):
    e = load(spark, sf, "events").filter("event_type IN ('purchase', 'signup') AND ts < TIMESTAMP '2024-01-25 00:00:00'")
    last = e.groupBy("user_id").agg(F.max_by("event_id", F.struct("ts", "event_id")).alias("event_id"), F.max("ts").alias("ts"))
    u = load(spark, sf, "events").select("user_id").distinct().join(last, "user_id", "left")
    days = F.date_diff(F.lit("2024-09-30").cast("date"), F.col("ts").cast("date"))
    m, c = S.inactivity_factors(days)
    return u.select("user_id", "event_id", days.cast("long").alias("days"), F.round(m, 9).alias("mean_factor"), F.round(c, 9).alias("variance_factor"), S.inactivity_band(days).alias("band"))


def q_crosswalk(spark, sf):
    o = load(spark, sf, "orders").withColumn("day", F.col("o_orderdate").cast("date")).withColumn("customer", F.col("o_custkey") % 200)
    keys = ["customer", "o_orderpriority"]
    a = o.filter("o_orderkey % 2 = 0").select(F.col("o_orderkey").alias("source_id"), *keys, "day", "o_orderstatus")
    b = o.filter("o_orderkey % 2 = 1").select(F.col("o_orderkey").alias("other_id"), *keys, "day", "o_orderstatus")
    return entity.crosswalk(a, b, keys, "day", 3, 21, ["o_orderstatus"], "source_id", "other_id")


def q_names(spark, sf):
    words = entity.tokens(F.col("s_name"))
    known = load(spark, sf, "customer").select(F.regexp_extract("c_name", r"(\d{2})$", 1).alias("key"), F.when(F.col("c_custkey") % 1500 < 120, F.col("c_custkey")).otherwise(F.lit(0)).alias("c_custkey"))
    wanted = load(spark, sf, "supplier").select("s_suppkey", F.right(F.element_at(words, -1), F.lit(2)).alias("key"))
    return entity.resolve_names(known, wanted, "key", "c_custkey").select("s_suppkey", "n_ids", "resolved_id", "resolution")


def q_pairs(spark, sf):
    """Two halves of lineitem as forecasts of the same meetings from either side."""
    li = load(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_suppkey") % 20).alias("first"), (F.col("l_partkey") % 20).alias("second"), F.round(F.col("l_discount") * 5 + 0.1, 6).alias("p"))
    left = li.filter("l_linenumber % 2 = 1").select("l_orderkey", "first", "second")
    right = li.filter("l_linenumber % 2 = 0").select("l_orderkey", F.col("second").alias("a"), F.col("first").alias("b"), "p")
    return entity.unordered_join(left, right, ("first", "second"), ("a", "b"), ["l_orderkey"], "p").select("l_orderkey", "first", "second", F.round("p", 6).alias("p"), "turned")


def q_name_keys(spark, sf):
    words = entity.tokens(F.concat_ws(" ", "p_name", "p_brand", "p_type"))
    return load(spark, sf, "part").select("p_partkey", F.array_join(entity.surname_keys(words), ",").alias("name_keys"), entity.signature(words).alias("signature"))


def q_sets(spark, sf):
    d, lab = load(spark, sf, "documents").select("doc_id", "source"), load(spark, sf, "labels").select("doc_id")
    inside = d.join(lab, "doc_id", "left_semi").groupBy("source").agg(F.count(F.lit(1)).alias("n")).withColumn("side", F.lit("labelled"))
    outside = d.join(lab, "doc_id", "left_anti").groupBy("source").agg(F.count(F.lit(1)).alias("n")).withColumn("side", F.lit("unlabelled"))
    gone = lab.join(d, "doc_id", "left_anti").agg(F.count(F.lit(1)).alias("n")).withColumn("side", F.lit("missing"))
    return inside.unionByName(outside).unionByName(gone, allowMissingColumns=True).select("source", "n", "side")


QUERIES = {
    "component_counts": (q_component_counts, f"WITH {_COUNTS} SELECT l_orderkey, l_linenumber, component, successes, trials, status, status = 'valid' AS eligible, array_to_string(codes, ',') AS codes FROM c"),
    "component_status_summary": (q_status, f"WITH {_COUNTS} SELECT component, status, count(*) AS n_rows, CAST(sum(CASE WHEN status = 'valid' THEN successes END) AS BIGINT) AS successes, CAST(sum(CASE WHEN status = 'valid' THEN trials END) AS BIGINT) AS trials, count(*) FILTER (status = 'valid') AS n_eligible FROM c GROUP BY 1, 2"),
    "anomaly_codes_exploded": (q_anomalies, f"WITH {_COUNTS} SELECT component, code, count(*) AS n_rows, count(DISTINCT l_orderkey) AS n_matches FROM (SELECT component, l_orderkey, unnest(codes) AS code FROM c) GROUP BY 1, 2"),
    "unpivot_sides": (q_unpivot, "SELECT l_orderkey, l_linenumber, 'winner' AS orientation, l_suppkey AS player_id, l_partkey AS opponent_id, l_quantity AS points FROM lineitem UNION ALL SELECT l_orderkey, l_linenumber, 'loser', l_partkey, l_suppkey, l_extendedprice FROM lineitem"),
    "cutoff_selected": (q_cutoff_selected, f"WITH {_MATCHES} SELECT l_suppkey, count(*) AS n_rows, count(DISTINCT l_orderkey) AS n_matches, round(sum(l_extendedprice), 2) AS total FROM k WHERE code IS NULL GROUP BY 1"),
    "cutoff_excluded_reasons": (q_cutoff_excluded, f"WITH {_MATCHES} SELECT code, count(*) AS n_rows, count(DISTINCT l_orderkey) AS n_matches FROM k WHERE code IS NOT NULL GROUP BY 1"),
    "ordered_reason_case": (q_reasons, f"SELECT CASE WHEN o_orderkey IS NULL THEN 'NO_HEADER' WHEN l_shipdate >= {_CUT} THEN 'AFTER_CUTOFF' WHEN l_shipdate < o_orderdate THEN 'SHIPPED_BEFORE_ORDER' WHEN l_returnflag = 'R' THEN 'RETURNED' WHEN l_quantity <= 1 THEN 'NO_POINTS' ELSE 'INCLUDED' END AS reason, count(*) AS n_rows, count(DISTINCT l_orderkey) AS n_matches FROM lineitem LEFT JOIN orders ON l_orderkey = o_orderkey GROUP BY 1"),
    "reciprocal_consistency": (q_reciprocal, "SELECT l_orderkey, count(*) AS n_rows, count(DISTINCT l_returnflag) = 1 AS same_flag, count(DISTINCT l_linestatus) = 1 AS same_status, count(DISTINCT l_suppkey) = count(*) AS all_different FROM lineitem GROUP BY 1"),
    "recency_weighted_rate": (q_recency, f"WITH {_COUNTS}, v AS (SELECT *, date_diff('day', CAST(l_shipdate AS DATE), DATE '2001-06-01') AS age FROM c WHERE status = 'valid'), u AS (SELECT *, pow(2.0, -age / 365.0) AS w FROM v WHERE age > 0 AND age <= 1095) SELECT component, count(*) AS n_rows, round(sum(w * successes) / sum(w * trials), 9) AS rate, round(sum(w), 6) AS weight FROM u GROUP BY 1"),
    "player_information": (q_information, f"WITH {_COUNTS}, v AS (SELECT *, date_diff('day', CAST(l_shipdate AS DATE), DATE '2001-06-01') AS age FROM c WHERE status = 'valid' AND component = 'F'), u AS (SELECT *, pow(2.0, -age / 365.0) * trials AS wn FROM v WHERE age > 0 AND age <= 1095) SELECT l_suppkey, round(sum(wn), 6) AS weighted_trials, round(pow(sum(wn), 2) / sum(wn * wn), 6) AS effective_rows, round(sum(wn / (1 + (trials - 1) * 0.05)), 6) AS information, sum(wn) < 400 AS sparse FROM u GROUP BY 1"),
    "duplicate_classification": (q_duplicates, "SELECT l_orderkey, l_linenumber, count(*) AS n_rows, CASE WHEN count(DISTINCT (least(l_partkey, l_suppkey), greatest(l_partkey, l_suppkey))) > 1 THEN 'MATCH_KEY_COLLISION' WHEN count(DISTINCT (l_partkey, l_suppkey, l_quantity)) = 1 THEN 'EXACT_DUPLICATE' ELSE 'CONFLICTING_RECORDS' END AS duplicate_class FROM lineitem GROUP BY 1, 2 HAVING count(*) >= 2"),
    "keep_first_exact": (q_keep_first, "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(l_extendedprice, 2) AS price FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_extendedprice, l_partkey, l_suppkey) = 1"),
    "keep_last_priority": (q_keep_last, "SELECT l_orderkey, l_linenumber, l_returnflag, round(l_extendedprice, 2) AS price FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY CASE l_returnflag WHEN 'R' THEN 2 WHEN 'A' THEN 1 ELSE 0 END DESC, l_shipdate DESC, l_extendedprice DESC, l_partkey) = 1"),
    "asof_latest_event": (q_as_of, "WITH o AS (SELECT o_orderkey, o_custkey % 100 AS user_id, TIMESTAMP '2024-01-01 00:00:00' + to_days(CAST(o_orderkey % 30 AS INT)) + to_hours(CAST(o_orderkey % 24 AS INT)) AS start FROM orders), j AS (SELECT o.o_orderkey, o.user_id, e.event_id, e.value, row_number() OVER (PARTITION BY o.o_orderkey ORDER BY e.ts DESC, e.event_id DESC) AS n FROM o LEFT JOIN events e ON e.user_id = o.user_id AND e.ts < o.start) SELECT o_orderkey, user_id, event_id, round(value, 4) AS price FROM j WHERE n = 1"),
    "latest_revision": (q_latest, "WITH e AS (SELECT *, date_trunc('hour', ts) AS hour FROM events WHERE date_trunc('hour', ts) < TIMESTAMP '2024-01-20 00:00:00'), t AS (SELECT *, dense_rank() OVER (PARTITION BY user_id ORDER BY hour DESC) AS r FROM e), g AS (SELECT user_id, hour, min((event_type, value)) AS p, count(DISTINCT (event_type, value)) > 1 AS conflict FROM t WHERE r = 1 GROUP BY 1, 2) SELECT user_id, strftime(hour, '%Y-%m-%d %H') AS hour, p[1] AS event_type, round(p[2], 4) AS value, conflict FROM g"),
    "inactivity_factors": (q_inactive, "WITH l AS (SELECT user_id, arg_max(event_id, (ts, event_id)) AS event_id, max(ts) AS ts FROM events WHERE event_type IN ('purchase', 'signup') AND ts < TIMESTAMP '2024-01-25 00:00:00' GROUP BY 1), u AS (SELECT DISTINCT user_id FROM events), d AS (SELECT u.user_id, event_id, date_diff('day', CAST(ts AS DATE), DATE '2024-09-30') AS days FROM u LEFT JOIN l ON l.user_id = u.user_id), f AS (SELECT *, pow(2.0, -greatest(0, days - 90) / 180.0) AS m FROM d) SELECT user_id, event_id, days, round(CASE WHEN days IS NULL THEN NULL ELSE m END, 9) AS mean_factor, round(CASE WHEN days IS NULL THEN NULL ELSE 2 - m * m END, 9) AS variance_factor, CASE WHEN days IS NULL THEN 'COLD_START' WHEN days <= 90 THEN 'D_LE_90' WHEN days <= 180 THEN 'D_91_180' WHEN days <= 365 THEN 'D_181_365' ELSE 'D_GT_365' END AS band FROM f"),
    "crosswalk_one_to_one": (q_crosswalk, "WITH o AS (SELECT o_orderkey, o_custkey % 200 AS customer, o_orderpriority, CAST(o_orderdate AS DATE) AS day, o_orderstatus FROM orders), a AS (SELECT * FROM o WHERE o_orderkey % 2 = 0), b AS (SELECT * FROM o WHERE o_orderkey % 2 = 1), m AS (SELECT a.o_orderkey, count(*) AS n, count(*) FILTER (a.o_orderstatus = b.o_orderstatus) AS ns, min(CASE WHEN a.o_orderstatus = b.o_orderstatus THEN b.o_orderkey END) AS c FROM a JOIN b ON a.customer = b.customer AND a.o_orderpriority = b.o_orderpriority AND b.day - a.day BETWEEN -3 AND 21 GROUP BY 1), s AS (SELECT a.o_orderkey, c, CASE WHEN count(*) OVER (PARTITION BY customer, o_orderpriority, day, o_orderstatus) > 1 THEN 'DUPLICATE_SOURCE_MATCH' WHEN ns = 1 THEN 'MATCHED' WHEN ns > 1 THEN 'AMBIGUOUS' WHEN n > 0 THEN 'STRUCTURAL_CONFLICT' ELSE 'UNMATCHED' END AS st FROM a LEFT JOIN m ON a.o_orderkey = m.o_orderkey), t AS (SELECT o_orderkey, c, CASE WHEN st = 'MATCHED' AND count(*) OVER (PARTITION BY CASE WHEN st = 'MATCHED' THEN c END) > 1 THEN 'REUSED_AUGMENTATION_ROW' ELSE st END AS status FROM s) SELECT o_orderkey AS source_id, status, CASE WHEN status = 'MATCHED' THEN c END AS matched_id FROM t"),
    "exact_key_identity": (q_names, "WITH k AS (SELECT right(c_name, 2) AS key, list_sort(list(DISTINCT CASE WHEN c_custkey % 1500 < 120 THEN c_custkey ELSE 0 END)) AS ids FROM customer GROUP BY 1) SELECT s_suppkey, CAST(coalesce(len(ids), 0) AS BIGINT) AS n_ids, CASE WHEN len(ids) = 1 THEN ids[1] END AS resolved_id, CASE WHEN len(ids) = 1 THEN 'MATCHED' WHEN len(ids) > 1 THEN 'AMBIGUOUS' ELSE 'NEW' END AS resolution FROM supplier LEFT JOIN k ON right(s_name, 2) = key"),
    "unordered_pair_join": (q_pairs, "WITH li AS (SELECT l_orderkey, l_linenumber, l_suppkey % 20 AS first, l_partkey % 20 AS second, round(l_discount * 5 + 0.1, 6) AS p FROM lineitem WHERE l_suppkey % 20 <> l_partkey % 20), a AS (SELECT * FROM li WHERE l_linenumber % 2 = 1 QUALIFY count(*) OVER (PARTITION BY l_orderkey, least(first, second), greatest(first, second)) = 1), b AS (SELECT * FROM li WHERE l_linenumber % 2 = 0 QUALIFY count(*) OVER (PARTITION BY l_orderkey, least(first, second), greatest(first, second)) = 1) SELECT a.l_orderkey, a.first, a.second, round(CASE WHEN b.second = a.first THEN b.p ELSE 1 - b.p END, 6) AS p, b.second <> a.first AS turned FROM a JOIN b ON a.l_orderkey = b.l_orderkey AND least(a.first, a.second) = least(b.first, b.second) AND greatest(a.first, a.second) = greatest(b.first, b.second)"),
    "name_keys": (q_name_keys, "WITH t AS (SELECT p_partkey, regexp_extract_all(lower(p_name || ' ' || p_brand || ' ' || p_type), '[a-z0-9]+') AS w FROM part) SELECT p_partkey, CASE WHEN len(w) < 2 THEN '' ELSE array_to_string(list_transform(range(1, least(4, len(w) - 1) + 1), lambda k: array_to_string(w[len(w) - k + 1:len(w)], '') || '|' || left(w[1], 1)), ',') END AS name_keys, left(w[1], 1) || '|' || w[len(w)] AS signature FROM t"),
    "set_membership": (q_sets, "SELECT source, count(*) AS n, 'labelled' AS side FROM documents WHERE doc_id IN (SELECT doc_id FROM labels) GROUP BY 1 UNION ALL SELECT source, count(*), 'unlabelled' FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) GROUP BY 1 UNION ALL SELECT NULL, count(*), 'missing' FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents)"),
}
