"""Queries over evaluation, windows, ledgers and scalars.

labels.quality is a binary outcome and a document's size gives its forecast; events are timelines and a ledger."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.functions import scalar as S
from tidemark.operators import evaluate, selection, timeline
from tidemark.sources.tables import load

_P = "((n_chars * 7 + doc_id * 13) % 1000) / 1000.0"
_F = f"f AS (SELECT d.doc_id, d.lang, d.source, {_P} AS p, CAST(l.quality AS INT) AS y, l.toxic FROM documents d JOIN labels l USING (doc_id))"
_US = "TIMESTAMP '2024-01-01 00:00:00'"


def forecasts(spark, sf):
    d, lab = load(spark, sf, "documents"), load(spark, sf, "labels")
    return d.join(lab, "doc_id").select("doc_id", "lang", "source", F.expr(_P).cast("double").alias("p"), F.col("quality").cast("int").alias("y"), "toxic")


def r(column, digits=9):
    return F.round(column, digits)


def q_calibration(spark, sf):
    f = forecasts(spark, sf)
    b = evaluate.brier(F.col("p"), F.col("y"))
    return f.agg(F.count(F.lit(1)).alias("n"), r(F.avg(b)).alias("brier"), r(F.avg(evaluate.log_loss(F.col("p"), F.col("y"))), 6).alias("log_loss"), r(F.percentile(b, F.lit(0.5))).alias("median"), r(F.percentile(b, F.lit(0.95))).alias("p95"), F.count_if(b > 0.25).alias("n_bad"))


def q_tenths(spark, sf):
    t = evaluate.reliability(forecasts(spark, sf), "p", "y")
    return t.select("bin", "n", *[r(F.col(c)).alias(c) for c in ("mean_p", "frequency", "brier")])


def q_right(spark, sf):
    f = forecasts(spark, sf)
    return f.groupBy(evaluate.right_closed(F.col("p"), [0.0, 0.1, 0.25, 0.5, 0.75, 0.9, 1.0]).alias("band")).agg(F.count(F.lit(1)).alias("n"), r(F.avg("p")).alias("mean_p"), r(F.avg("y")).alias("frequency"))


def q_groups(spark, sf):
    f = forecasts(spark, sf)
    return f.groupBy("lang", S.confidence_band(F.col("p")).alias("band")).agg(F.count(F.lit(1)).alias("n"), r(F.avg(evaluate.brier(F.col("p"), F.col("y")))).alias("brier"))


def q_strata(spark, sf):
    t = evaluate.stratified(forecasts(spark, sf), "p", "y", ["lang", "source", "toxic"])
    return t.select("lang", "source", "toxic", "n", r(F.col("brier")).alias("brier"), r(F.col("log_loss"), 6).alias("log_loss"), r(F.col("accuracy")).alias("accuracy"))


def q_auc(spark, sf):
    return evaluate.auc(forecasts(spark, sf), "p", "y", ["lang"]).select("lang", "n", r(F.col("auc")).alias("auc"))


def q_worst(spark, sf):
    f = forecasts(spark, sf).withColumn("e", evaluate.brier(F.col("p"), F.col("y")))
    return evaluate.worst_share(f, "e", ["lang"]).select("lang", "n_worst", r(F.col("worst")).alias("worst"))


def q_skill(spark, sf):
    f = forecasts(spark, sf)
    c = f.select("doc_id", F.lit("model").alias("comparator"), "p", "y").unionAll(f.filter("doc_id % 3 != 0").select("doc_id", F.lit("flat"), F.lit(0.8), "y")).unionAll(f.filter("doc_id % 2 = 0").select("doc_id", F.lit("coin"), F.lit(0.5), "y"))
    t = evaluate.skill(c, "doc_id", "comparator", "p", "y", "flat")
    return t.select("comparator", "n", "n_paired", r(F.col("brier")).alias("brier"), r(F.col("skill")).alias("skill"))


def q_incidence(spark, sf):
    o, c = load(spark, sf, "orders"), load(spark, sf, "customer")
    d = o.join(c, o.o_custkey == c.c_custkey).select("c_mktsegment", "o_orderpriority", (F.col("o_orderstatus") == "P").cast("int").alias("y"), (0.2 + (F.col("o_custkey") % 10) * 0.03).alias("p"))
    t = evaluate.incidence(d, "p", "y", [["c_mktsegment"], ["c_mktsegment", "o_orderpriority"]], ["c_mktsegment", "o_orderpriority"])
    return t.select("c_mktsegment", "o_orderpriority", "n", "observed", r(F.col("expected"), 6).alias("expected"), r(F.col("z"), 6).alias("z"), "status")


def q_posterior(spark, sf):
    o = load(spark, sf, "orders").withColumn("w", F.pow(F.lit(2.0), -F.date_diff(F.lit("2002-01-01").cast("date"), F.col("o_orderdate").cast("date")) / F.lit(730.0)))
    y = F.sum(F.when(F.col("o_orderstatus") == "P", F.col("w")).otherwise(0.0))
    tour = o.agg(y.alias("y"), F.sum("w").alias("n")).select(((F.col("y") + 0.5) / (F.col("n") + 1)).alias("rho"))
    player = o.groupBy("o_custkey").agg(y.alias("y"), F.sum("w").alias("n"))
    # The other side is one row.
    t = player.crossJoin(F.broadcast(tour))
    a, b = 100 * F.col("rho") + F.col("y"), 100 * (1 - F.col("rho")) + F.col("n") - F.col("y")
    return t.select("o_custkey", r(a, 6).alias("alpha"), r(b, 6).alias("beta"), r(a / (a + b)).alias("mean"), S.history_band(F.col("n")).alias("band"))


def q_settlement(spark, sf):
    o = load(spark, sf, "orders")
    settled = F.col("o_orderstatus").isin("F", "O")
    return o.groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("n"), r(F.avg(settled.cast("int"))).alias("settled_rate"), r(F.avg(F.when(settled, (F.col("o_orderstatus") == "F").cast("int")))).alias("yes_rate"), F.count_if(~settled).alias("n_void"))


def q_deciles(spark, sf):
    li = load(spark, sf, "lineitem").select("l_returnflag", (F.col("l_extendedprice") / 105000).alias("p"), (F.col("l_discount") > 0.05).cast("int").alias("y"))
    return evaluate.quantile_bins(li, "p", ["l_returnflag"]).groupBy("l_returnflag", "bin").agg(F.count(F.lit(1)).alias("n"), r(F.avg("p")).alias("mean_p"), r(F.avg("y")).alias("frequency"))


def q_correlation(spark, sf):
    li = load(spark, sf, "lineitem")
    return li.groupBy("l_linenumber").agg(r(F.corr("l_quantity", "l_extendedprice"), 6).alias("pearson"), r(F.avg(F.col("l_quantity") - F.col("l_extendedprice") / 2000), 6).alias("bias"), r(F.sqrt(F.avg((F.col("l_quantity") - F.col("l_extendedprice") / 2000) ** 2)), 6).alias("rmse"), r(F.avg(F.abs(F.col("l_quantity") - F.col("l_extendedprice") / 2000)), 6).alias("mae"))


def q_spearman(spark, sf):
    li = load(spark, sf, "lineitem").select("l_returnflag", "l_quantity", "l_extendedprice")
    a = evaluate.average_ranks(li, "l_quantity", ["l_returnflag"], "ra")
    return evaluate.average_ranks(a, "l_extendedprice", ["l_returnflag"], "rb").groupBy("l_returnflag").agg(r(F.corr("ra", "rb"), 6).alias("spearman"))


def _timeline(spark, sf):
    return load(spark, sf, "events").withColumn("us", F.unix_micros("ts"))


def q_workload(spark, sf):
    e = _timeline(spark, sf)
    minutes = F.when(F.col("event_type") != "error", F.col("value"))
    t = timeline.trailing_workload(e.withColumn("m", minutes), ["user_id"], "us", "m", days=3)
    return t.select("event_id", "n_recent", r(F.col("workload"), 6).alias("workload"))


def q_layoffs(spark, sf):
    t = timeline.layoff_islands(_timeline(spark, sf).filter("event_type = 'purchase'"), ["user_id"], "us", 1.0)
    return t.select("event_id", r(F.col("gap_days"), 6).alias("gap_days"), F.col("island").cast("long").alias("island"), r(F.col("severity"), 6).alias("severity"), "since_return")


def q_recovery(spark, sf):
    t = timeline.gaps(_timeline(spark, sf), ["user_id"], "us")
    return t.groupBy("event_type").agg(F.count("gap_days").alias("n"), r(F.avg(timeline.short_recovery(F.col("gap_days"))), 6).alias("short_recovery"))


def q_sample(spark, sf):
    li = load(spark, sf, "lineitem").select("l_returnflag", "l_orderkey", "l_linenumber").distinct()
    h = F.sha2(F.concat_ws("|", "l_orderkey", "l_linenumber"), 256)
    return selection.keep(li.withColumn("h", h), ["l_returnflag", "l_linenumber"], [F.col("h")]).select("l_returnflag", "l_linenumber", "l_orderkey", "h")


def q_top(spark, sf):
    f = forecasts(spark, sf).withColumn("e", r(evaluate.brier(F.col("p"), F.col("y"))))
    return f.orderBy(F.desc("e"), "doc_id").limit(18).select("doc_id", "e")


def q_skip(spark, sf):
    f = forecasts(spark, sf).withColumn("e", evaluate.brier(F.col("p"), F.col("y")))
    n = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("e"), "doc_id"))
    return f.withColumn("n", n).filter("n > 2").groupBy("lang").agg(F.count(F.lit(1)).alias("n_left"), r(F.avg("e")).alias("brier"))


def q_grid(spark, sf):
    f = forecasts(spark, sf)
    grid = spark.range(1, 10).select((F.col("id") / 10.0).alias("weight")).crossJoin(spark.range(1, 5).select((F.col("id") / 5.0).alias("anchor")))
    p = F.col("weight") * F.col("p") + (1 - F.col("weight")) * F.col("anchor")
    scores = f.crossJoin(F.broadcast(grid)).groupBy("lang", "weight", "anchor").agg(r(F.avg(evaluate.brier(p, F.col("y")))).alias("brier"))
    best = scores.groupBy("lang").agg(F.min(F.struct("brier", "weight", "anchor")).alias("b"))
    return best.select("lang", "b.brier", "b.weight", "b.anchor")


def q_rollup(spark, sf):
    o = load(spark, sf, "orders")
    return o.rollup("o_orderpriority", F.year("o_orderdate").alias("year")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("o_orderstatus") == "F").alias("matched"), r(F.avg((F.col("o_orderstatus") == "F").cast("int"))).alias("coverage"))


def q_audit(spark, sf):
    o = load(spark, sf, "orders")
    return o.groupBy("o_orderpriority", F.year("o_orderdate").alias("year"), F.quarter("o_orderdate").alias("quarter")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"), F.min("o_totalprice").alias("least"), F.max("o_totalprice").alias("most"))


def _ledger(spark, sf):
    e = load(spark, sf, "events")
    w = Window.partitionBy("user_id").orderBy("event_id")
    content = F.concat_ws("~", "event_id", "event_type", "props")
    e = e.withColumn("sequence", F.row_number().over(w)).withColumn("content", content)
    e = e.withColumn("own", F.sha2(F.concat_ws("|", F.coalesce(F.sha2(F.lag("content").over(w), 256), F.lit("")), "content"), 256))
    return e


def q_chain(spark, sf):
    e = _ledger(spark, sf)
    w = Window.partitionBy("user_id").orderBy("sequence")
    e = e.withColumn("previous", F.when(F.col("event_id") % 97 != 0, F.lag("own").over(w))).withColumn("own", F.sha2(F.concat_ws("|", F.coalesce("previous", F.lit("")), "content"), 256))
    e = e.withColumn("own", F.when(F.col("event_id") % 101 == 0, F.sha2("own", 256)).otherwise(F.col("own"))).withColumn("sequence", F.when(F.col("event_id") % 103 == 0, F.col("sequence") + 1000).otherwise(F.col("sequence")))
    t = timeline.chain(e, ["user_id"], "sequence", "previous", "own", F.col("content"))
    return t.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.count_if("gapless").alias("n_gapless"), F.count_if("hash_ok").alias("n_hash_ok"))


def q_effective(spark, sf):
    e = load(spark, sf, "events").select("event_id", "value", F.when(F.col("event_id") % 4 != 0, F.col("event_id") - F.col("event_id") % 3 - 1).alias("corrects"))
    e = e.withColumn("corrects", F.when(F.col("corrects") >= 0, F.col("corrects")))
    return timeline.effective_rows(e, "event_id", "corrects", "event_id").select("event_id", "root", F.round("value", 4).alias("value"))


def q_components(spark, sf):
    li = load(spark, sf, "lineitem").select((F.col("l_orderkey") * 2).alias("a"), (F.col("l_partkey") * 2 + 1).alias("b"))
    t = timeline.components(li, "a", "b")
    return t.groupBy("component").agg(F.count(F.lit(1)).alias("n_nodes"), F.max("node").alias("largest"))


def q_identities(spark, sf):
    li = load(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", (0.5 + F.col("l_discount")).alias("f"), (F.col("l_tax") * 2).alias("a"), (0.6 + F.col("l_discount")).alias("q1"), F.col("l_tax").alias("d"), (0.45 + F.col("l_discount")).alias("q2")).distinct()
    p = S.serve_win(*[F.col(c) for c in ("f", "a", "q1", "d", "q2")])
    return li.select("l_orderkey", "l_linenumber", "l_partkey", r(p).alias("p"), r(F.col("f") * F.col("a")).alias("ace_rate"), r((1 - F.col("f")) * F.col("d")).alias("df_rate"), r(S.hold(p)).alias("hold"), r(S.logit(p), 6).alias("logit"))


def q_percent(spark, sf):
    f = forecasts(spark, sf)
    n = S.percent_half_up(F.col("p"))
    return f.select("doc_id", n.alias("percent"), S.platform_percent(n).alias("shown"), S.confidence_band(F.col("p")).alias("band"))


def q_prices(spark, sf):
    o = load(spark, sf, "orders")
    a, b = 1.2 + (F.col("o_orderkey") % 40) / 20.0, 1.3 + (F.col("o_custkey") % 30) / 15.0
    p, over = S.no_vig(a, b)
    ra, rb = 1500 + F.col("o_custkey") % 300, 1500 + F.col("o_orderkey") % 300
    none, first, second = S.competing(S.intensity(0.01 + (F.col("o_custkey") % 5) / 100.0), S.intensity(0.01 + (F.col("o_orderkey") % 7) / 100.0))
    return o.select("o_orderkey", r(p).alias("market"), r(over).alias("overround"), r(S.elo_expectation(ra, rb)).alias("elo"), r(none).alias("no_one"), r(first).alias("first"), r(second).alias("second"))


def q_scores(spark, sf):
    li = load(spark, sf, "lineitem").select(F.col("l_orderkey"), "l_linenumber", "l_partkey").distinct()
    a, b = F.col("l_partkey") % 8, F.col("l_orderkey") % 8
    score = F.concat(a.cast("string"), F.lit("-"), b.cast("string"), F.lit(" 7-6(5) "), b.cast("string"), F.lit("-"), a.cast("string"))
    pairs = S.set_pairs(score)
    won = F.transform(pairs, lambda s: S.set_winner(s["a"], s["b"]))
    return li.select("l_orderkey", "l_linenumber", "l_partkey", score.alias("score"), S.reverse_score(score).alias("reversed"), F.size(pairs).cast("long").alias("n_sets"), F.aggregate(pairs, F.lit(0), lambda s, x: s + x["a"] + x["b"]).cast("long").alias("games"), F.size(F.filter(won, lambda x: x == 0)).cast("long").alias("sets_a"), F.size(F.filter(won, lambda x: x.isNull())).cast("long").alias("illegal"))


def q_rounds(spark, sf):
    o = load(spark, sf, "orders")
    draw = F.element_at(F.array(*map(F.lit, [28, 32, 48, 64, 96, 128])), (F.col("o_orderkey") % 6 + 1).cast("int"))
    code = F.element_at(F.array(*map(F.lit, ["R128", "R64", "R32", "R16", "QF", "SF", "F"])), (F.col("o_custkey") % 7 + 1).cast("int"))
    return o.select("o_orderkey", S.expected_round(code, draw).alias("round"), S.game_score(F.col("o_orderkey") % 5, F.col("o_custkey") % 4).alias("game"), S.tiebreak_server((F.col("o_orderkey") % 2).cast("int"), (F.col("o_custkey") % 13).cast("int")).cast("long").alias("server"))


def q_sha(spark, sf):
    return load(spark, sf, "customer").select("c_custkey", S.stable_id(F.col("c_custkey"), F.col("c_name"), F.when(F.col("c_custkey") % 3 != 0, F.col("c_mktsegment"))).alias("id"))


def q_uuid(spark, sf):
    return load(spark, sf, "customer").select("c_custkey", S.uuid5(uuid.NAMESPACE_URL, F.col("c_name")).alias("id"))


def q_json(spark, sf):
    e = load(spark, sf, "events")
    k = F.get_json_object("props", "$.k").cast("bigint")
    canonical = F.to_json(F.struct(F.col("event_id").alias("event_id"), k.alias("k"), F.col("event_type").alias("type")))
    return e.select("event_id", k.alias("k"), canonical.alias("canonical"), F.sha2(canonical, 256).alias("sha256"))


def q_dot(spark, sf):
    e = load(spark, sf, "embeddings")
    first = load(spark, sf, "embeddings").filter("vec_id = 0").select(F.col("embedding").alias("w"))
    return e.crossJoin(F.broadcast(first)).select("vec_id", r(S.dot(F.col("embedding"), F.col("w")), 6).alias("dot"))


def q_ks(spark, sf):
    e = load(spark, sf, "events").withColumn("k", F.get_json_object("props", "$.k").cast("bigint"))
    e = e.withColumn("u", (F.col("k") + 0.5) / 100)
    return evaluate.ks_uniform(e, "u", ["event_type"]).select("event_type", "n", r(F.col("ks")).alias("ks"))


_E = "e AS (SELECT *, epoch_us(ts) AS us FROM events)"
QUERIES = {
    "calibration_summary": (q_calibration, f"WITH {_F}, b AS (SELECT *, (p - y) * (p - y) AS b FROM f) SELECT count(*) AS n, round(avg(b), 9) AS brier, round(avg(-CASE WHEN y = 1 THEN ln(least(1 - 1e-15, greatest(1e-15, p))) ELSE ln(1 - least(1 - 1e-15, greatest(1e-15, p))) END), 6) AS log_loss, round(quantile_cont(b, 0.5), 9) AS median, round(quantile_cont(b, 0.95), 9) AS p95, count(*) FILTER (b > 0.25) AS n_bad FROM b"),
    "reliability_fixed_tenths": (q_tenths, f"WITH {_F}, g AS (SELECT least(CAST(floor(p * 10) AS INT), 9) AS bin, count(*) AS n, avg(p) AS mp, avg(y) AS fr, avg((p - y) * (p - y)) AS b FROM f GROUP BY 1) SELECT CAST(i AS INT) AS bin, coalesce(n, 0) AS n, round(mp, 9) AS mean_p, round(fr, 9) AS frequency, round(b, 9) AS brier FROM range(10) t(i) LEFT JOIN g ON g.bin = i"),
    "reliability_right_closed": (q_right, f"WITH {_F} SELECT CASE WHEN p <= 0.1 THEN 0 WHEN p <= 0.25 THEN 1 WHEN p <= 0.5 THEN 2 WHEN p <= 0.75 THEN 3 WHEN p <= 0.9 THEN 4 ELSE 5 END AS band, count(*) AS n, round(avg(p), 9) AS mean_p, round(avg(y), 9) AS frequency FROM f GROUP BY 1"),
    "group_calibration": (q_groups, f"WITH {_F} SELECT lang, CASE WHEN abs(p - 0.5) >= 0.4 THEN 'High' WHEN abs(p - 0.5) >= 0.25 THEN 'Medium' ELSE 'Low' END AS band, count(*) AS n, round(avg((p - y) * (p - y)), 9) AS brier FROM f GROUP BY 1, 2"),
    "stratified_metrics_grouping_sets": (q_strata, f"WITH {_F} SELECT lang, source, toxic, count(*) AS n, round(avg((p - y) * (p - y)), 9) AS brier, round(avg(-CASE WHEN y = 1 THEN ln(least(1 - 1e-15, greatest(1e-15, p))) ELSE ln(1 - least(1 - 1e-15, greatest(1e-15, p))) END), 6) AS log_loss, round(avg(CASE WHEN (p >= 0.5) = (y = 1) THEN 1 ELSE 0 END), 9) AS accuracy FROM f GROUP BY GROUPING SETS ((), (lang), (source), (toxic))"),
    "auc_mann_whitney": (q_auc, f"WITH {_F}, k AS (SELECT lang, y, rank() OVER (PARTITION BY lang ORDER BY p) + (count(*) OVER (PARTITION BY lang, p) - 1) / 2.0 AS r FROM f), s AS (SELECT lang, count(*) AS n, sum(y) AS n1, sum(r * y) AS s FROM k GROUP BY 1) SELECT lang, n, round((s - n1 * (n1 + 1) / 2.0) / nullif(n1 * (n - n1), 0), 9) AS auc FROM s"),
    "worst_decile": (q_worst, f"WITH {_F}, k AS (SELECT lang, (p - y) * (p - y) AS e, row_number() OVER (PARTITION BY lang ORDER BY (p - y) * (p - y) DESC) AS i, count(*) OVER (PARTITION BY lang) AS n FROM f) SELECT lang, count(*) AS n_worst, round(avg(e), 9) AS worst FROM k WHERE i <= greatest(1, ceil(0.1 * n)) GROUP BY 1"),
    "comparator_skill": (q_skill, f"WITH {_F}, c AS (SELECT doc_id, 'model' AS comparator, p, y FROM f UNION ALL SELECT doc_id, 'flat', 0.8, y FROM f WHERE doc_id % 3 <> 0 UNION ALL SELECT doc_id, 'coin', 0.5, y FROM f WHERE doc_id % 2 = 0), s AS (SELECT *, (p - y) * (p - y) AS b FROM c), j AS (SELECT s.*, t.b AS base FROM s LEFT JOIN s t ON t.doc_id = s.doc_id AND t.comparator = 'flat') SELECT comparator, count(*) AS n, count(base) AS n_paired, round(avg(b), 9) AS brier, round(1 - avg(CASE WHEN base IS NOT NULL THEN b END) / avg(base), 9) AS skill FROM j GROUP BY 1"),
    "retirement_incidence_z": (q_incidence, "WITH d AS (SELECT c_mktsegment, o_orderpriority, CASE WHEN o_orderstatus = 'P' THEN 1 ELSE 0 END AS y, 0.2 + (o_custkey % 10) * 0.03 AS p FROM orders JOIN customer ON o_custkey = c_custkey), g AS (SELECT c_mktsegment, o_orderpriority, count(*) AS n, CAST(sum(y) AS BIGINT) AS observed, sum(CAST(p AS DOUBLE)) AS e, sum(CAST(p AS DOUBLE) * (1 - CAST(p AS DOUBLE))) AS v FROM d GROUP BY GROUPING SETS ((c_mktsegment), (c_mktsegment, o_orderpriority))) SELECT c_mktsegment, o_orderpriority, n, observed, round(e, 6) AS expected, round((observed - e) / sqrt(v), 6) AS z, CASE WHEN abs((observed - e) / sqrt(v)) <= 2 THEN 'CONSISTENT' WHEN observed > e THEN 'MORE' ELSE 'FEWER' END AS status FROM g"),
    "retirement_beta_posterior": (q_posterior, "WITH o AS (SELECT *, pow(2.0, -date_diff('day', CAST(o_orderdate AS DATE), DATE '2002-01-01') / 730.0) AS w FROM orders), t AS (SELECT (sum(CASE WHEN o_orderstatus = 'P' THEN w ELSE 0 END) + 0.5) / (sum(w) + 1) AS rho FROM o), g AS (SELECT o_custkey, sum(CASE WHEN o_orderstatus = 'P' THEN w ELSE 0 END) AS y, sum(w) AS n FROM o GROUP BY 1) SELECT o_custkey, round(100 * rho + y, 6) AS alpha, round(100 * (1 - rho) + n - y, 6) AS beta, round((100 * rho + y) / (100 + n), 9) AS mean, CASE WHEN n <= 0 THEN 'no_history' WHEN n < 25 THEN 'sparse' WHEN n < 100 THEN 'intermediate' ELSE 'substantial' END AS band FROM g, t"),
    "settlement_frequency": (q_settlement, "SELECT o_orderpriority, count(*) AS n, round(avg(CASE WHEN o_orderstatus IN ('F', 'O') THEN 1 ELSE 0 END), 9) AS settled_rate, round(avg(CASE WHEN o_orderstatus = 'F' THEN 1 WHEN o_orderstatus = 'O' THEN 0 END), 9) AS yes_rate, count(*) FILTER (o_orderstatus NOT IN ('F', 'O')) AS n_void FROM orders GROUP BY 1"),
    "hold_deciles": (q_deciles, "WITH d AS (SELECT l_returnflag, l_extendedprice / 105000 AS p, CASE WHEN l_discount > 0.05 THEN 1 ELSE 0 END AS y FROM lineitem), q AS (SELECT l_returnflag, quantile_cont(p, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]) AS e FROM d GROUP BY 1), b AS (SELECT d.*, CAST(len(list_filter(e, lambda x: p >= x)) AS INT) AS bin FROM d JOIN q USING (l_returnflag)) SELECT l_returnflag, bin, count(*) AS n, round(avg(p), 9) AS mean_p, round(avg(y), 9) AS frequency FROM b GROUP BY 1, 2"),
    "residual_correlation": (q_correlation, "SELECT l_linenumber, round(corr(l_quantity, l_extendedprice), 6) AS pearson, round(avg(l_quantity - l_extendedprice / 2000), 6) AS bias, round(sqrt(avg(pow(l_quantity - l_extendedprice / 2000, 2))), 6) AS rmse, round(avg(abs(l_quantity - l_extendedprice / 2000)), 6) AS mae FROM lineitem GROUP BY 1"),
    "spearman": (q_spearman, "WITH k AS (SELECT l_returnflag, rank() OVER (PARTITION BY l_returnflag ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_returnflag, l_quantity) - 1) / 2.0 AS a, rank() OVER (PARTITION BY l_returnflag ORDER BY l_extendedprice) + (count(*) OVER (PARTITION BY l_returnflag, l_extendedprice) - 1) / 2.0 AS b FROM lineitem) SELECT l_returnflag, round(corr(a, b), 6) AS spearman FROM k GROUP BY 1"),
    "trailing_workload": (q_workload, f"WITH {_E}, u AS (SELECT *, CASE WHEN event_type <> 'error' THEN value END AS m FROM e), j AS (SELECT a.event_id, count(b.event_id) AS n, count(b.m) AS k, sum(b.m * (0.7 * pow(2.0, -(a.us - b.us) / 86400000000.0 / 3.0) + 0.3 * pow(2.0, -(a.us - b.us) / 86400000000.0 / 14.0)) / 300.0) AS w FROM u a LEFT JOIN u b ON b.user_id = a.user_id AND b.us >= a.us - 3 * 86400000000 AND b.us < a.us GROUP BY 1) SELECT event_id, n AS n_recent, round(CASE WHEN n = 0 THEN 0.0 WHEN k < n THEN NULL ELSE w END, 6) AS workload FROM j"),
    "layoff_islands": (q_layoffs, f"WITH {_E}, g AS (SELECT *, (us - lag(us) OVER (PARTITION BY user_id ORDER BY us)) / 86400000000.0 AS gap FROM e WHERE event_type = 'purchase'), i AS (SELECT *, CAST(sum(CASE WHEN gap > 1 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY us) AS BIGINT) AS island FROM g), k AS (SELECT *, row_number() OVER w AS k, first_value(gap) OVER w AS g0 FROM i WINDOW w AS (PARTITION BY user_id, island ORDER BY us)) SELECT event_id, round(gap, 6) AS gap_days, island, round(CASE WHEN island > 0 AND k < 12 THEN ln(1 + (g0 - 1) / 30) ELSE 0.0 END, 6) AS severity, CASE WHEN island > 0 AND k < 12 THEN k ELSE 0 END AS since_return FROM k"),
    "short_recovery": (q_recovery, f"WITH {_E}, g AS (SELECT *, (us - lag(us) OVER (PARTITION BY user_id ORDER BY us)) / 86400000000.0 AS gap FROM e) SELECT event_type, count(gap) AS n, round(avg(CASE WHEN gap IS NOT NULL THEN greatest(0, 2 - gap) / 2 ELSE 0 END), 6) AS short_recovery FROM g GROUP BY 1"),
    "hash_sample_per_group": (q_sample, "WITH d AS (SELECT DISTINCT l_returnflag, l_orderkey, l_linenumber, sha256(l_orderkey || '|' || l_linenumber) AS h FROM lineitem) SELECT l_returnflag, l_linenumber, l_orderkey, h FROM d QUALIFY row_number() OVER (PARTITION BY l_returnflag, l_linenumber ORDER BY h) = 1"),
    "topk_errors": (q_top, f"WITH {_F} SELECT doc_id, round((p - y) * (p - y), 9) AS e FROM f ORDER BY 2 DESC, 1 LIMIT 18"),
    "skip_topk": (q_skip, f"WITH {_F}, k AS (SELECT lang, (p - y) * (p - y) AS e, row_number() OVER (PARTITION BY lang ORDER BY (p - y) * (p - y) DESC, doc_id) AS n FROM f) SELECT lang, count(*) AS n_left, round(avg(e), 9) AS brier FROM k WHERE n > 2 GROUP BY 1"),
    "grid_argmin": (q_grid, f"WITH {_F}, g AS (SELECT i / 10.0 AS weight, j / 5.0 AS anchor FROM range(1, 10) a(i), range(1, 5) b(j)), s AS (SELECT lang, weight, anchor, round(avg(pow(weight * p + (1 - weight) * anchor - y, 2)), 9) AS brier FROM f, g GROUP BY 1, 2, 3) SELECT lang, m[1] AS brier, m[2] AS weight, m[3] AS anchor FROM (SELECT lang, min((brier, weight, anchor)) AS m FROM s GROUP BY 1)"),
    "rollup_coverage": (q_rollup, "SELECT o_orderpriority, year(o_orderdate) AS year, count(*) AS n, count(*) FILTER (o_orderstatus = 'F') AS matched, round(avg(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END), 9) AS coverage FROM orders GROUP BY ROLLUP (o_orderpriority, year(o_orderdate))"),
    "cutoff_audit": (q_audit, "SELECT o_orderpriority, year(o_orderdate) AS year, quarter(o_orderdate) AS quarter, count(*) AS n, round(sum(o_totalprice), 2) AS total, min(o_totalprice) AS least, max(o_totalprice) AS most FROM orders GROUP BY 1, 2, 3"),
    "ledger_chain_verify": (q_chain, "WITH a AS (SELECT event_id, user_id, concat_ws('~', event_id, event_type, props) AS content, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS seq FROM events), b AS (SELECT *, sha256(concat_ws('|', coalesce(sha256(lag(content) OVER (PARTITION BY user_id ORDER BY event_id)), ''), content)) AS own0 FROM a), c AS (SELECT *, CASE WHEN event_id % 97 <> 0 THEN lag(own0) OVER (PARTITION BY user_id ORDER BY seq) END AS previous FROM b), d AS (SELECT *, sha256(concat_ws('|', coalesce(previous, ''), content)) AS own1 FROM c), e AS (SELECT user_id, own1, CASE WHEN event_id % 101 = 0 THEN sha256(own1) ELSE own1 END AS own, CASE WHEN event_id % 103 = 0 THEN seq + 1000 ELSE seq END AS sequence FROM d), f AS (SELECT user_id, sequence = row_number() OVER (PARTITION BY user_id ORDER BY sequence) AS gapless, own = own1 AS hash_ok FROM e) SELECT user_id, count(*) AS n, count(*) FILTER (gapless) AS n_gapless, count(*) FILTER (hash_ok) AS n_hash_ok FROM f GROUP BY 1"),
    "ledger_effective_rows": (q_effective, "WITH RECURSIVE e AS (SELECT event_id, value, CASE WHEN event_id % 4 <> 0 AND event_id - event_id % 3 - 1 >= 0 THEN event_id - event_id % 3 - 1 END AS parent FROM events), t AS (SELECT event_id, event_id AS root FROM e WHERE parent IS NULL UNION ALL SELECT e.event_id, t.root FROM e JOIN t ON e.parent = t.event_id) SELECT e.event_id, root, round(value, 4) AS value FROM t JOIN e USING (event_id) QUALIFY row_number() OVER (PARTITION BY root ORDER BY e.event_id DESC) = 1"),
    "connected_components": (q_components, None),
    "serve_identities": (q_identities, "WITH d AS (SELECT DISTINCT l_orderkey, l_linenumber, l_partkey, 0.5 + l_discount AS f, l_tax * 2 AS a, 0.6 + l_discount AS q1, l_tax AS d, 0.45 + l_discount AS q2 FROM lineitem), p AS (SELECT *, f * (a + (1 - a) * q1) + (1 - f) * ((1 - d) * q2) AS p FROM d) SELECT l_orderkey, l_linenumber, l_partkey, round(p, 9) AS p, round(f * a, 9) AS ace_rate, round((1 - f) * d, 9) AS df_rate, round(pow(p, 4) * (1 + 4 * (1 - p) + 10 * pow(1 - p, 2)) + 20 * pow(p, 3) * pow(1 - p, 3) * pow(p, 2) / (pow(p, 2) + pow(1 - p, 2)), 9) AS hold, round(ln(p / (1 - p)), 6) AS logit FROM p"),
    "half_up_percent": (q_percent, f"WITH {_F}, n AS (SELECT *, CAST(floor(p * 100 + 0.5) AS BIGINT) AS percent FROM f) SELECT doc_id, percent, least(99, greatest(1, percent)) AS shown, CASE WHEN abs(p - 0.5) >= 0.4 THEN 'High' WHEN abs(p - 0.5) >= 0.25 THEN 'Medium' ELSE 'Low' END AS band FROM n"),
    "market_elo_competing": (q_prices, "WITH d AS (SELECT o_orderkey, CAST(1.2 + (o_orderkey % 40) / 20.0 AS DOUBLE) AS a, CAST(1.3 + (o_custkey % 30) / 15.0 AS DOUBLE) AS b, 1500 + o_custkey % 300 AS ra, 1500 + o_orderkey % 300 AS rb, -ln(1 - CAST(0.01 + (o_custkey % 5) / 100.0 AS DOUBLE)) / 22 AS la, -ln(1 - CAST(0.01 + (o_orderkey % 7) / 100.0 AS DOUBLE)) / 22 AS lb FROM orders) SELECT o_orderkey, round((1 / a) / (1 / a + 1 / b), 9) AS market, round(1 / a + 1 / b, 9) AS overround, round(1 / (1 + pow(10.0, (rb - ra) / 400.0)), 9) AS elo, round(exp(-(la + lb)), 9) AS no_one, round((1 - exp(-(la + lb))) * la / (la + lb), 9) AS first, round((1 - exp(-(la + lb))) * lb / (la + lb), 9) AS second FROM d"),
    "score_parse": (q_scores, "WITH d AS (SELECT DISTINCT l_orderkey, l_linenumber, l_partkey, l_partkey % 8 AS a, l_orderkey % 8 AS b FROM lineitem), w AS (SELECT *, CASE WHEN greatest(a, b) = 6 AND least(a, b) <= 4 OR greatest(a, b) = 7 AND least(a, b) IN (5, 6) THEN CASE WHEN b > a THEN 1 ELSE 0 END END AS w FROM d) SELECT l_orderkey, l_linenumber, l_partkey, a || '-' || b || ' 7-6(5) ' || b || '-' || a AS score, b || '-' || a || ' 6-7(5) ' || a || '-' || b AS reversed, CAST(3 AS BIGINT) AS n_sets, 2 * (a + b) + 13 AS games, CAST(1 + CASE WHEN w IS NULL THEN 0 ELSE 1 END AS BIGINT) AS sets_a, CAST(CASE WHEN w IS NULL THEN 2 ELSE 0 END AS BIGINT) AS illegal FROM w"),
    "round_mapping": (q_rounds, "WITH d AS (SELECT o_orderkey, o_custkey, [28, 32, 48, 64, 96, 128][o_orderkey % 6 + 1] AS draw, ['R128', 'R64', 'R32', 'R16', 'QF', 'SF', 'F'][o_custkey % 7 + 1] AS code, o_orderkey % 5 AS x, o_custkey % 4 AS y FROM orders) SELECT o_orderkey, CASE WHEN code LIKE 'R%' THEN 'R' || CAST(ceil(log2(draw)) - log2(CAST(code[2:] AS INT)) + 1 AS INT) ELSE code END AS round, CASE WHEN x >= 3 AND y >= 3 THEN CASE WHEN x = y THEN '40-40' WHEN x > y THEN 'AD-40' ELSE '40-AD' END ELSE ['0', '15', '30', '40', NULL][x + 1] || '-' || ['0', '15', '30', '40'][y + 1] END AS game, (o_orderkey % 2 + (o_custkey % 13 + 1) // 2) % 2 AS server FROM d"),
    "stable_ids_sha256": (q_sha, "SELECT c_custkey, sha256(c_custkey || chr(31) || c_name || chr(31) || CASE WHEN c_custkey % 3 <> 0 THEN c_mktsegment ELSE 'None' END) AS id FROM customer"),
    "uuid5_ids": (q_uuid, None),
    "json_props_extract": (q_json, "WITH d AS (SELECT event_id, event_type, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events), c AS (SELECT *, '{\"event_id\":' || event_id || ',\"k\":' || k || ',\"type\":\"' || event_type || '\"}' AS canonical FROM d) SELECT event_id, k, canonical, sha256(canonical) AS sha256 FROM c"),
    "vector_dot": (q_dot, "WITH w AS (SELECT list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS w FROM embeddings WHERE vec_id = 0) SELECT vec_id, round(list_dot_product(list_transform(embedding, lambda x: CAST(x AS DOUBLE)), w), 6) AS dot FROM embeddings, w"),
    "pit_ks": (q_ks, "WITH d AS (SELECT event_type, (CAST(json_extract_string(props, '$.k') AS BIGINT) + 0.5) / 100 AS u FROM events), k AS (SELECT event_type, u, row_number() OVER (PARTITION BY event_type ORDER BY u) AS i, count(*) OVER (PARTITION BY event_type) AS n FROM d) SELECT event_type, max(n) AS n, round(CAST(max(greatest(i / CAST(n AS DOUBLE) - u, u - (i - 1) / CAST(n AS DOUBLE))) AS DOUBLE), 9) AS ks FROM k GROUP BY 1"),
}
