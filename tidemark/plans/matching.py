"""Queries over checked joins, directories, versions and sets."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import text as T
from tidemark.operators import counts, matching
from tidemark.plans.ingest import _COUNTS, KEYS, service
from tidemark.sources.tables import load


def r(column, digits=6):
    return F.round(column, digits)


def q_attach(spark, sf):
    o = load(spark, sf, "orders").select("o_orderkey", "o_custkey")
    dates = load(spark, sf, "orders").select("o_orderkey", F.date_add(F.col("o_orderdate").cast("date"), (F.col("o_orderkey") % 7).cast("int")).cast("string").alias("exact"))
    return matching.attach(o, dates, "o_orderkey", ["exact"])


def q_component_pairs(spark, sf):
    c = counts.component_counts(service(spark, sf), KEYS)
    p = matching.paired(c.withColumn("kind", F.when((F.col("component") == "Q2") & (F.col("l_orderkey") % 9 == 0), "other").otherwise("row")), KEYS, "component", "Q1", "Q2", "successes", ["kind"])
    return p.groupBy("l_linenumber").agg(F.count(F.lit(1)).alias("n"), F.sum("left_value").alias("q1"), F.sum("right_value").alias("q2"))


def _locks(spark, sf):
    p = load(spark, sf, "part")
    old = p.filter("p_partkey % 10 <> 3").select("p_partkey", "p_brand", "p_size", r(F.col("p_retailprice")).alias("p"))
    size = F.when(F.col("p_partkey") % 8 == 0, None).otherwise(F.col("p_size"))
    new = p.filter("p_partkey % 10 <> 4").select("p_partkey", F.when(F.col("p_partkey") % 6 == 0, "Brand#X").otherwise(F.col("p_brand")).alias("p_brand"), size.alias("p_size"), r(F.col("p_retailprice") * (1 + F.col("p_partkey") % 3)).alias("p"))
    return old, new


_LOCKS = "o AS (SELECT p_partkey, p_brand, p_size, round(p_retailprice, 6) AS p FROM part WHERE p_partkey % 10 <> 3), n AS (SELECT p_partkey, CASE WHEN p_partkey % 6 = 0 THEN 'Brand#X' ELSE p_brand END AS p_brand, CASE WHEN p_partkey % 8 = 0 THEN NULL ELSE p_size END AS p_size, round(p_retailprice * (1 + p_partkey % 3), 6) AS p FROM part WHERE p_partkey % 10 <> 4)"


def q_lock_diff(spark, sf):
    return matching.changed_fields(*_locks(spark, sf), "p_partkey", ["p_brand", "p_size"])


def q_lock_deltas(spark, sf):
    return matching.deltas(*_locks(spark, sf), "p_partkey", "p").select("p_partkey", "old", "new", r(F.col("delta")).alias("delta"))


def _batches(spark, sf):
    li = load(spark, sf, "lineitem")
    count = lambda d: d.groupBy("l_linenumber").agg(F.count_if(F.col("l_returnflag") == "R").alias("yes"), F.count(F.lit(1)).alias("settled"))
    return [count(li.filter(F.col("l_orderkey") % 3 == i)) for i in range(3)]


def q_batches(spark, sf):
    t = matching.added_counts(_batches(spark, sf), "l_linenumber", "yes", "settled")
    return t.select("l_linenumber", "yes", "settled", r(F.col("p"), 9).alias("p"), r(F.col("se"), 9).alias("se"))


def q_lookup(spark, sf):
    li = load(spark, sf, "lineitem").filter("l_suppkey <> l_partkey").select("l_orderkey", "l_linenumber", "l_suppkey", "l_partkey")
    prior = load(spark, sf, "lineitem").filter("l_shipdate < TIMESTAMP '1997-01-01 00:00:00'").groupBy(F.col("l_suppkey").alias("player")).agg(F.count(F.lit(1)).alias("n"))
    got = matching.looked_up(li, prior, ["l_suppkey", "l_partkey"], "player", "n", 0)
    sparsity = F.exp(-F.least("l_suppkey_n", "l_partkey_n") / 25)
    return got.groupBy("l_linenumber").agg(F.count(F.lit(1)).alias("n"), r(F.avg(sparsity)).alias("sparsity"), F.sum("l_partkey_n").cast("long").alias("opponents"))


def q_wide(spark, sf):
    li = load(spark, sf, "lineitem")
    meta = load(spark, sf, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.when(F.col("o_orderkey") % 5 == 0, None).otherwise(F.col("o_orderpriority")).alias("event"))
    w = matching.complete_wide(li, ["l_orderkey"], "l_returnflag", ["A", "N", "R"], "l_quantity", meta)
    return w.groupBy("event").agg(F.count(F.lit(1)).alias("n"), r(F.avg(F.col("A") - F.col("R"))).alias("delta"))


def q_directory(spark, sf):
    o = load(spark, sf, "orders").withColumn("name", F.concat(F.lit("Player "), (F.col("o_custkey") % 300).cast("string")))
    known = matching.directory(o, ["o_orderpriority", "name"], "o_custkey", [F.col("o_orderdate")])
    wanted = load(spark, sf, "customer").select("c_custkey", F.lit("5-LOW").alias("o_orderpriority"), F.concat(F.lit("Player "), (F.col("c_custkey") % 400).cast("string")).alias("name"))
    return matching.resolved(wanted, known, ["o_orderpriority", "name"], "name").select("c_custkey", "found_id", "seen")


def q_resolve_or_insert(spark, sf):
    s = load(spark, sf, "supplier").select((F.col("s_suppkey") % 60).alias("player"), F.col("s_nationkey").alias("matches"), r(F.col("s_acctbal")).alias("rating"), "s_suppkey")
    wanted = load(spark, sf, "customer").select((F.col("c_custkey") % 90).alias("player"))
    return matching.resolve_or_insert(s, wanted, ["player"], ["matches", "s_suppkey"], {"rating": 1500.0, "matches": 0}).select("player", F.col("matches").cast("long").alias("matches"), "rating", "inserted")


def q_alias(spark, sf):
    known = load(spark, sf, "supplier").select(F.col("s_suppkey").cast("string").alias("id"), F.array(F.col("s_name"), F.concat(F.lit("S "), (F.col("s_suppkey") % 70).cast("string"))).alias("aliases"))
    k = F.col("c_custkey")
    wanted = load(spark, sf, "customer").select("c_custkey", F.when(k % 3 == 0, k.cast("string")).when(k % 3 == 1, F.concat(F.lit("s-"), (k % 100).cast("string"))).otherwise(F.concat(F.lit("SUPPLIER "), F.right("c_name", F.lit(9)))).alias("name"))
    return matching.by_alias(wanted, known, "name", "id", "aliases", T.joined_name).select("c_custkey", "resolved_id")


def q_latest_ready(spark, sf):
    o = load(spark, sf, "orders").withColumn("status", F.when(F.col("o_orderstatus") == "F", "READY").otherwise("BUILDING"))
    rejected = load(spark, sf, "lineitem").filter("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    got = matching.latest_ready(o, rejected, ["o_orderpriority"], "o_orderkey", "o_orderdate", "status")
    return got.select("o_orderpriority", "o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"))


def q_only_one(spark, sf):
    li = load(spark, sf, "lineitem").filter("l_quantity = 50 AND l_linenumber = 1")
    alone = li.groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n")).filter("n = 1")
    return matching.only_one(li.join(alone, "l_orderkey", "left_semi"), ["l_orderkey"], F.col("l_quantity") == 50).select("l_orderkey", "l_suppkey")


def q_versions(spark, sf):
    """For each order the last build of its priority whose data end before the order."""
    o = load(spark, sf, "orders")
    v = o.filter("o_orderkey % 50 = 0").select("o_orderpriority", F.col("o_orderdate").alias("data_end"), F.col("o_orderkey").alias("version"))
    got = matching.version_as_of(v, o.select("o_orderkey", "o_orderpriority", "o_orderdate"), ["o_orderpriority"], "o_orderdate", "data_end", "version")
    return got.select("o_orderkey", F.col("asof_version").alias("version"), F.col("asof_version").isNull().alias("static_fit"))


def q_both_sides(spark, sf):
    li = load(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity")
    parts = [li.filter("l_linenumber <= 2"), li.filter("l_linenumber > 2").withColumn("source", F.lit("current"))]
    return matching.with_both_sides(parts, "l_orderkey").groupBy(F.coalesce("source", F.lit("historical")).alias("source")).agg(F.count(F.lit(1)).alias("n"), r(F.sum("l_quantity")).alias("points"))


def q_set_equality(spark, sf):
    d, lab = load(spark, sf, "documents"), load(spark, sf, "labels")
    return matching.same_sets(d, lab, "doc_id")


def q_distinct(spark, sf):
    return load(spark, sf, "orders").select("o_orderpriority", (F.col("o_custkey") % 500).alias("player"), T.joined_name(F.concat(F.lit("Pläyer "), (F.col("o_custkey") % 500).cast("string"))).alias("name")).distinct()


def q_extended(spark, sf):
    state = load(spark, sf, "supplier").select(F.col("s_suppkey").alias("player"), r(F.col("s_acctbal")).alias("mean"), F.lit(2.0).alias("precision"))
    rows = load(spark, sf, "lineitem").select(F.col("l_partkey").alias("player"))
    return matching.extended_state(state, rows, "player", {"mean": 0.0, "precision": 0.5})


def q_set_hash(spark, sf):
    return matching.set_hash(load(spark, sf, "lineitem").withColumn("member", F.col("l_suppkey") % 40), ["l_returnflag", "l_linestatus"], "member")


QUERIES = {
    "attach_exact_dates": (q_attach, "SELECT o_orderkey, o_custkey, CAST(CAST(o_orderdate AS DATE) + CAST(o_orderkey % 7 AS INT) AS VARCHAR) AS exact FROM orders"),
    "component_pairs": (q_component_pairs, f"WITH {_COUNTS}, p AS (SELECT l_orderkey, l_linenumber, l_suppkey, l_shipdate, count(*) FILTER (component = 'Q1') AS n1, max(CASE WHEN component = 'Q1' THEN successes END) AS q1, max(CASE WHEN component = 'Q2' THEN successes END) AS q2 FROM c WHERE component IN ('Q1', 'Q2') GROUP BY 1, 2, 3, 4) SELECT l_linenumber, count(*) AS n, CAST(sum(q1) AS BIGINT) AS q1, CAST(sum(q2) AS BIGINT) AS q2 FROM p WHERE n1 = 1 AND l_orderkey % 9 <> 0 GROUP BY 1"),
    "lock_field_changes": (q_lock_diff, f"WITH {_LOCKS} SELECT p_partkey, 'row' AS field, 'removed' AS old, NULL AS new FROM o WHERE p_partkey NOT IN (SELECT p_partkey FROM n) UNION ALL SELECT p_partkey, 'row', NULL, 'added' FROM n WHERE p_partkey NOT IN (SELECT p_partkey FROM o) UNION ALL SELECT o.p_partkey, 'p_brand', o.p_brand, n.p_brand FROM o JOIN n USING (p_partkey) WHERE o.p_brand IS DISTINCT FROM n.p_brand UNION ALL SELECT o.p_partkey, 'p_size', CAST(o.p_size AS VARCHAR), CAST(n.p_size AS VARCHAR) FROM o JOIN n USING (p_partkey) WHERE o.p_size IS DISTINCT FROM n.p_size"),
    "lock_probability_deltas": (q_lock_deltas, f"WITH {_LOCKS} SELECT p_partkey, o.p AS old, n.p AS new, round(n.p - o.p, 6) AS delta FROM o JOIN n USING (p_partkey)"),
    "batch_count_sum": (q_batches, "SELECT l_linenumber, count(*) FILTER (l_returnflag = 'R') AS yes, count(*) AS settled, round(avg((l_returnflag = 'R')::INT), 9) AS p, round(sqrt(avg((l_returnflag = 'R')::INT) * (1 - avg((l_returnflag = 'R')::INT)) / count(*)), 9) AS se FROM lineitem GROUP BY 1"),
    "dimension_lookup": (q_lookup, "WITH p AS (SELECT l_suppkey AS player, count(*) AS n FROM lineitem WHERE l_shipdate < TIMESTAMP '1997-01-01 00:00:00' GROUP BY 1), j AS (SELECT l_linenumber, coalesce(a.n, 0) AS x, coalesce(b.n, 0) AS y FROM lineitem LEFT JOIN p a ON a.player = l_suppkey LEFT JOIN p b ON b.player = l_partkey WHERE l_suppkey <> l_partkey) SELECT l_linenumber, count(*) AS n, round(avg(exp(-least(x, y) / 25.0)), 6) AS sparsity, CAST(sum(y) AS BIGINT) AS opponents FROM j GROUP BY 1"),
    "complete_wide": (q_wide, "WITH w AS (SELECT l_orderkey, max(CASE WHEN l_returnflag = 'A' THEN l_quantity END) AS a, max(CASE WHEN l_returnflag = 'N' THEN l_quantity END) AS n, max(CASE WHEN l_returnflag = 'R' THEN l_quantity END) AS r FROM lineitem GROUP BY 1) SELECT o_orderpriority AS event, count(*) AS n, round(avg(a - r), 6) AS delta FROM w JOIN orders ON o_orderkey = l_orderkey WHERE o_orderkey % 5 <> 0 AND a IS NOT NULL AND w.n IS NOT NULL AND r IS NOT NULL GROUP BY 1"),
    "player_directory": (q_directory, "WITH k AS (SELECT 'Player ' || (o_custkey % 300) AS name, arg_max(o_custkey, (o_orderdate, o_custkey)) AS id FROM orders WHERE o_orderpriority = '5-LOW' GROUP BY 1) SELECT c_custkey, coalesce(CAST(id AS VARCHAR), 'UNSEEN-player-' || (c_custkey % 400)) AS found_id, id IS NOT NULL AS seen FROM customer LEFT JOIN k ON name = 'Player ' || (c_custkey % 400)"),
    "resolve_or_insert": (q_resolve_or_insert, "WITH b AS (SELECT s_suppkey % 60 AS player, CAST(s_nationkey AS BIGINT) AS matches, round(s_acctbal, 6) AS rating FROM supplier QUALIFY row_number() OVER (PARTITION BY s_suppkey % 60 ORDER BY s_nationkey DESC, s_suppkey DESC) = 1) SELECT *, false AS inserted FROM b UNION ALL SELECT DISTINCT c_custkey % 90, CAST(0 AS BIGINT), 1500.0, true FROM customer WHERE c_custkey % 90 NOT IN (SELECT player FROM b)"),
    "alias_resolution": (q_alias, "WITH s AS (SELECT s_suppkey, regexp_replace(lower(s_name), '[^a-z0-9]+', '', 'g') AS a FROM supplier UNION ALL SELECT s_suppkey, 's' || (s_suppkey % 70) FROM supplier), u AS (SELECT a, CAST(min(s_suppkey) AS VARCHAR) AS id FROM s GROUP BY 1 HAVING count(DISTINCT s_suppkey) = 1), w AS (SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN CAST(c_custkey AS VARCHAR) WHEN 1 THEN 's' || (c_custkey % 100) ELSE 'supplier' || right(c_name, 9) END AS k FROM customer) SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 AND EXISTS (SELECT 1 FROM supplier WHERE s_suppkey = c_custkey) THEN CAST(c_custkey AS VARCHAR) ELSE id END AS resolved_id FROM w LEFT JOIN u ON a = k"),
    "latest_ready_build": (q_latest_ready, "SELECT o_orderpriority, max((o_orderdate, o_orderkey))[2] AS o_orderkey, strftime(max(o_orderdate), '%Y-%m-%d') AS day FROM orders WHERE o_orderstatus = 'F' AND o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R') GROUP BY 1"),
    "only_one_match": (q_only_one, "SELECT l_orderkey, min(l_suppkey) AS l_suppkey FROM lineitem WHERE l_quantity = 50 AND l_linenumber = 1 GROUP BY 1 HAVING count(*) = 1"),
    "version_as_of": (q_versions, "SELECT o.o_orderkey, arg_max(v.o_orderkey, (v.o_orderdate, v.o_orderkey)) AS version, count(v.o_orderkey) = 0 AS static_fit FROM orders o LEFT JOIN orders v ON v.o_orderkey % 50 = 0 AND v.o_orderpriority = o.o_orderpriority AND v.o_orderdate < o.o_orderdate GROUP BY 1"),
    "both_sides_union": (q_both_sides, "SELECT CASE WHEN l_linenumber <= 2 THEN 'historical' ELSE 'current' END AS source, count(*) AS n, round(sum(l_quantity), 6) AS points FROM lineitem WHERE l_orderkey IN (SELECT l_orderkey FROM lineitem GROUP BY 1 HAVING count(*) = 2) GROUP BY 1"),
    "set_equality": (q_set_equality, "SELECT count(*) FILTER (d.doc_id IS NOT NULL AND l.doc_id IS NOT NULL) AS n_both, count(*) FILTER (l.doc_id IS NULL) AS n_first, count(*) FILTER (d.doc_id IS NULL) AS n_second, count(*) FILTER (d.doc_id IS NULL OR l.doc_id IS NULL) = 0 AS equal FROM (SELECT DISTINCT doc_id FROM documents) d FULL JOIN (SELECT DISTINCT doc_id FROM labels) l ON d.doc_id = l.doc_id"),
    "distinct_players": (q_distinct, "SELECT DISTINCT o_orderpriority, o_custkey % 500 AS player, 'player' || (o_custkey % 500) AS name FROM orders"),
    "extended_state": (q_extended, "SELECT s_suppkey AS player, round(s_acctbal, 6) AS mean, 2.0 AS precision, false AS is_new FROM supplier UNION ALL SELECT DISTINCT l_partkey, 0.0, 0.5, true FROM lineitem WHERE l_partkey NOT IN (SELECT s_suppkey FROM supplier)"),
    "source_set_hash": (q_set_hash, "SELECT l_returnflag, l_linestatus, count(DISTINCT l_suppkey % 40) AS n, sha256('[' || string_agg(DISTINCT '\"' || (l_suppkey % 40) || '\"', ',' ORDER BY '\"' || (l_suppkey % 40) || '\"') || ']') AS set_sha256 FROM lineitem GROUP BY 1, 2"),
}
