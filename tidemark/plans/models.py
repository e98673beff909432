"""Queries over folds, simulation, predicates, resampling, fits and streams."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.operators import evaluate, fits, folds, props, resample, simulate
from tidemark.plans.evaluation import _F, forecasts, r
from tidemark.sources.tables import load
from tidemark.streaming import events as streams

#: Serve components of the two players of the simulated match.
SERVE = [(0.62, 0.12, 0.70, 0.08, 0.56), (0.60, 0.08, 0.68, 0.10, 0.53)]
PATHS = 4000
PROPS = {
    "match_win": props.Prop("MATCH_WIN", 0),
    "exact_2_0": props.Prop("EXACT_SCORE", 0, scope=(2, 0)),
    "straight_sets": props.Prop("STRAIGHT_SETS", 0),
    "wins_set": props.Prop("PLAYER_WINS_SET", 1),
    "deciding_set": props.Prop("DECIDING_SET"),
    "first_set": props.Prop("FIRST_SET_WIN", 0),
    "set_1_tiebreak": props.Prop("SET_TIEBREAK", scope=(1,)),
    "any_tiebreak": props.Prop("ANY_TIEBREAK"),
    "two_tiebreaks": props.Prop("TIEBREAK_COUNT", operator=">=", threshold=2),
    "lopsided": props.Prop("ANY_LOPSIDED_SET"),
    "set_1_6_4": props.Prop("SET_SCORE", scope=(1, 6, 4)),
    "first_set_games": props.Prop("FIRST_SET_GAMES", operator=">", threshold=9),
    "total_games": props.Prop("TOTAL_GAMES", operator=">", threshold=22),
    "player_games": props.Prop("PLAYER_GAMES", 0, ">=", 12),
    "handicap": props.Prop("GAME_HANDICAP", 1, threshold=3.5),
    "breaks": props.Prop("BREAK_COUNT", 0, ">=", 2),
    "total_breaks": props.Prop("TOTAL_BREAKS", operator=">=", threshold=4),
    "both_break": props.Prop("BOTH_BREAK"),
    "early_break": props.Prop("FIRST_BREAK_TIMING", operator="<", threshold=5),
    "aces": props.Prop("PLAYER_ACES", 0, ">=", 5),
    "total_aces": props.Prop("TOTAL_ACES", operator=">=", threshold=9),
    "more_aces": props.Prop("ACE_COMPARE", 0),
    "faults": props.Prop("PLAYER_DF", 1, ">=", 3),
    "total_faults": props.Prop("TOTAL_DF", operator=">=", threshold=6),
    "more_faults": props.Prop("DF_COMPARE", 1),
    "first_serve": props.Prop("FIRST_SERVE_WIN_PCT", 0, ">=", 72),
    "duration": props.Prop("DURATION_MIN", operator=">=", threshold=95),
    "winners": props.Prop("WINNERS", 0, ">=", 20),
    "errors": props.Prop("UNFORCED_ERRORS", 1, ">=", 18),
    "total_errors": props.Prop("TOTAL_UNFORCED_ERRORS", operator="<", threshold=35),
    "more_winners": props.Prop("WINNER_COMPARE", 0),
    "more_errors": props.Prop("UE_COMPARE", 1),
    "win_and_long": props.Prop("AND", parts=(props.Prop("MATCH_WIN", 0), props.Prop("TOTAL_GAMES", operator=">", threshold=22))),
    "tiebreak_or_break": props.Prop("OR", parts=(props.Prop("ANY_TIEBREAK"), props.Prop("BOTH_BREAK"))),
}


def matches(spark, sf):
    """Each event is a match of its user against the next event's user; the larger value wins."""
    e = load(spark, sf, "events")
    w = Window.partitionBy("event_type").orderBy("event_id")
    m = e.select("event_type", "event_id", F.unix_micros("ts").alias("at"), "user_id", "value", F.lead("user_id").over(w).alias("b"), F.lead("value").over(w).alias("v"), F.get_json_object("props", "$.k").cast("int").alias("k"))
    return m.filter("b IS NOT NULL AND b != user_id").select(F.col("event_type").alias("tour"), "at", F.col("event_id").alias("match_id"), F.col("user_id").alias("a"), "b", (F.col("k") % 3).cast("string").alias("surface"), (F.col("value") > F.col("v")).cast("int").alias("won"))


def q_elo(spark, sf):
    t = folds.elo(matches(spark, sf), [(24.0, 0.5), (32.0, 0.25)])
    return t.select("tour", "k", "blend", "match_id", r(F.col("rating_a"), 6).alias("rating_a"), r(F.col("rating_b"), 6).alias("rating_b"), r(F.col("p")).alias("p"))


def q_elo_weekly(spark, sf):
    """One pass serves every cutoff: the forecasts of a week hang only on what came before."""
    t = folds.elo(matches(spark, sf), [(24.0, 0.5), (32.0, 0.25)])
    week = F.floor((F.col("at") - 1704067200000000) / (7 * 86400000000)).cast("long")
    return t.groupBy("tour", "k", "blend", week.alias("week")).agg(F.count(F.lit(1)).alias("n"), r(F.avg(evaluate.brier(F.col("p"), F.col("won"))), 6).alias("brier"))


def q_bradley(spark, sf):
    t = folds.bradley_terry(matches(spark, sf), 30.0, 0.5)
    return t.groupBy("tour").agg(F.count(F.lit(1)).alias("n"), r(F.avg(evaluate.log_loss(F.col("p"), F.col("won"))), 6).alias("log_loss"), r(F.avg("variance"), 6).alias("variance"))


def q_points(spark, sf):
    c = load(spark, sf, "conversations")
    return folds.play(c.withColumn("w", F.when(F.col("role") == "user", 0).when(F.col("role") == "assistant", 1)), ["conv_id"], "turn", "w")


_POINTS = """WITH RECURSIVE q AS (SELECT conv_id, CASE WHEN role = 'user' THEN 0 ELSE 1 END AS w, row_number() OVER (PARTITION BY conv_id ORDER BY turn, CASE WHEN role = 'user' THEN 0 ELSE 1 END) AS i, count(*) OVER (PARTITION BY conv_id) AS m FROM conversations WHERE role IN ('user', 'assistant')),
s AS (SELECT conv_id, CAST(0 AS BIGINT) AS n, m, 0 AS pa, 0 AS pb, 0 AS ga, 0 AS gb, 0 AS sa, 0 AS sb FROM q WHERE i = 1
  UNION ALL SELECT conv_id, n, m, CASE WHEN g THEN 0 ELSE xa END, CASE WHEN g THEN 0 ELSE xb END, CASE WHEN o THEN 0 ELSE ya END, CASE WHEN o THEN 0 ELSE yb END, sa + CASE WHEN o AND ya > yb THEN 1 ELSE 0 END, sb + CASE WHEN o AND yb > ya THEN 1 ELSE 0 END FROM (
    SELECT *, greatest(ya, yb) >= 6 AND abs(ya - yb) >= 2 OR greatest(ya, yb) = 7 AS o FROM (
      SELECT *, ga + CASE WHEN g AND xa > xb THEN 1 ELSE 0 END AS ya, gb + CASE WHEN g AND xb > xa THEN 1 ELSE 0 END AS yb FROM (
        SELECT *, greatest(xa, xb) >= 4 AND abs(xa - xb) >= 2 AS g FROM (
          SELECT s.conv_id, s.n + 1 AS n, s.m, s.pa + CASE WHEN q.w = 0 THEN 1 ELSE 0 END AS xa, s.pb + CASE WHEN q.w = 1 THEN 1 ELSE 0 END AS xb, ga, gb, sa, sb FROM s JOIN q ON q.conv_id = s.conv_id AND q.i = s.n + 1)))))
SELECT conv_id, pa, pb, ga, gb, sa, sb, n FROM s WHERE n = m"""


def sample_paths(spark, n=PATHS):
    return simulate.paths(spark, n, 20260830, SERVE)


def q_simulate(spark, sf):
    p = sample_paths(spark)
    games = F.col("s0.games") + F.col("s1.games")
    return p.groupBy("winner").agg(F.count(F.lit(1)).alias("n"), r(F.avg(games), 6).alias("games"), r(F.avg("s0.aces"), 6).alias("aces"), F.percentile(games, F.array(F.lit(0.1), F.lit(0.5), F.lit(0.9))).alias("quantiles"), F.count_if(~F.col("completed")).alias("retired"))


def q_props(spark, sf):
    t = props.estimates(sample_paths(spark).withColumn("match", F.lit("m")), PROPS, ["match"])
    return t.select("prop", "yes", "no", "void", "unresolved", r(F.col("p")).alias("p"), r(F.col("se")).alias("se"))


def order_paths(spark, sf):
    """Paths from orders' numbers, so that SQL can follow them: two sets of made-up games, a third of some, and states of all kinds."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    made = lambda x, y: F.struct((6 - (x % 2) * (y % 5)).cast("int").alias("a"), (6 - ((x + 1) % 2) * (y % 5)).cast("int").alias("b"), (y % 5 == 0).alias("tiebreak"))
    stats = lambda x: F.struct((x % 20).cast("int").alias("games"), (x % 11).cast("int").alias("aces"), (x % 7).cast("int").alias("double_faults"), (x % 4).cast("int").alias("breaks"), (x % 40).cast("int").alias("first_in"), (x % 29).cast("int").alias("first_won"), (x % 30).cast("int").alias("winners"), F.when(x % 13 != 0, x % 25).cast("int").alias("errors"))
    sets = F.filter(F.array(made(k, c), made(c, k), F.when(k % 3 == 0, made(k + c, k))), lambda s: s.isNotNull())
    return load(spark, sf, "orders").select(
        k.alias("path"), (k % 2).cast("int").alias("winner"), (k % 50 == 7).alias("walkover"), (k % 50 != 9).alias("started"), (F.col("o_orderstatus") == "F").alias("completed"), F.lit(3).alias("best_of"), sets.alias("sets"), stats(k).alias("s0"), stats(c).alias("s1"),
        F.when(k % 5 != 0, k % 12).cast("int").alias("first_break"), F.array((90 + k % 10).cast("int"), (91 + k % 10).cast("int")).alias("durations"),
    )


CHECKED = {n: PROPS[n] for n in ("match_win", "deciding_set", "total_games", "aces", "more_faults", "first_serve", "duration", "total_errors", "more_errors", "early_break")} | {
    "win_and_duration": props.Prop("AND", parts=(PROPS["match_win"], PROPS["duration"])), "aces_or_duration": props.Prop("OR", parts=(PROPS["aces"], PROPS["duration"]))
}


def q_truth(spark, sf):
    return order_paths(spark, sf).select("path", *[props.truth(p).alias(n) for n, p in CHECKED.items()])


def q_states(spark, sf):
    t = order_paths(spark, sf).select(F.explode(F.array(*[F.struct(F.lit(n).alias("prop"), props.settlement(p).alias("state")) for n, p in CHECKED.items()])).alias("s")).select("s.*")
    return t.groupBy("prop", "state").agg(F.count(F.lit(1)).alias("n"))


_PATHS = """o AS (SELECT o_orderkey AS k, o_custkey AS c, o_orderstatus = 'F' AS completed, o_orderkey % 50 = 7 OR o_orderkey % 50 = 9 AS off FROM orders),
t AS (SELECT k, completed, off, k % 2 = 0 AS match_win, CASE WHEN k % 3 = 0 THEN 3 ELSE 2 END >= 3 AS deciding_set, k % 20 + c % 20 > 22 AS total_games, k % 11 >= 5 AS aces, c % 7 > k % 7 AS more_faults,
  CASE WHEN k % 40 <> 0 THEN 100.0 * (k % 29) / (k % 40) >= 72 END AS first_serve,
  CASE WHEN 90 + k % 10 >= 95 THEN true WHEN 91 + k % 10 < 95 THEN false END AS duration,
  coalesce(CASE WHEN k % 13 <> 0 THEN k % 25 END + CASE WHEN c % 13 <> 0 THEN c % 25 END < 35, false) AS total_errors,
  CASE WHEN c % 13 <> 0 THEN c % 25 END > CASE WHEN k % 13 <> 0 THEN k % 25 END AS more_errors, k % 5 <> 0 AND k % 12 < 5 AS early_break, k % 5 <> 0 AS has_break FROM o)"""
_STATE = "CASE WHEN off THEN 'VOID' WHEN {done} THEN CASE WHEN {x} THEN 'YES' WHEN NOT {x} THEN 'NO' ELSE 'UNRESOLVED' END {early} ELSE 'VOID' END"


def _state(name: str) -> str:
    if name == "match_win":
        return _STATE.format(done="true", x=name, early="")
    early = {"deciding_set": f"WHEN {name} THEN 'YES'", "total_games": f"WHEN {name} THEN 'YES'", "aces": f"WHEN {name} THEN 'YES'", "duration": "WHEN duration IS NULL THEN 'UNRESOLVED'", "early_break": "WHEN has_break THEN CASE WHEN early_break THEN 'YES' ELSE 'NO' END"}
    return _STATE.format(done="completed", x=name, early=early.get(name, ""))


def _states_sql() -> str:
    atoms = [n for n in CHECKED if n not in ("win_and_duration", "aces_or_duration")]
    cols = ", ".join(f"{_state(n)} AS s_{n}" for n in atoms)
    pair = "CASE WHEN {x} = 'YES' {op} {y} = 'YES' THEN 'YES' WHEN {x} = 'NO' {np} {y} = 'NO' THEN 'NO' WHEN {x} = 'UNRESOLVED' OR {y} = 'UNRESOLVED' THEN 'UNRESOLVED' ELSE 'VOID' END"
    both = pair.format(x="s_match_win", y="s_duration", op="AND", np="OR") + " AS s_win_and_duration, " + pair.format(x="s_aces", y="s_duration", op="OR", np="AND") + " AS s_aces_or_duration"
    union = " UNION ALL ".join(f"SELECT '{n}' AS prop, s_{n} AS state FROM v" for n in CHECKED)
    return f"WITH {_PATHS}, u AS (SELECT {cols} FROM t), v AS (SELECT *, {both} FROM u) SELECT prop, state, count(*) AS n FROM ({union}) GROUP BY 1, 2"


def q_bootstrap(spark, sf):
    f = forecasts(spark, sf)
    t = resample.event_bootstrap(f, "source", evaluate.brier(F.col("p"), F.col("y")), ["lang"])
    return t.select("lang", "n_events", *[r(F.col(c), 6).alias(c) for c in ("mean", "low", "high")])


def _ends(t, by):
    return t.select(*by, "n_events", *[r(F.col(c), 6).alias(c) for c in ("mean", "low", "high")])


def _paired(spark, sf):
    """The difference of two forecasts' scores on each document."""
    f = forecasts(spark, sf)
    return f.withColumn("delta", evaluate.brier(F.col("p") * 0.8 + 0.1, F.col("y")) - evaluate.brier(F.col("p"), F.col("y"))).withColumn("fold", F.col("doc_id") % 4)


def q_stratified(spark, sf):
    return _ends(resample.event_bootstrap(_paired(spark, sf), "source", F.col("delta"), [], 200, 7, ["lang", "fold"]), [])


def q_rows(spark, sf):
    """Whole rows are drawn: the key of a row is its event."""
    return _ends(resample.event_bootstrap(_paired(spark, sf).filter("lang = 'en'"), "doc_id", F.col("delta"), ["fold"], 100, 11), ["fold"])


def q_interval_99(spark, sf):
    e = load(spark, sf, "events").withColumn("day", F.date_format("ts", "yyyy-MM-dd")).withColumn("residual", F.col("value") - 20)
    return _ends(resample.event_bootstrap(e, "day", F.col("residual"), ["event_type"], 200, 13, low=0.005, high=0.995), ["event_type"])


def q_reliability_bootstrap(spark, sf):
    f = forecasts(spark, sf).withColumn("bin", evaluate.tenths(F.col("p")))
    return _ends(resample.event_bootstrap(f, "source", F.col("y"), ["bin"], 200, 17), ["bin"])


def q_pit(spark, sf):
    """Randomised places of binary outcomes in their forecasts, and how far they are from uniform."""
    f = forecasts(spark, sf).withColumn("u", resample.randomised_pit(F.when(F.col("y") == 1, 1 - F.col("p")).otherwise(0.0), F.when(F.col("y") == 1, F.col("p")).otherwise(1 - F.col("p")), "pit", F.col("doc_id")))
    return evaluate.ks_uniform(f, "u", ["lang"]).select("lang", "n", r(F.col("ks"), 6).alias("ks"))


def _durations(spark, sf):
    """Matches made from orders' lines: minutes hang on exposures, on both players' pace and on a residual made of the key."""
    li = load(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.sum("l_quantity").alias("points"), F.count(F.lit(1)).alias("games"), F.max("l_linenumber").alias("sets"), F.count_if(F.col("l_tax") == 0).alias("tiebreaks"), F.min("l_suppkey").alias("s"))
    m = li.filter("points >= 20").withColumn("a", F.col("l_orderkey") % 12).withColumn("b", (F.col("l_orderkey") % 12 + 1 + F.col("s") % 11) % 12)
    noise = (resample.uniform("a", F.col("l_orderkey")) + resample.uniform("b", F.col("l_orderkey")) + resample.uniform("c", F.col("l_orderkey")) - 1.5) * (1 + 0.4 * F.sqrt("points"))
    return m.withColumn("minutes", 4 + 0.55 * F.col("points") + 0.9 * F.col("games") + 2 * F.col("sets") + 1.5 * F.col("tiebreaks") + (F.col("a") + F.col("b") - 11) / 4 + noise).withColumn("tour", F.when(F.col("l_orderkey") % 2 == 0, "A").otherwise("B")).withColumn("w", F.lit(1.0))


def q_duration_fit(spark, sf):
    t = fits.duration(_durations(spark, sf), ["tour"], "minutes", ["points", "games", "sets", "tiebreaks"], "a", "b", "w")
    return t.select("tour", "n", *[r(F.col("beta")[i], 3).alias(c) for i, c in enumerate(["theta0", "per_point", "per_game", "per_set", "per_tiebreak"])], r(F.col("sigma0"), 2).alias("sigma0"), r(F.col("sigma1"), 2).alias("sigma1"))


#: What a fit gives for a match of 140 points, 22 games, 2 sets and no tiebreak: mode and spread.
DURATION_MEAN = [4.0, 0.55, 0.9, 2.0, 1.5, 1.0, -0.5, 0.7, -0.7, 1.8]
DURATION_SD = [1.0, 0.02, 0.05, 0.5, 0.5, 1.0, 1.0, 0.1, 0.1, 0.2]
EXPOSURE = [140.0, 22.0, 2.0, 0.0]


def duration_paths(spark, n: int):
    return simulate.durations(spark, n, 20260830, DURATION_MEAN, [[s * s if i == j else 0.0 for j in range(10)] for i, s in enumerate(DURATION_SD)], EXPOSURE)


def q_duration_paths(spark, sf):
    """Reads no table: the match and the posterior are given."""
    t = duration_paths(spark, 100_000)
    return t.agg(F.count(F.lit(1)).alias("n"), r(F.avg("latent"), 6).alias("mean"), r(F.stddev("latent"), 6).alias("sd"), r(F.avg((F.col("nearest") >= 105).cast("double")), 6).alias("over"), F.count_if(F.col("ceiling") < F.col("floor")).alias("n_wrong"))


def q_calibration_fit(spark, sf):
    t = fits.calibration(forecasts(spark, sf), "p", "y", ["lang"])
    return t.select("lang", "n", r(F.col("intercept"), 6).alias("intercept"), r(F.col("slope"), 6).alias("slope"))


def q_ridge(spark, sf):
    m = folds.elo(matches(spark, sf), [(24.0, 0.5)])
    x = m.withColumn("o", F.log(F.col("p") / (1 - F.col("p")))).withColumn("load", F.pmod(F.xxhash64("match_id"), F.lit(100)) / 100.0)
    return fits.ridge_weights(x, "o", ["load"], "won", ["tour"], 1.0).select("tour", "n", r(F.col("weights")[0], 6).alias("weight"))


def q_beta_binomial(spark, sf):
    from tidemark.operators import counts
    from tidemark.plans.ingest import KEYS, service

    c = counts.component_counts(service(spark, sf), KEYS).filter("eligible").withColumn("w", F.lit(1.0))
    t = fits.beta_binomial(c, "successes", "trials", "w", ["component"])
    return t.select("component", r(F.col("weight"), 2).alias("weight"), r(F.col("logit_mean"), 4).alias("logit_mean"), r(F.col("log_concentration"), 3).alias("log_concentration"))


def _stream(spark, sf):
    load(spark, sf, "events").limit(0)
    e = streams.read(spark, sf, "events")
    return e.withColumn("ts", F.col("ts").cast("timestamp"))


def _text(c):
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss")


def q_stream_windows(spark, sf):
    out = streams.run_once(streams.tumbling(_stream(spark, sf), "ts", "1 hour", ["event_type"]), "complete")
    return out.select(_text("start").alias("start"), "event_type", "n", F.round("value", 4).alias("value"))


def q_stream_sliding(spark, sf):
    out = streams.run_once(streams.sliding(_stream(spark, sf), "ts", "2 hours", "1 hour", ["event_type"]), "complete")
    return out.select(_text("start").alias("start"), "event_type", "n")


def q_stream_sessions(spark, sf):
    out = streams.run_once(streams.sessions(_stream(spark, sf), "ts", "2 hours", ["user_id"]), "complete")
    return out.select("user_id", _text("start").alias("start"), "n")


def q_stream_first(spark, sf):
    e = _stream(spark, sf).select("user_id", "event_type").dropDuplicates(["user_id", "event_type"])
    return streams.run_once(e, "append")


#: The folds as recursive SQL: a step takes the next match of each tour and hands on the state as a map.
_MATCHES = """e AS (SELECT event_type AS tour, event_id, epoch_us(ts) AS micros, user_id AS a, value, lead(user_id) OVER w AS b, lead(value) OVER w AS v, CAST(json_extract_string(props, '$.k') AS INT) % 3 AS s FROM events WINDOW w AS (PARTITION BY event_type ORDER BY event_id)),
m AS MATERIALIZED (SELECT tour, micros, event_id AS match_id, a, b, s, CAST(value > v AS INT) AS won, row_number() OVER (PARTITION BY tour ORDER BY micros, event_id) AS i FROM e WHERE b IS NOT NULL AND b <> a)"""
_ELO = f"""WITH RECURSIVE {_MATCHES}, g(k, blend) AS (VALUES (24.0::DOUBLE, 0.5::DOUBLE), (32.0, 0.25)),
f AS (SELECT DISTINCT tour, k, blend, CAST(0 AS BIGINT) AS i, MAP {{CAST(-1 AS BIGINT): 1500.0::DOUBLE}} AS st, CAST(NULL AS BIGINT) AS match_id, CAST(NULL AS BIGINT) AS micros, 0.0::DOUBLE AS ra, 0.0::DOUBLE AS rb, 0.0::DOUBLE AS p, 0 AS won FROM m, g
  UNION ALL SELECT tour, k, blend, i, map_concat(st, MAP {{a * 4: ga + ch, a * 4 + 1 + s: sa + ch, b * 4: gb - ch, b * 4 + 1 + s: sb - ch}}), match_id, micros, ra, rb, p, won FROM (
    SELECT *, k * (won - p) AS ch FROM (SELECT *, 1 / (1 + pow(10, (rb - ra) / 400)) AS p FROM (
      SELECT *, (1 - blend) * ga + blend * sa AS ra, (1 - blend) * gb + blend * sb AS rb FROM (
        SELECT f.tour, f.k, f.blend, m.i, f.st, m.match_id, m.micros, m.a, m.b, m.s, m.won, coalesce(map_extract_value(st, a * 4), 1500.0) AS ga, coalesce(map_extract_value(st, a * 4 + 1 + s), 1500.0) AS sa, coalesce(map_extract_value(st, b * 4), 1500.0) AS gb, coalesce(map_extract_value(st, b * 4 + 1 + s), 1500.0) AS sb
        FROM f JOIN m ON m.tour = f.tour AND m.i = f.i + 1)))))"""
_BRADLEY = f"""WITH RECURSIVE {_MATCHES},
f AS (SELECT DISTINCT tour, CAST(0 AS BIGINT) AS i, MAP {{CAST(-1 AS BIGINT): {{'m': 0.0::DOUBLE, 'v': 0.0::DOUBLE, 't': CAST(0 AS BIGINT)}}}} AS st, 0.0::DOUBLE AS p, 0.0::DOUBLE AS variance, 0 AS won FROM m
  UNION ALL SELECT tour, i, map_concat(st, MAP {{a: {{'m': ma + va * (won - q) / (1 + va * q * (1 - q)), 'v': va / (1 + va * q * (1 - q)), 't': micros}}, b: {{'m': mb - vb * (won - q) / (1 + vb * q * (1 - q)), 'v': vb / (1 + vb * q * (1 - q)), 't': micros}}}}), p, va + vb, won FROM (
    SELECT *, 1 / (1 + exp(-(ma - mb) / sqrt(1 + pi() * (va + vb) / 8))) AS p, 1 / (1 + exp(-(ma - mb))) AS q FROM (
      SELECT *, coalesce(x.m, 0) * ka AS ma, coalesce(y.m, 0) * kb AS mb, 0.5 + (coalesce(x.v, 0.5) - 0.5) * ka * ka AS va, 0.5 + (coalesce(y.v, 0.5) - 0.5) * kb * kb AS vb FROM (
        SELECT *, pow(2.0, -(micros - coalesce(x.t, micros)) / 86400e6 / 30.0) AS ka, pow(2.0, -(micros - coalesce(y.t, micros)) / 86400e6 / 30.0) AS kb FROM (
          SELECT f.tour, m.i, f.st, m.a, m.b, m.won, m.micros, map_extract_value(st, a) AS x, map_extract_value(st, b) AS y FROM f JOIN m ON m.tour = f.tour AND m.i = f.i + 1)))))"""
_DELTA = "(p * 0.8 + 0.1 - y) * (p * 0.8 + 0.1 - y) - (p - y) * (p - y)"


def _boot(by: str | None, strata: list[str], replicates: int, seed: int, low: float = 0.025, high: float = 0.975) -> str:
    """The bootstrap of x (by, strata, event, v), drawn by the same md5."""
    within = [*([by] if by else []), *strata]
    keys, same = ", ".join(within), " AND ".join(f"d.{c} = e.{c}" for c in within)
    lead, group = (f"{by}, ", f"GROUP BY {by}") if by else ("", "")
    return (
        f"e AS (SELECT {keys}, sum(v) AS s, count(v) AS n, row_number() OVER (PARTITION BY {keys} ORDER BY event) - 1 AS i, count(*) OVER (PARTITION BY {keys}) AS m FROM x GROUP BY {keys}, event), "
        f"d AS (SELECT {keys}, r, ('0x' || left(md5(concat_ws('|', {seed}, r, i, {keys})), 13))::BIGINT % m AS pick FROM e, range(1, {replicates + 1}) t(r)), "
        f"b AS (SELECT {''.join(f'd.{c}, ' for c in ([by] if by else []))}r, sum(s) / sum(n) AS v FROM d JOIN e ON {same} AND e.i = d.pick GROUP BY {''.join(f'd.{c}, ' for c in ([by] if by else []))}r), "
        f"q AS (SELECT {lead}quantile_cont(v, {low}) AS low, quantile_cont(v, {high}) AS high FROM b {group}), "
        f"t AS (SELECT {lead}count(*) AS n_events, sum(s) / sum(n) AS mean FROM e {group}) "
        f"SELECT {lead}n_events, round(mean, 6) AS mean, round(CASE WHEN n_events >= 2 THEN low END, 6) AS low, round(CASE WHEN n_events >= 2 THEN high END, 6) AS high FROM t {f'JOIN q USING ({by})' if by else ', q'}"
    )


QUERIES = {
    "elo_fold": (q_elo, f"{_ELO} SELECT tour, k, blend, match_id, round(ra, 6) AS rating_a, round(rb, 6) AS rating_b, round(p, 9) AS p FROM f WHERE match_id IS NOT NULL"),
    "elo_weekly_emission": (q_elo_weekly, f"{_ELO} SELECT tour, k, blend, CAST(floor((micros - 1704067200000000) / (7 * 86400000000.0)) AS BIGINT) AS week, count(*) AS n, round(avg((p - won) * (p - won)), 6) AS brier FROM f WHERE match_id IS NOT NULL GROUP BY 1, 2, 3, 4"),
    "bradley_terry_filter": (q_bradley, f"{_BRADLEY} SELECT tour, count(*) AS n, round(avg(-CASE WHEN won = 1 THEN ln(p) ELSE ln(1 - p) END), 6) AS log_loss, round(avg(variance), 6) AS variance FROM f WHERE i > 0 GROUP BY 1"),
    "point_stream_fold": (q_points, _POINTS),
    "simulate_paths_summary": (q_simulate, None),
    "prop_estimates": (q_props, None),
    "prop_truth_matrix": (q_truth, f"WITH {_PATHS} SELECT k AS path, {', '.join(n for n in CHECKED if n not in ('win_and_duration', 'aces_or_duration'))}, match_win AND duration AS win_and_duration, aces OR duration AS aces_or_duration FROM t"),
    "settlement_states": (q_states, _states_sql()),
    "event_block_bootstrap": (q_bootstrap, f"WITH {_F}, x AS (SELECT lang, source AS event, (p - y) * (p - y) AS v FROM f), {_boot('lang', [], 200, 0)}"),
    "stratified_block_bootstrap": (q_stratified, f"WITH {_F}, x AS (SELECT lang, doc_id % 4 AS fold, source AS event, {_DELTA} AS v FROM f), {_boot(None, ['lang', 'fold'], 200, 7)}"),
    "row_bootstrap": (q_rows, f"WITH {_F}, x AS (SELECT doc_id % 4 AS fold, doc_id AS event, {_DELTA} AS v FROM f WHERE lang = 'en'), {_boot('fold', [], 100, 11)}"),
    "event_block_interval_99": (q_interval_99, f"WITH x AS (SELECT event_type, strftime(ts, '%Y-%m-%d') AS event, value - 20 AS v FROM events), {_boot('event_type', [], 200, 13, 0.005, 0.995)}"),
    "reliability_bootstrap": (q_reliability_bootstrap, f"WITH {_F}, x AS (SELECT CAST(least(floor(p * 10), 9) AS INT) AS bin, source AS event, y AS v FROM f), {_boot('bin', [], 200, 17)}"),
    "randomised_pit": (q_pit, f"WITH {_F}, u AS (SELECT lang, CASE WHEN y = 1 THEN 1 - p ELSE 0.0 END + ((('0x' || left(md5(concat_ws('|', 'pit', doc_id)), 13))::BIGINT % 4503599627370496 + 0.5) / 4503599627370496) * CASE WHEN y = 1 THEN p ELSE 1 - p END AS u FROM f), k AS (SELECT lang, u, row_number() OVER (PARTITION BY lang ORDER BY u) AS i, count(*) OVER (PARTITION BY lang) AS n FROM u) SELECT lang, max(n) AS n, round(max(greatest(CAST(i AS DOUBLE) / n - u, u - CAST(i - 1 AS DOUBLE) / n)), 6) AS ks FROM k GROUP BY 1"),
    "duration_fit": (q_duration_fit, None),
    "duration_paths": (q_duration_paths, None),
    "calibration_regression": (q_calibration_fit, None),
    "ridge_offset_fit": (q_ridge, None),
    "beta_binomial_map": (q_beta_binomial, None),
    "stream_window_counts": (q_stream_windows, "SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS start, event_type, count(*) AS n, round(sum(value), 4) AS value FROM events GROUP BY 1, 2"),
    "stream_sliding_counts": (q_stream_sliding, "SELECT strftime(date_trunc('hour', ts) - to_hours(CAST(i AS INT)), '%Y-%m-%d %H:%M:%S') AS start, event_type, count(*) AS n FROM events, range(2) t(i) GROUP BY 1, 2"),
    "stream_sessions": (q_stream_sessions, "WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 2 HOURS THEN 0 ELSE 1 END AS f FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT *, sum(f) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS i FROM g) SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS start, count(*) AS n FROM s GROUP BY user_id, i"),
    "stream_dedup": (q_stream_first, "SELECT DISTINCT user_id, event_type FROM events"),
}
