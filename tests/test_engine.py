"""Operators on small literal tables, kernels by other formulas, and the queries against their SQL."""

import math
import os
import uuid

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.functions import kernels
from tidemark.functions import scalar as S
from tidemark.operators import entity, folds, props, resample, selection, simulate, timeline
from tidemark.plans import registry

SF = "/root/testdata/sf0.001"


def test_cutoff_takes_whole_groups_only(spark):
    df = spark.createDataFrame([("a", 1), ("a", 1), ("b", 1), ("b", 2), ("c", None), ("c", 1), ("d", 5), (None, 1)], "g string, t int")
    kept, out = selection.select_before_cutoff(df, "g", "t", F.lit(5))
    assert sorted(str(r["g"]) for r in kept.collect()) == ["None", "a", "a"]
    assert {(r["g"], r["cutoff_code"]) for r in out.collect()} == {("b", "INCONSISTENT_MATCH_AVAILABILITY"), ("c", "UNKNOWN_AVAILABILITY"), ("d", "AT_OR_AFTER_INFORMATION_CUTOFF")}


def test_as_of_is_strict(spark):
    left = spark.createDataFrame([(1, 10), (1, 5), (2, 10)], "k int, t int")
    right = spark.createDataFrame([(1, 5, 1.0), (1, 10, 2.0), (1, 7, 3.0)], "k int, u int, v double")
    got = {(r["k"], r["t"]): r["asof_v"] for r in selection.as_of(left, right, ["k"], "t", "u", ["v"]).collect()}
    assert got == {(1, 10): 3.0, (1, 5): None, (2, 10): None}
    assert {(r["k"], r["t"]): r["asof_v"] for r in selection.as_of(left, right, ["k"], "t", "u", ["v"], strict=False).collect()}[(1, 10)] == 2.0


def test_equal_time_conflict(spark):
    df = spark.createDataFrame([("m", 1, "x"), ("m", 2, "y"), ("m", 2, "z"), ("n", 2, "y"), ("n", 2, "y"), ("o", 9, "q")], "k string, t int, v string")
    got = {r["k"]: (r["v"], r["conflict"]) for r in selection.latest_revision(df, "k", "t", ["v"], F.lit(5)).collect()}
    assert got == {"m": ("y", True), "n": ("y", False)}


def test_uuid5_and_names(spark):
    row = spark.createDataFrame([("Juan Martin del Potro",)], "n string").select(S.uuid5(uuid.NAMESPACE_URL, F.col("n")).alias("u"), entity.surname_keys(entity.tokens(F.col("n"))).alias("k")).head()
    assert row["u"] == str(uuid.uuid5(uuid.NAMESPACE_URL, "Juan Martin del Potro"))
    assert row["k"] == ["potro|j", "delpotro|j", "martindelpotro|j"]


def test_kernels():
    assert kernels.digamma(np.array([1.0, 0.5, 10.0])) == pytest.approx([-0.5772156649015329, -1.9635100260214235, 2.251752589066721], abs=1e-10)
    assert kernels.normal_quantile(0.975) == pytest.approx(1.959963984540054, abs=1e-12)
    assert np.exp(kernels.beta_binomial_logpmf(np.arange(11.0), 10.0, 0.3, 7.0)).sum() == pytest.approx(1)
    assert kernels.match_win(0.6, 0.6) == pytest.approx(0.5) and kernels.match_win(0.65, 0.6) + kernels.match_win(0.6, 0.65) == pytest.approx(1)
    scores, wins = kernels.set_outcomes(0.64, 0.61, 0)
    assert sum(scores.values()) == pytest.approx(1) and sum(wins.values()) == pytest.approx(sum(v for (a, b), v in scores.items() if a > b))
    low, high = kernels.confidence_sequence(30, 100)
    assert 0 < low < 0.3 < high < 1
    rng = np.random.default_rng(1)
    p = rng.uniform(0.05, 0.95, 4000)
    y = (rng.random(4000) < 1 / (1 + np.exp(-(0.3 + 0.8 * np.log(p / (1 - p)))))).astype(int)
    assert kernels.calibration(p, y) == pytest.approx((0.3, 0.8), abs=0.15)


def test_exact_and_simulated_match_agree(spark):
    serve = [(0.62, 0.12, 0.70, 0.08, 0.56), (0.60, 0.08, 0.68, 0.10, 0.53)]
    point = [f * (a + (1 - a) * q1) + (1 - f) * (1 - d) * q2 for f, a, q1, d, q2 in serve]
    paths = simulate.paths(spark, 3000, 7, serve, retire=0.0)
    share = paths.agg(F.avg((F.col("winner") == 0).cast("int"))).head()[0]
    assert abs(share - kernels.match_win(*point)) < 5 * math.sqrt(0.25 / 3000)


def test_paths_do_not_hang_on_partitions(spark):
    serve = [(0.62, 0.12, 0.70, 0.08, 0.56)] * 2
    key = lambda df: sorted((r["path"], r["winner"], str(r["sets"]), str(r["s0"])) for r in df.collect())
    whole = key(simulate.paths(spark, 40, 3, serve, parts=2))
    assert whole == key(simulate.paths(spark, 40, 3, serve, parts=7))
    assert whole[25:] == key(simulate.paths(spark, 15, 3, serve, start=25))


def test_props_round_trip_and_settlement(spark):
    p = props.Prop("AND", parts=(props.Prop("MATCH_WIN", 0), props.Prop("TOTAL_GAMES", operator=">", threshold=20)))
    assert props.from_record(p.record()) == p and props.from_record(p.record()).prop_id == p.prop_id
    rows = simulate.paths(spark, 50, 3, [(0.62, 0.12, 0.70, 0.08, 0.56)] * 2, retire=0.1).select("completed", "winner", props.settlement(props.Prop("MATCH_WIN", 0)).alias("w"), props.settlement(props.Prop("STRAIGHT_SETS", 0)).alias("s")).collect()
    for r in rows:
        assert r["w"] == ("YES" if r["winner"] == 0 else "NO") and (r["s"] == "VOID") == (not r["completed"])


def test_elo_by_hand(spark):
    m = spark.createDataFrame([("t", 1, 1, 1, 2, "H", 1), ("t", 2, 2, 1, 2, "H", 0), ("t", 2, 2, 1, 2, "H", 0)], "tour string, at long, match_id long, a long, b long, surface string, won int")
    got = folds.elo(m, [(32.0, 0.5)]).orderBy("at").collect()
    assert [(r["rating_a"], r["rating_b"]) for r in got] == [(1500.0, 1500.0), (1516.0, 1484.0)]


def test_layoffs_and_bootstrap(spark):
    day = timeline.DAY
    df = spark.createDataFrame([(1, 0), (1, 50 * day), (1, 51 * day), (1, 300 * day)], "p int, t long")
    got = [(r["island"], r["since_return"]) for r in timeline.layoff_islands(df, ["p"], "t", 42.0).orderBy("t").collect()]
    assert got == [(0, 0), (1, 1), (1, 2), (2, 1)]
    rows = spark.createDataFrame([("a", e, float(e % 3)) for e in range(30)] + [("b", 1, 2.0)], "g string, e int, v double")
    t = {r["g"]: r for r in resample.event_bootstrap(rows, "e", F.col("v"), ["g"]).collect()}
    assert t["a"]["low"] < t["a"]["mean"] < t["a"]["high"] and t["b"]["low"] is None


def test_components_and_roots(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (5, 6), (9, 9)], "a long, b long")
    assert {r["node"]: r["component"] for r in timeline.components(edges, "a", "b").collect()} == {1: 1, 2: 1, 3: 1, 5: 5, 6: 5, 9: 9}
    rows = spark.createDataFrame([(i, i - 1 if i else None) for i in range(20)], "id long, up long")
    assert {r["root"] for r in timeline.roots(rows, "id", "up").collect()} == {0}


def shown(v):
    if isinstance(v, float):
        return repr(round(v, 6) + 0.0)
    return str(v)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_against_sql(spark, name):
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{SF}/{f}'")
    df = registry.queries()[name](spark, SF)
    cursor = con.execute(registry.oracle_sql()[name])
    names = [d[0] for d in cursor.description]
    want = sorted([shown(dict(zip(names, r, strict=True))[c]) for c in sorted(names)] for r in cursor.fetchall())
    assert sorted(df.columns) == sorted(names)
    assert sorted([shown(r[c]) for c in sorted(names)] for r in df.collect()) == want


def test_entry_has_every_sql_and_runs(spark):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() > 0


def test_cutoff_assertion_cannot_be_pruned(spark):
    df = spark.createDataFrame([(1, 1), (2, 9)], "k int, t int")
    for run in (lambda d: d.count(), lambda d: d.select("k").collect()):
        with pytest.raises(Exception, match="not before the cutoff"):
            run(selection.assert_before(df, "t", F.lit(5)))
    assert selection.assert_before(df, "t", F.lit(10)).count() == 2


def test_chains_in_a_circle_are_an_error(spark):
    for links in ([(0, 3), (1, 0), (2, 1), (3, 2)], [(0, None), (1, 1)], [(0, 1), (1, 2), (2, 0), (5, None)]):
        with pytest.raises(ValueError):
            timeline.roots(spark.createDataFrame(links, "id long, up long"), "id", "up")


def test_bands_and_errors(spark):
    df = spark.createDataFrame([(None,), (0,), (90,), (91,), (180,), (181,), (365,), (366,)], "d int")
    assert [r[0] for r in df.select(S.inactivity_band(F.col("d"))).collect()] == ["COLD_START", "D_LE_90", "D_LE_90", "D_91_180", "D_91_180", "D_181_365", "D_181_365", "D_GT_365"]
    starts = spark.createDataFrame([(0.0,), (0.5,), (25.0,), (100.0,)], "s double")
    assert [r[0] for r in starts.select(S.history_band(F.col("s"))).collect()] == ["no_history", "sparse", "intermediate", "substantial"]
    for column in (S.inactivity_band(F.lit(-1)), S.history_band(F.lit(-1.0)), S.inactivity_factors(F.lit(-1))[0]):
        with pytest.raises(Exception, match="negative"):
            df.select(column).collect()


def test_crosswalk_by_several_name_keys(spark):
    a = spark.createDataFrame([(1, ["x|a", "yx|a"], "2024-01-01", "h"), (2, ["z|a"], "2024-01-01", "h"), (3, [], "2024-01-01", "h")], "sid long, keys array<string>, day string, kind string").withColumn("day", F.to_date("day"))
    b = spark.createDataFrame([(10, ["x|a", "yx|a"], "2024-01-02", "h"), (11, ["z|a"], "2024-01-02", "c")], "oid long, keys array<string>, day string, kind string").withColumn("day", F.to_date("day"))
    got = {r["sid"]: (r["status"], r["matched_id"]) for r in entity.crosswalk(a, b, ["keys"], "day", 3, 3, ["kind"], "sid", "oid").collect()}
    assert got == {1: ("MATCHED", 10), 2: ("STRUCTURAL_CONFLICT", None), 3: ("UNMATCHED", None)}
