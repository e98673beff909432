"""The append-only ledger, locks, fits against what made the data, and text functions by hand."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.functions import kernels
from tidemark.functions import text as T
from tidemark.operators import fits, intake, journal, matching, reports, simulate
from tidemark.plans.intake import SCORES


def test_ledger_appends_verifies_and_corrects(spark, tmp_path):
    path = str(tmp_path / "ledger")
    kind = "row_id string, correction_of string, available_at string, row_json string"
    row = lambda *rows: spark.createDataFrame([(i, c, t, f'{{"prop_id":"{p}","v":{v}}}') for i, c, t, p, v in rows], kind).withColumn("available_at", F.to_timestamp("available_at"))
    journal.append(spark, path, row(("a", None, "2024-01-01", "p", 1), ("b", None, "2024-01-01", "q", 2)))
    last = journal.append(spark, path, row(("c", "a", "2024-01-05", "p", 3)))
    for bad in [("a", None, "2024-01-06", "p", 1)], [("d", "zz", "2024-01-06", "p", 1)], [("d", "a", "2024-01-06", "q", 1)], [("e", None, "2024-01-06", "p", 1), ("e", None, "2024-01-06", "p", 2)]:
        with pytest.raises(ValueError):
            journal.append(spark, path, row(*bad))
    ledger = journal.read(spark, path)
    seen = journal.verified(ledger).head()
    assert (seen["n"], seen["n_corrections"], seen["n_broken"], seen["terminal_sha256"]) == (3, 1, 0, last)
    broken = journal.verified(ledger.withColumn("row_json", F.when(F.col("row_id") == "b", "{}").otherwise(F.col("row_json")))).head()
    assert (broken["n_broken"], broken["first_broken"]) == (1, 2)
    at = lambda day: {r["row_id"] for r in journal.effective_at(ledger, F.to_timestamp(F.lit(day))).collect()}
    assert at("2024-01-05") == {"a", "b"} and at("2024-01-06") == {"b", "c"} and at("2024-01-01") == set()
    journal.append(spark, path, row(("f", "a", "2024-01-05", "p", 4)))
    with pytest.raises(Exception, match="at one time"):
        journal.effective_at(journal.read(spark, path), F.to_timestamp(F.lit("2024-02-01"))).collect()


def test_locks_are_stored_once_and_checked(spark, tmp_path):
    path = str(tmp_path / "locks")
    journal.store_locks(spark, path, [{"match_id": 1, "p": 0.5}, {"p": 0.5, "match_id": 1}])
    journal.store_locks(spark, path, [{"match_id": 1, "p": 0.5}, {"match_id": 2, "p": 0.25}])
    spark.createDataFrame([("00", "3", "{}")], "lock_sha256 string, match_id string, lock_json string").write.mode("append").parquet(path)
    good, bad = journal.load_locks(spark, path)
    assert sorted(r["match_id"] for r in good.collect()) == ["1", "2"] and [r["match_id"] for r in bad.collect()] == ["3"]


def test_duration_fit_finds_what_made_the_minutes():
    rng = np.random.default_rng(5)
    n, players = 3000, 20
    x = np.c_[np.ones(n), rng.integers(60, 250, n), rng.integers(12, 39, n), rng.integers(2, 4, n), rng.integers(0, 3, n)].astype(float)
    a = rng.integers(0, players, n)
    b = (a + rng.integers(1, players, n)) % players
    pace = rng.normal(0, 2, players)
    pace -= pace.mean()
    beta = np.array([4.0, 0.55, 0.9, 2.0, 1.5])
    y = x @ beta + pace[a] + pace[b] + (1 + 0.4 * np.sqrt(x[:, 1])) * rng.standard_t(8, n)
    got = kernels.student_fit(x, y, np.ones(n), a, b, players)
    assert np.abs(got["beta"][1:3] - beta[1:3]).max() < 0.08 and np.corrcoef(got["pace"], pace)[0, 1] > 0.95 and abs(got["pace"].sum()) < 1e-9
    assert got["sigma0"] + got["sigma1"] * 12 == pytest.approx(1 + 0.4 * 12, rel=0.12) and 4 < got["nu"] < 30


def test_gradients_of_descent():
    got = kernels.descent(lambda v: (float(((v - 3) ** 4).sum() + (v[0] - v[1]) ** 2), 4 * (v - 3) ** 3 + 2 * np.array([v[0] - v[1], v[1] - v[0]])), np.array([0.0, 9.0]))
    assert np.abs(got - 3).max() < 0.05


def test_duration_paths_do_not_hang_on_partitions(spark):
    mean, cov = [4.0, 0.55, 0.9, 2.0, 1.5, 1.0, -0.5, 0.7, -0.7, 1.8], np.diag(np.full(10, 0.01)).tolist()
    run = lambda parts: [r["latent"] for r in simulate.durations(spark, 10_000, 3, mean, cov, [140.0, 22.0, 2.0, 0.0], parts=parts).orderBy("path").collect()]
    one = run(1)
    assert len(one) == 10_000 and one == run(5)
    assert np.median(one) == pytest.approx(4 + 0.55 * 140 + 0.9 * 22 + 2 * 2 + 0.5, abs=0.5)


def test_group_fits_equal_the_kernel(spark):
    rng = np.random.default_rng(2)
    rows = [(g, float(p), float(x), int(rng.random() < p)) for g in "ab" for p, x in zip(rng.uniform(0.05, 0.95, 300), rng.normal(size=300), strict=True)]
    df = spark.createDataFrame(rows + [("c", 0.5, 1.0, 1)], "g string, p double, x double, y int")
    got = {r["g"]: r for r in fits.calibration(df, "p", "y", ["g"]).collect()}
    ridge = {r["g"]: r["weights"] for r in fits.ridge_weights(df.filter("g != 'c'"), "p", ["x"], "y", ["g"], 1.0, -0.05, 0.02).collect()}
    for g in "ab":
        p, x, y = (np.array([r[i] for r in rows if r[0] == g], float) for i in (1, 2, 3))
        assert (got[g]["intercept"], got[g]["slope"]) == pytest.approx(kernels.calibration(p, y), abs=1e-7)
        assert ridge[g] == pytest.approx(kernels.newton(x[:, None], y, p, 1.0, -0.05, 0.02).tolist(), abs=1e-7)
    assert got["c"]["n"] == 1 and got["c"]["slope"] is None


def test_scores_by_hand(spark):
    df = spark.createDataFrame([(i, s[0]) for i, s in enumerate(SCORES)] + [(90, None), (91, "6-3 6-2 extra RET"), (92, "7-6(4) 10-8")], "i int, s string")
    got = {r["i"]: r["v"] for r in df.select("i", T.validated_score(F.col("s"), F.lit(3)).alias("v")).collect()}
    for i, s in enumerate(SCORES):
        v = got[i]
        assert (v["valid"], v["completed"], v["termination"], v["wins_a"], v["wins_b"], v["service_games"], v["official_games"], ",".join(sorted(v["anomaly_codes"]))) == s[1:]
    assert got[90]["anomaly_codes"] == ["SCORE_MISSING"] and got[91]["anomaly_codes"] == ["SCORE_MALFORMED"] and got[92]["valid"]
    five = df.limit(1).select(T.validated_score(F.lit("6-4 6-4"), F.lit(5)).alias("v"), T.validated_score(F.lit("6-4"), F.lit(4)).alias("w")).head()
    assert five["v"]["anomaly_codes"] == ["SCORE_INCOMPLETE_MATCH"] and five["w"]["anomaly_codes"] == ["SCORE_INVALID_BEST_OF"]


def test_names_keep_what_they_should(spark):
    names = ["Müller", "Félix Auger-Aliassime", "Ștefan  O'Neill", None, "Łukasz"]
    df = spark.createDataFrame([(n,) for n in names], "n string")
    got = df.select(T.spaced_name(F.col("n")), T.joined_name(F.col("n")), T.hyphen_name(F.col("n")), T.name_signature(F.col("n"))).collect()
    assert got[0][0] == "muller" and got[1][0] == "felix auger aliassime" and got[1][2] == "felix auger aliassime" and got[1][1] == "felixaugeraliassime"
    assert got[2][2] == "stefan o'neill" and got[2][3] == "s|neill" and got[3][0] is None


def test_intake_helpers(spark):
    df = spark.createDataFrame([(1, "2024-01-05")], "k int, d string").withColumn("d", F.to_date("d"))
    assert intake.covered(df, "d", "2024-01-01", "2024-02-01").count() == 1
    with pytest.raises(ValueError, match="1 rows"):
        intake.covered(df, "d", "2024-02-01", "2024-03-01")
    assert df.select(intake.first_present(df, ["x", "k", "d"])).head()[0] == 1 and df.select(intake.first_present(df, ["x"])).head()[0] is None
    share = df.select(reports.stopping(F.lit(0), F.lit(None).cast("double"), F.lit(0.0), F.lit(1.0), F.lit(True))).head()[0]
    assert share == "UNAVAILABLE"


@pytest.mark.parametrize(("by", "strict"), [([], False), ([], True), (["g"], False), (["g"], True)])
def test_version_as_of_against_a_search_without_lists(spark, by, strict):
    rng = np.random.default_rng(3)
    pick = lambda n, top, nulls: [None if nulls and rng.random() < 0.1 else int(x) for x in rng.integers(0, top, n)]
    versions = list(zip(pick(300, 3, True), pick(300, 90, True), pick(300, 1000, True), strict=True))
    wanted = list(zip(range(200), pick(200, 4, True), pick(200, 100, True), strict=True))

    def search(g, cutoff):
        fit = [(t, -1 if v is None else v) for k, t, v in versions if (not by or (k is not None and k == g)) and None not in (t, cutoff) and (t < cutoff or (t == cutoff and not strict))]
        v = max(fit)[1] if fit else -1
        return None if v < 0 else v

    v, w = spark.createDataFrame(versions, "g int, t int, v int"), spark.createDataFrame(wanted, "i int, g int, cutoff int")
    out = matching.version_as_of(v, w, by, "cutoff", "t", "v", strict=strict)
    assert out.columns == ["i", "g", "cutoff", "asof_version"]
    assert {r["i"]: r["asof_version"] for r in out.collect()} == {i: search(g, c) for i, g, c in wanted}
    assert matching.version_as_of(v.limit(0), w, by, "cutoff", "t", "v").filter("asof_version IS NULL").count() == 200
    # Each row met the sorted list of its group's versions: rows times versions.
    assert "collect_list" not in out._jdf.queryExecution().toString()


def test_duration_fit_gathers_no_group(spark):
    """Tasks add up sums over batches of matches and the fit equals the kernel's over all rows; before, each group went to one task as a whole."""
    rng = np.random.default_rng(8)
    rows, want = [], {}
    for tour, n in (("A", 900), (None, 700), ("C", 1)):
        x = np.c_[np.ones(n), rng.integers(60, 250, n), rng.integers(12, 39, n)].astype(float)
        a = rng.integers(0, 8, n)
        b = (a + rng.integers(1, 8, n)) % 8
        w = rng.uniform(0.5, 1.0, n)
        y = x @ np.array([4.0, 0.55, 0.9]) + a / 4 + b / 4 + (1 + 0.4 * np.sqrt(x[:, 1])) * rng.standard_t(6, n)
        rows += [(tour, float(y[i]), float(x[i, 1]), float(x[i, 2]), f"p{a[i]}", f"p{b[i]}", float(w[i])) for i in range(n)]
        names = sorted({*a.tolist(), *b.tolist()})
        place = {p: i for i, p in enumerate(names)}
        want[tour] = kernels.student_fit(x, y, w, np.array([place[i] for i in a.tolist()]), np.array([place[i] for i in b.tolist()]), len(names)) | {"n": n, "players": [f"p{i}" for i in names]}
    df = spark.createDataFrame(rows, "tour string, y double, points double, games double, a string, b string, w double").repartition(5)
    out = fits.duration(df, ["tour"], "y", ["points", "games"], "a", "b", "w")
    assert "InPandas" not in out._jdf.queryExecution().toString()
    got = {r["tour"]: r for r in out.collect()}
    assert set(got) == set(want)
    for tour, r in got.items():
        assert r["n"] == want[tour]["n"] and r["players"] == want[tour]["players"]
        for c in ("beta", "pace", "sigma0", "sigma1"):
            assert np.allclose(r[c], want[tour][c], rtol=2e-3, atol=2e-3), (tour, c, r[c], want[tour][c])
    assert fits.duration(df.limit(0), ["tour"], "y", ["points", "games"], "a", "b", "w").count() == 0
