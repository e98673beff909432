"""Nearest neighbours against brute force."""

import numpy as np
from pyspark.sql import functions as F

from tidemark.llm import neighbours


def brute(rows, k, ask):
    good = [(i, np.array(v, float)) for i, v in rows if i is not None and v and len(v) == 4 and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    out = {}
    for q, x in good:
        if ask(q):
            ranked = sorted(((-float(x @ y), i) for i, y in good if i != q))[:k]
            out[q] = [(i, -s) for s, i in ranked]
    return out


def rows():
    rng = np.random.default_rng(1)
    out = [(int(i), [float(x) for x in rng.normal(size=4).astype(np.float32)]) for i in range(600)]
    out += [(1000 + i, [1.0, 1.0, 1.0, 1.0]) for i in range(300)]
    return out + [(2000, None), (2020, [0.0] * 4), (2040, [1.0, None, 1.0, 1.0]), (2060, [float("nan"), 1.0, 1.0, 1.0]), (2080, [float("inf"), 1.0, 1.0, 1.0]), (2100, [1.0, 2.0]), (None, [1.0] * 4)]


def test_recall_order_and_ties(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "PART", 50)
    data = rows()
    df = spark.createDataFrame([(i, v, 0) for i, v in data], "vec_id long, embedding array<double>, rank int")
    got = {}
    for r in neighbours.search(df, F.col("vec_id") % 20 == 0, leaf=32).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
        assert r["rank"] == len(got[r["query_id"]])
    want = brute(data, 20, lambda i: i % 20 == 0)
    assert set(got) == set(want) and all(len(v) == 20 for v in got.values())
    hits = sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want)
    assert hits >= 0.9 * 20 * len(want)
    for q in want:
        assert [i for i, _ in sorted(got[q], key=lambda x: (-round(x[1], 9), x[0]))] == [i for i, _ in got[q]]


def test_fewer_candidates_than_k_and_empty(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (20, [0.0, 1.0]), (3, [1.0, 1.0])], "vec_id long, embedding array<double>")
    got = sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in neighbours.search(df, F.col("vec_id") % 20 == 0).collect())
    assert got == [(0, 1, 3, 1.0), (0, 2, 20, 0.0), (20, 1, 3, 1.0), (20, 2, 0, 0.0)]
    assert neighbours.search(df.limit(0), F.col("vec_id") % 20 == 0).count() == 0


def test_repeated_rows_and_many_copies(spark):
    """A query row that stands twice, one id 22 times with the query's vector, an id with two vectors, and 40 copies of one vector."""
    rng = np.random.default_rng(3)
    data = [(int(i), [float(x) for x in rng.normal(size=4)]) for i in range(1, 400)]
    data += [(20, data[19][1])] * 3 + [(7, data[39][1])] * 22 + [(900 + i, data[39][1]) for i in range(40)] + [(5, [9.0 + i, 9.0, 9.0, 9.0]) for i in range(30)]
    df = spark.createDataFrame(data, "vec_id long, embedding array<double>")
    got = {}
    for r in neighbours.search(df, F.col("vec_id") % 20 == 0, target=1.0).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append(r["vec_id"])
    for q, x in {i: np.array(min(v for j, v in data if j == i)) for i, _ in data if i % 20 == 0}.items():
        best = {}
        for i, v in data:
            if i != q:
                best[i] = max(best.get(i, -1e9), float((np.array(v) * x).sum()))
        want = [i for i, _ in sorted(best.items(), key=lambda y: (-y[1], y[0]))[:20]]
        assert len(set(got[q])) == 20 and len(set(got[q]) & set(want)) >= 18, q
