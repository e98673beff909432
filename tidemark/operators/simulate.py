"""Monte Carlo paths that do not hang on how they are dealt to partitions: a path's seed is its index."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

STATS = "games int, aces int, double_faults int, breaks int, first_in int, first_won int, winners int, errors int"
SCHEMA = f"path long, winner int, walkover boolean, started boolean, completed boolean, best_of int, sets array<struct<a:int,b:int,tiebreak:boolean>>, s0 struct<{STATS.replace(' int', ':int')}>, s1 struct<{STATS.replace(' int', ':int')}>, first_break int, durations array<int>"


def one_path(seed: int, path: int, serve: list[tuple[float, float, float, float, float]], best_of: int, retire: float, minutes: float) -> dict:
    """serve: for each player first serves in, aces of these, other first-serve points won, double faults, second-serve points won."""
    rng = np.random.Generator(np.random.PCG64(np.random.SeedSequence(seed, spawn_key=(path,))))
    need, sets, server = best_of // 2 + 1, [], int(rng.integers(2))
    stats = [dict.fromkeys((x.split()[0] for x in STATS.split(", ")), 0) for _ in range(2)]
    won, games_played, points, first_break, retired = [0, 0], 0, 0, None, None

    def point(by: int) -> int:
        nonlocal points
        points += 1
        f, a, q1, d, q2 = serve[by]
        u = rng.random(3)
        if u[0] < f:
            stats[by]["first_in"] += 1
            ace = u[1] < a
            stats[by]["aces"] += int(ace)
            good = ace or u[2] < q1
            stats[by]["first_won"] += int(good)
        elif u[1] < d:
            stats[by]["double_faults"] += 1
            good = False
        else:
            good = u[2] < q2
        return by if good else 1 - by

    def game(by: int) -> int:
        p = [0, 0]
        while max(p) < 4 or abs(p[0] - p[1]) < 2:
            p[point(by)] += 1
        return int(p[1] > p[0])

    while max(won) < need and retired is None:
        g, tiebreak = [0, 0], False
        while not (max(g) >= 6 and abs(g[0] - g[1]) >= 2):
            if g == [6, 6]:
                target, p, n = (10 if won[0] == won[1] == need - 1 else 7), [0, 0], 0
                while max(p) < target or abs(p[0] - p[1]) < 2:
                    p[point((server + (n + 1) // 2) % 2)] += 1
                    n += 1
                g[int(p[1] > p[0])] += 1
                tiebreak, server = True, 1 - server
                games_played += 1
                break
            w = game(server)
            g[w] += 1
            games_played += 1
            stats[w]["games"] += 1
            if w != server:
                stats[w]["breaks"] += 1
                first_break = first_break or games_played
            server = 1 - server
            done = max(g) >= 6 and abs(g[0] - g[1]) >= 2 and won[w] + 1 == need
            if not done and rng.random() < retire:
                retired = int(rng.integers(2))
                break
        if tiebreak:
            stats[int(g[1] > g[0])]["games"] += 1
        if retired is None:
            won[int(g[1] > g[0])] += 1
            sets.append({"a": g[0], "b": g[1], "tiebreak": tiebreak})
    for s in stats:
        s["winners"], s["errors"] = s["aces"] + int(rng.binomial(points, 0.12)), s["double_faults"] + int(rng.binomial(points, 0.1))
    time = minutes * points * float(rng.lognormal(0, 0.1))
    winner = 1 - retired if retired is not None else int(won[1] > won[0])
    return {"path": path, "winner": winner, "walkover": False, "started": True, "completed": retired is None, "best_of": best_of, "sets": sets, "s0": stats[0], "s1": stats[1], "first_break": first_break, "durations": sorted({int(time), int(time + 0.5)})}


def paths(spark: SparkSession, n: int, seed: int, serve: list[tuple[float, float, float, float, float]], best_of: int = 3, retire: float = 0.001, minutes: float = 0.65, start: int = 0, parts: int | None = None) -> DataFrame:
    """Paths start .. start + n - 1. More of them are the same ones and further ones, however many partitions there are."""

    def run(batches):
        for frame in batches:
            yield pd.DataFrame([one_path(seed, int(i), serve, best_of, retire, minutes) for i in frame["id"]])

    return spark.range(start, start + n, 1, parts or max(1, min(spark.sparkContext.defaultParallelism, -(-n // 100)))).mapInPandas(run, SCHEMA)


def durations(spark: SparkSession, n: int, seed: int, mean: list[float], covariance: list[list[float]], exposure: list[float], block: int = 4096, parts: int | None = None) -> DataFrame:
    """n paths of a match's minutes: (path, latent, floor, nearest, ceiling).

    mean and covariance are those of the posterior's normal approximation on what the match needs: the coefficients of (1, points, games, sets, tiebreaks), the pace
    of both players and the logs of the two scales and of the degrees of freedom less two. Each path draws its own parameters and one Student-t residual.
    Blocks of paths have their own random streams by their number, so the paths are the same however they are dealt out."""
    mean, root = np.asarray(mean, float), np.linalg.cholesky(np.asarray(covariance, float) + 1e-12 * np.eye(len(mean)))
    x = np.array([1.0, *exposure])
    blocks = -(-n // block)

    def run(batches):
        for batch in batches:
            for i in batch.column(0).to_pylist():
                size = min(block, n - i * block)
                rng = np.random.Generator(np.random.Philox(key=seed, counter=[0, 0, 0, i]))
                draw = mean + rng.standard_normal((size, len(mean))) @ root.T
                center = draw[:, : len(x)] @ x + draw[:, len(x)] + draw[:, len(x) + 1]
                s0, s1, m = np.exp(np.clip(draw[:, len(x) + 2 :].T, -20, 20))
                scale = s0 + s1 * np.sqrt(max(x[1], 1.0))
                latent = np.maximum(1.0, center + scale * rng.standard_t(2 + m))
                shown = [np.maximum(1, f(latent)).astype(np.int64) for f in (np.floor, lambda v: np.floor(v + 0.5), np.ceil)]
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(i * block, i * block + size)), pa.array(latent), *map(pa.array, shown)], ["path", "latent", "floor", "nearest", "ceiling"])

    source = spark.range(0, blocks, 1, parts or min(blocks, spark.sparkContext.defaultParallelism))
    return source.mapInArrow(run, "path long, latent double, floor long, nearest long, ceiling long")
