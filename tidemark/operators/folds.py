"""Ordered folds that couple rows: ratings, filters and the scoring state machine.

State couples the players of a tour, so a fold runs by tour and configuration: the parallelism is over these, and over
the months that one pass emits. A tour's matches are read in order, in batches, and only the state stays in memory."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def _parts(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def elo(matches: DataFrame, grid: list[tuple[float, float]], parts: int | None = None) -> DataFrame:
    """For each match and each (k, surface blend) of the grid, both ratings before it and the forecast.

    matches: tour, at (order), match_id, a, b, surface, won (1 if a won). A change of k (won - expected) goes to the global and to
    the surface rating; ratings start at 1500. A repeated match_id of a tour counts once."""
    grid_df = F.broadcast(matches.sparkSession.createDataFrame(grid, "k double, blend double"))
    # Repeats go before the fold, so that the fold holds nothing but ratings.
    first = F.row_number().over(Window.partitionBy("tour", "match_id").orderBy("at", "a", "b"))
    rows = matches.withColumn("_n", first).filter("_n = 1").crossJoin(grid_df).select("tour", "k", "blend", "at", "match_id", "a", "b", "surface", "won")
    by = ["tour", "k", "blend"]
    ordered = rows.repartition(parts or _parts(matches), *by).sortWithinPartitions(*by, "at", "match_id")

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, rating = None, {}
        for frame in batches:
            out = []
            for tour, k, blend, at, match, a, b, surface, won in frame.itertuples(index=False):
                if (tour, k, blend) != key:
                    key, rating = (tour, k, blend), {}
                get = rating.get
                ra = (1 - blend) * get((a, None), 1500.0) + blend * get((a, surface), 1500.0)
                rb = (1 - blend) * get((b, None), 1500.0) + blend * get((b, surface), 1500.0)
                p = 1 / (1 + 10 ** ((rb - ra) / 400))
                out.append((tour, k, blend, at, match, ra, rb, p, won))
                change = k * (won - p)
                for s in (None, surface):
                    rating[a, s] = get((a, s), 1500.0) + change
                    rating[b, s] = get((b, s), 1500.0) - change
            yield pd.DataFrame(out, columns=["tour", "k", "blend", "at", "match_id", "rating_a", "rating_b", "p", "won"])

    return ordered.mapInPandas(fold, "tour string, k double, blend double, at long, match_id long, rating_a double, rating_b double, p double, won int")


def bradley_terry(matches: DataFrame, decay_days: float, variance: float, parts: int | None = None) -> DataFrame:
    """Dynamic strengths: before each match the decayed means and variances and the logistic-normal forecast, then a diagonal Laplace update.

    matches: tour, at (microseconds), match_id, a, b, won."""
    ordered = matches.select("tour", "at", "match_id", "a", "b", "won").repartition(parts or _parts(matches), "tour").sortWithinPartitions("tour", "at", "match_id")

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tour_now, state = None, {}
        for frame in batches:
            out = []
            for tour, at, match, a, b, won in frame.itertuples(index=False):
                if tour != tour_now:
                    tour_now, state = tour, {}
                now = []
                for x in (a, b):
                    m, v, t = state.get(x, (0.0, variance, at))
                    keep = 2.0 ** (-(at - t) / 86400e6 / decay_days)
                    now.append((m * keep, variance + (v - variance) * keep * keep))
                (ma, va), (mb, vb) = now
                p = 1 / (1 + np.exp(-(ma - mb) / np.sqrt(1 + np.pi * (va + vb) / 8)))
                out.append((tour, at, match, ma, mb, va + vb, p, won))
                q = 1 / (1 + np.exp(-(ma - mb)))
                w = q * (1 - q)
                state[a] = (ma + va * (won - q) / (1 + va * w), va / (1 + va * w), at)
                state[b] = (mb - vb * (won - q) / (1 + vb * w), vb / (1 + vb * w), at)
            yield pd.DataFrame(out, columns=["tour", "at", "match_id", "mean_a", "mean_b", "variance", "p", "won"])

    return ordered.mapInPandas(fold, "tour string, at long, match_id long, mean_a double, mean_b double, variance double, p double, won int")


def play(points: DataFrame, by: list[str], order: str, winner: str) -> DataFrame:
    """The state of each ordered stream of points: games and sets of both players, and points of the running game.

    A game is four points and two ahead, a set six games and two ahead or seven; at six all one game decides. Runs as a fold
    over the stream's points, so that one row for each stream is left."""
    stream = points.filter(F.col(winner).isNotNull()).groupBy(*by).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(winner).cast("int").alias("w")))).alias("_p"))
    names = ["pa", "pb", "ga", "gb", "sa", "sb", "n"]
    start = F.struct(*[F.lit(0).alias(n) for n in names])

    def step(s, x):
        pa, pb = s["pa"] + (x["w"] == 0).cast("int"), s["pb"] + (x["w"] == 1).cast("int")
        game = (F.greatest(pa, pb) >= 4) & (F.abs(pa - pb) >= 2)
        ga, gb = s["ga"] + (game & (pa > pb)).cast("int"), s["gb"] + (game & (pb > pa)).cast("int")
        over = ((F.greatest(ga, gb) >= 6) & (F.abs(ga - gb) >= 2)) | (F.greatest(ga, gb) == 7)
        none = lambda test, v: F.when(test, F.lit(0)).otherwise(v)
        return F.struct(
            none(game, pa).alias("pa"), none(game, pb).alias("pb"), none(over, ga).alias("ga"), none(over, gb).alias("gb"),
            (s["sa"] + (over & (ga > gb)).cast("int")).alias("sa"), (s["sb"] + (over & (gb > ga)).cast("int")).alias("sb"), (s["n"] + 1).alias("n"),
        )

    return stream.select(*by, F.aggregate("_p", start, step).alias("s")).select(*by, "s.*")
