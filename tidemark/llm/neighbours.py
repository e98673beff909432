"""Operator 7: approximate nearest neighbours by a hierarchical k-means tree with best-bin-first search.

The measure is the largest inner product. Vectors get one more coordinate, the root of the largest
squared norm less their own, so that the nearest in distance to a query (with 0 there) is the one
with the largest product. A tree of k-means clusters is fitted on a bounded, documented sample (SAMPLE
vectors with the smallest hash of the id) and every vector is put into its leaf. A query descends
to its nearest leaf and keeps the other branches in a priority queue; the nearest branch is taken
next, until as many leaves are visited as calibration asks for and they hold enough vectors.

Calibration: the exact neighbours of at most CALIBRATION queries are found by brute force over all
vectors, and the number of leaves is widened until TARGET of these are in the visited leaves.

Queries meet candidates by part: neighbouring leaves of the tree, PART vectors together at most, or a share
of a larger leaf. A query goes to a part with the list of its leaves there, and brings back the best k of
all of them. The part of its nearest leaf comes first; the score of the last of k found there is the bar,
and the other parts send back only what reaches it. Parts visited by more than PART queries are dealt out, too,
so no group is larger. Scores are made twice: in blocks, to choose, and for what is chosen once more
vector by vector, so that like vectors have like scores.

Of vectors that are alike in every component the k + 1 smallest ids are candidates, as no more of them can
be among a query's k nearest.

Defined results: vectors that are null, empty, zero or hold null or non-finite components, and those whose
length is not the commonest, take no part; ties go to the smaller id; rows with a query's own id are
not its neighbours; a query with fewer candidates than k gets them all; rows with a null id take
no part; repeated rows are one; an id with several vectors is one neighbour with the best of its scores, and as
a query has the least of its vectors; other columns are not read.
"""

from __future__ import annotations

import heapq
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.llm.shared import written

K, EVERY, SAMPLE, LEAF, BRANCH, CALIBRATION, TARGET, PART = 20, 20, 20_000, 256, 8, 200, 0.97, 4096
_sent: dict = {}


class Tree:
    """centers[i] belongs to node i; children[i] are its nodes, or empty at a leaf, whose number is leaf[i]."""

    def __init__(self) -> None:
        self.centers: list[np.ndarray] = []
        self.children: list[list[int]] = []
        self.leaf: list[int] = []
        self.leaves = 0

    def add(self, points: np.ndarray, small: int, rng: np.random.Generator) -> int:
        node = len(self.centers)
        self.centers.append(points.mean(axis=0))
        self.children.append([])
        self.leaf.append(-1)
        which = cluster(points, rng) if len(points) > small else None
        if which is None:
            self.leaf[node], self.leaves = self.leaves, self.leaves + 1
        else:
            self.children[node] = [self.add(points[which == c], small, rng) for c in np.unique(which)]
        return node

    def assign(self, points: np.ndarray) -> np.ndarray:
        """The leaf of each point, by the nearest child at each level."""
        out = np.zeros(len(points), np.int64)
        todo = [(0, np.arange(len(points)))]
        while todo:
            node, rows = todo.pop()
            if not len(rows):
                continue
            if not self.children[node]:
                out[rows] = self.leaf[node]
                continue
            near = distances(points[rows], np.stack([self.centers[c] for c in self.children[node]])).argmin(axis=1)
            todo += [(c, rows[near == i]) for i, c in enumerate(self.children[node])]
        return out

    def search(self, query: np.ndarray):
        """Leaves in best-bin-first order."""
        queue = [(0.0, 0)]
        while queue:
            _, node = heapq.heappop(queue)
            while self.children[node]:
                d = distances(query[None, :], np.stack([self.centers[c] for c in self.children[node]]))[0]
                order = np.argsort(d, kind="stable")
                for i in order[1:]:
                    heapq.heappush(queue, (float(d[i]), self.children[node][i]))
                node = self.children[node][order[0]]
            yield self.leaf[node]


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a * a).sum(axis=1)[:, None] - 2 * a @ b.T + (b * b).sum(axis=1)[None, :]


def cluster(points: np.ndarray, rng: np.random.Generator, rounds: int = 8) -> np.ndarray | None:
    """k-means with BRANCH clusters; None if the points cannot be told apart."""
    centers = points[rng.choice(len(points), min(BRANCH, len(points)), replace=False)]
    which = None
    for _ in range(rounds):
        which = distances(points, centers).argmin(axis=1)
        centers = np.stack([points[which == c].mean(axis=0) if (which == c).any() else centers[c] for c in range(len(centers))])
    return which if which is not None and len(np.unique(which)) > 1 else None


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 1))


def _wider(x: np.ndarray, most: float) -> np.ndarray:
    return np.c_[x, np.sqrt(np.maximum(0, most - (x * x).sum(axis=1)))]


def _chosen(query: np.ndarray, own: int, scores: np.ndarray, ids: np.ndarray, vectors: np.ndarray, k: int, bar: float, repeated: bool) -> tuple[np.ndarray, np.ndarray]:
    """Places and exact scores of the best k of a block, the query itself left out, as far as they reach the bar."""
    slack = 1e-9 * (1 + np.abs(scores[np.isfinite(scores)]).max(initial=0.0))
    some = np.flatnonzero((scores >= bar - slack) & np.isfinite(scores) & (ids != own))
    if len(some) > 4 * k and not repeated:
        least = np.partition(scores[some], len(some) - k)[len(some) - k]
        some = some[scores[some] >= least - slack]
    exact = (vectors[some] * query).sum(axis=1)
    order = np.lexsort((ids[some], -exact))
    if repeated:
        # An id with several vectors takes one place.
        order = order[np.sort(np.unique(ids[some][order], return_index=True)[1])]
    keep = order[:k]
    return some[keep], exact[keep]


def _block(query_ids, queries, bars, leaves, ids, vectors, leaf, k: int) -> pa.Table:
    """(query_id, vec_id, score): for each query the best of the vectors in its leaves (null: in all), as far as they reach its bar."""
    out = []
    repeated = len(np.unique(ids)) < len(ids)
    where = {int(x): np.flatnonzero(leaf == x) for x in np.unique(leaf)} if leaves is not None else {}
    for at in range(0, len(query_ids), 256):
        q = queries[at : at + 256]
        if leaves is None:
            scores = q @ vectors.T
        else:
            scores = np.full((len(q), len(ids)), -np.inf)
            asked: dict[int, list[int]] = {}
            for i, some in enumerate(leaves[at : at + 256]):
                for x in some:
                    asked.setdefault(x, []).append(i)
            for x, rows in asked.items():
                if x in where:
                    scores[np.ix_(rows, where[x])] = q[rows] @ vectors[where[x]].T
        for i, own in enumerate(query_ids[at : at + 256]):
            place, exact = _chosen(q[i], own, scores[i], ids, vectors, k, -np.inf if bars is None else bars[at + i], repeated)
            out.append((np.full(len(place), own), ids[place], exact, place))
    if not out:
        return pa.table({"query_id": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "score": pa.array([], pa.float64()), "place": pa.array([], pa.int64())})
    columns = [np.concatenate(x) for x in zip(*out, strict=True)]
    return pa.table({n: pa.array(x, t) for n, x, t in zip(("query_id", "vec_id", "score", "place"), columns, (pa.int64(), pa.int64(), pa.float64(), pa.int64()), strict=True)})


def _best(found: DataFrame, k: int, *more: str) -> DataFrame:
    one = found.groupBy("query_id", "vec_id").agg(F.max(F.struct("score", *more)).alias("_x")).select("query_id", "vec_id", "_x.*")
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return one.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def parted(counts: dict[int, int], most: int) -> dict[int, tuple[int, int]]:
    """For each leaf its part and how many shares the part has: leaves in the tree's order, put together up to most vectors."""
    out, part, held = {}, 0, 0
    for x in sorted(counts):
        if held and held + counts[x] > most:
            part, held = part + 1, 0
        held += counts[x]
        out[x] = (part, -(-counts[x] // most))
    return out


def usable(vectors: DataFrame, id_column: str, vector_column: str) -> DataFrame:
    """(vec_id, v) of the vectors that take part."""
    v = F.col(f"`{vector_column}`").cast("array<double>")
    rows = vectors.select(F.col(f"`{id_column}`").cast("long").alias("vec_id"), v.alias("v")).filter("vec_id IS NOT NULL AND v IS NOT NULL AND size(v) > 0")
    rows = rows.filter(F.forall("v", lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))).filter(F.exists("v", lambda x: x != 0))
    sizes = rows.groupBy(F.size("v").alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "d").limit(1).collect()
    return rows.filter(F.size("v") == (sizes[0]["d"] if sizes else 0))


def search(vectors: DataFrame, is_query, id_column: str = "vec_id", vector_column: str = "embedding", k: int = K, sample: int = SAMPLE, leaf: int = LEAF, calibration: int = CALIBRATION, target: float = TARGET) -> DataFrame:
    """(query_id, rank, vec_id, score). is_query: a condition on the column vec_id."""
    spark = vectors.sparkSession
    kind = "query_id long, vec_id long, score double"
    rows = usable(vectors, id_column, vector_column)
    norm = F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)
    size, most = rows.agg(F.count(F.lit(1)), F.max(norm)).head()
    if not size:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    few = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).select("v").toArrow()
    points = _wider(_matrix(few.column(0).combine_chunks()), most)
    tree = Tree()
    tree.add(points, max(16, leaf * len(points) // size), np.random.default_rng(0))
    sent, key = spark.sparkContext.broadcast(tree), uuid.uuid4().hex

    def the_tree() -> Tree:
        if key not in _sent:
            _sent.clear()
            _sent[key] = sent.value
        return _sent[key]

    def put(batches):
        for b in batches:
            where = the_tree().assign(_wider(_matrix(b.column(1)), most))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(where, pa.int32())], ["vec_id", "v", "leaf"])

    alike = Window.partitionBy("v").orderBy("vec_id")
    candidates = rows.distinct().withColumn("_n", F.row_number().over(alike)).filter(F.col("_n") <= k + 1).drop("_n")
    indexed = written(candidates.mapInArrow(put, "vec_id long, v array<double>, leaf int"), "ann-index")
    counts = {r["leaf"]: r["n"] for r in indexed.groupBy("leaf").agg(F.count(F.lit(1)).alias("n")).collect()}
    queries = rows.filter(is_query).groupBy(F.col("vec_id").alias("query_id")).agg(F.min("v").alias("q"))

    # How many leaves the exact neighbours of some queries lie in.
    tried = queries.orderBy(F.xxhash64("query_id"), "query_id").limit(calibration).toArrow()
    some_ids, some = tried.column(0).combine_chunks().to_numpy(), _matrix(tried.column(1).combine_chunks())
    trial = spark.sparkContext.broadcast((some_ids, some))

    def brute(batches):
        ids, q = trial.value
        for b in batches:
            t = _block(ids, q, None, None, b.column(0).to_numpy(), _matrix(b.column(1)), None, k)
            yield from t.select(["query_id", "vec_id", "score"]).append_column("leaf", b.column(2).take(t.column("place").combine_chunks())).to_batches()

    exact = _best(indexed.mapInArrow(brute, "query_id long, vec_id long, score double, leaf int"), k, "leaf").collect()
    order = {int(q): {l: n for n, l in enumerate(tree.search(np.r_[x, 0.0]), 1)} for q, x in zip(some_ids, some, strict=True)}
    needed = sorted(order[r["query_id"]][r["leaf"]] for r in exact)
    visits = needed[min(len(needed) - 1, int(np.ceil(target * len(needed))))] if needed else 1
    part_of = parted(counts, PART)

    def visit(batches):
        for b in batches:
            at, parts, leaves, first = [], [], [], []
            for i, x in enumerate(_matrix(b.column(1))):
                held, mine = 0, {}
                for n, l in enumerate(the_tree().search(np.r_[x, 0.0])):
                    if n >= visits and held > k:
                        break
                    held += counts.get(l, 0)
                    if counts.get(l):
                        mine.setdefault(part_of[l][0], []).append(l)
                for j, (p, some_leaves) in enumerate(mine.items()):
                    at.append(i)
                    parts.append(p)
                    leaves.append(some_leaves)
                    first.append(j == 0)
            at = pa.array(at, pa.int32())
            columns = [b.column(0).take(at), b.column(1).take(at), pa.array(parts, pa.int32()), pa.array(leaves, pa.list_(pa.int32())), pa.array(first, pa.bool_())]
            yield pa.RecordBatch.from_arrays(columns, ["query_id", "q", "part", "leaves", "first"])

    visited = written(queries.mapInArrow(visit, "query_id long, q array<double>, part int, leaves array<int>, first boolean"), "ann-visits")
    # Shares of large parts, of both sides; the tables are as long as the tree has leaves.
    leaf_parts = F.broadcast(spark.createDataFrame([(l, p, c) for l, (p, c) in part_of.items()], "leaf int, part int, c int"))
    shares = {p: c for p, c in part_of.values()}
    right = indexed.join(leaf_parts, "leaf").withColumn("x", F.pmod(F.xxhash64("vec_id"), F.col("c")).cast("int"))

    def meet(a: pa.Table, b: pa.Table) -> pa.Table:
        if not len(a) or not len(b):
            return _block([], None, None, None, np.zeros(0, np.int64), None, None, k).select(["query_id", "vec_id", "score"])
        a, b = a.combine_chunks(), b.combine_chunks()
        t = _block(a["query_id"].to_numpy(), _matrix(a["q"].combine_chunks()), a["bar"].to_numpy(), a["leaves"].to_pylist(), b["vec_id"].to_numpy(), _matrix(b["v"].combine_chunks()), b["leaf"].to_numpy(), k)
        return t.select(["query_id", "vec_id", "score"])

    def turn(asking: DataFrame) -> DataFrame:
        asked = {r["part"]: r["n"] for r in asking.groupBy("part").agg(F.count(F.lit(1)).alias("n")).collect()}
        deal = F.broadcast(spark.createDataFrame([(p, c, -(-asked.get(p, 1) // PART)) for p, c in shares.items()], "part int, c int, a int"))
        left = asking.join(deal, "part").withColumn("y", F.pmod(F.xxhash64("query_id"), F.col("a")).cast("int")).withColumn("x", F.explode(F.sequence(F.lit(0), F.col("c") - 1))).select("part", "x", "y", "query_id", "q", "leaves", "bar")
        other = right.join(deal.select("part", "a"), "part").withColumn("y", F.explode(F.sequence(F.lit(0), F.col("a") - 1))).select("part", "x", "y", "vec_id", "v", "leaf")
        return left.groupBy("part", "x", "y").cogroup(other.groupBy("part", "x", "y")).applyInArrow(meet, kind)

    near = written(turn(visited.filter("first").withColumn("bar", F.lit(float("-inf")))), "ann-near")
    bars = _best(near, k).groupBy("query_id").agg(F.min(F.when(F.col("rank") == k, F.col("score"))).alias("bar"))
    rest = visited.filter("NOT first").join(bars, "query_id", "left").withColumn("bar", F.coalesce("bar", F.lit(float("-inf"))))
    return _best(near.unionAll(turn(rest)), k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def query(spark, sf_dir):
    """op7_neighbours."""
    from tidemark.llm.shared import table

    return search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % EVERY == 0)
