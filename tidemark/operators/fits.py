"""Small fits by group: sums of Spark for Newton steps, and grouped Arrow functions over sufficient rows."""

from __future__ import annotations

import uuid

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType, _parse_datatype_string

from tidemark.functions import kernels
from tidemark.session import shared_folder


def _kind(df: DataFrame, by: list[str]) -> str:
    return ", ".join(f"{c} {df.schema[c].dataType.simpleString()}" for c in by)


def logistic_groups(rows: DataFrame, by: list[str], features: list[str], y: str, offset: str | None = None, ridge: float = 0.0, lower: float = -np.inf, upper: float = np.inf, rounds: int = 60, tolerance: float = 1e-10) -> dict[tuple, tuple[int, int, np.ndarray]]:
    """(rows, ones, weights) of the logistic regression of each group, by Newton steps in a box.

    A step's gradient and curvature are sums over all rows, which Spark adds up; only these sums, a few numbers for each group, come to the driver,
    and the groups' weights go back as a broadcast table of one row a group. So no row is rounded, and no group is gathered."""
    spark, k = rows.sparkSession, len(features)
    rows = rows.select(*by, *[F.col(c).cast("double").alias(f"_x{i}") for i, c in enumerate(features)], F.col(y).cast("double").alias("_y"), (F.col(offset).cast("double") if offset else F.lit(0.0)).alias("_o"))
    # Rows alike in everything are counted once.
    counted = rows.groupBy(*rows.columns).agg(F.count(F.lit(1)).alias("_n"))
    sizes = {tuple(r[c] for c in by): (r["n"], int(r["ones"])) for r in counted.groupBy(*by).agg(F.sum("_n").alias("n"), F.sum(F.col("_n") * F.col("_y")).alias("ones")).collect()}
    weights = {g: np.clip(np.zeros(k), lower, upper) for g in sizes}
    open_ = set(sizes)
    kind = StructType([counted.schema[c] for c in by] + [StructField("_w", ArrayType(DoubleType()))])
    for _ in range(rounds):
        if not open_:
            break
        now = F.broadcast(spark.createDataFrame([(*g, weights[g].tolist()) for g in open_], kind))
        met = counted.alias("r").join(now.alias("w"), [F.col(f"r.{c}").eqNullSafe(F.col(f"w.{c}")) for c in by])
        z = F.col("_o")
        for i in range(k):
            z = z + F.col(f"_x{i}") * F.col("_w")[i]
        met = met.withColumn("_p", 1 / (1 + F.exp(-F.greatest(F.lit(-35.0), F.least(F.lit(35.0), z)))))
        g = [F.sum(F.col("_n") * (F.col("_p") - F.col("_y")) * F.col(f"_x{i}")).alias(f"g{i}") for i in range(k)]
        h = [F.sum(F.col("_n") * F.col("_p") * (1 - F.col("_p")) * F.col(f"_x{i}") * F.col(f"_x{j}")).alias(f"h{i}_{j}") for i in range(k) for j in range(i + 1)]
        for r in met.groupBy(*[F.col(f"r.{c}").alias(c) for c in by]).agg(*g, *h).collect():
            group = tuple(r[c] for c in by)
            w = weights[group]
            gradient = np.array([r[f"g{i}"] for i in range(k)]) + ridge * w
            curve = np.array([[r[f"h{max(i, j)}_{min(i, j)}"] for j in range(k)] for i in range(k)]) + (ridge + 1e-10) * np.eye(k)
            free = ~(((w <= lower) & (gradient > 0)) | ((w >= upper) & (gradient < 0)))
            step = np.zeros(k)
            if free.any():
                step[free] = np.linalg.solve(curve[np.ix_(free, free)], gradient[free])
            # A step of more than two on the logit scale is shortened: far from the optimum the curvature does not hold.
            new = np.clip(w - step * min(1.0, 2.0 / max(np.abs(step).max(), 1e-300)), lower, upper)
            weights[group] = new
            if np.abs(new - w).max() < tolerance:
                open_.discard(group)
    return {g: (*sizes[g], weights[g]) for g in sizes}


def _fitted(rows: DataFrame, by: list[str], found: list[tuple], more: str) -> DataFrame:
    kind = StructType([StructField(c, rows.schema[c].dataType) for c in by] + list(_parse_datatype_string(more).fields))
    return rows.sparkSession.createDataFrame(found, kind)


def calibration(rows: DataFrame, p: str, y: str, by: list[str], clip: float = 1e-6) -> DataFrame:
    """Intercept and slope of the outcome on the forecast's logit; null for fewer than ten rows or one class."""
    q = F.least(F.lit(1 - clip), F.greatest(F.lit(clip), F.col(p)))
    x = rows.select(*by, F.lit(1.0).alias("_one"), F.log(q / (1 - q)).alias("_logit"), F.col(y).alias("_t"))
    found = logistic_groups(x, by, ["_one", "_logit"], "_t")
    out = [(*g, n, *([float(v) for v in w] if n >= 10 and 0 < ones < n else [None, None])) for g, (n, ones, w) in found.items()]
    return _fitted(rows, by, out, "n long, intercept double, slope double")


def ridge_weights(rows: DataFrame, offset: str, features: list[str], y: str, by: list[str], ridge: float, lower: float = -2.5, upper: float = 0.0) -> DataFrame:
    """Offset logistic regression with a ridge and a box."""
    found = logistic_groups(rows, by, features, y, offset, ridge, lower, upper)
    return _fitted(rows, by, [(*g, n, [float(v) for v in w]) for g, (n, _, w) in found.items()], "n long, weights array<double>")


def beta_binomial(rows: DataFrame, successes: str, trials: str, weight: str, by: list[str]) -> DataFrame:
    """Weighted beta-binomial fit of each group. Rows alike in counts are added first: a group is bound by its distinct counts."""
    counted = rows.groupBy(*by, F.col(successes).alias("k"), F.col(trials).alias("n")).agg(F.sum(weight).alias("w"))

    def fit(frame: pd.DataFrame) -> pd.DataFrame:
        k, n, w = (frame[c].to_numpy(float) for c in ("k", "n", "w"))
        mean, concentration = kernels.beta_binomial_map(k, n, w)
        return pd.DataFrame([[*frame[by].iloc[0], float(w.sum()), mean, concentration]], columns=[*by, "weight", "logit_mean", "log_concentration"])

    return counted.groupBy(*by).applyInPandas(fit, f"{_kind(rows, by)}, weight double, logit_mean double, log_concentration double")


def duration(rows: DataFrame, by: list[str], minutes: str, exposures: list[str], a: str, b: str, weight: str) -> DataFrame:
    """The duration model of each group: coefficients, scale, degrees of freedom and the players' pace.

    A step's value and gradient are sums over all matches, which tasks make batch by batch and Spark adds up; only these, a few numbers and one for each player
    of a group, come to the driver, and the points to evaluate go back. All groups step at one time, and no group is gathered."""
    spark, k, nan = rows.sparkSession, len(exposures) + 1, F.lit(float("nan"))
    number = lambda c: F.coalesce(F.col(c).cast("double"), nan)
    xs = [f"_x{i}" for i in range(k)]
    rows = rows.select(*by, number(minutes).alias("_y"), F.lit(1.0).alias("_x0"), *[number(c).alias(f"_x{i + 1}") for i, c in enumerate(exposures)], F.col(a).cast("string").alias("_p"), F.col(b).cast("string").alias("_q"), number(weight).alias("_w"))
    kind = StructType([rows.schema[c] for c in by] + list(_parse_datatype_string("_g int, _o string, _i int").fields))
    path = f"{shared_folder(spark)}/tidemark/duration-{uuid.uuid4().hex}"
    try:
        # Written once, as the steps read them again and again.
        rows.write.parquet(f"{path}/matches")
        rows = spark.read.schema(rows.schema).parquet(f"{path}/matches")
        root, (s0, s1, _) = F.sqrt(F.greatest(F.col(xs[1]), F.lit(1.0))), kernels.STUDENT_START
        part = F.col("_w") / (F.lit(s0) + F.lit(s1) * root) ** 2
        products = [F.sum(part * F.col(xs[i]) * F.col(xs[j])).alias(f"_h{i}_{j}") for i in range(k) for j in range(i + 1)] + [F.sum(part * F.col(x) * F.col("_y")).alias(f"_s{i}") for i, x in enumerate(xs)]
        spreads = [F.sum(x).alias(f"_t{i}") for i, x in enumerate([F.col("_w"), part * s0**2, part * root * s0 * s1, part * root * root * s1**2])]
        first = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"), *products, *spreads).collect()
        groups = {tuple(r[c] for c in by): g for g, r in enumerate(first)}
        players: list[list] = [[] for _ in first]
        for r in rows.select(*by, F.explode(F.array("_p", "_q")).alias("_o"), part.alias("_v")).groupBy(*by, "_o").agg(F.sum("_v").alias("_v")).collect():
            players[groups[tuple(r[c] for c in by)]].append((r["_o"], r["_v"]))
        games = [np.array([v for _, v in sorted(p)]) for p in players]
        players = [[o for o, _ in sorted(p)] for p in players]
        places = F.broadcast(spark.createDataFrame([(*key, g, o, i) for key, g in groups.items() for i, o in enumerate(players[g])], kind))
        on = lambda other, o: [F.col(f"r.{c}").eqNullSafe(F.col(f"{other}.{c}")) for c in by] + [F.col(f"r.{o}") == F.col(f"{other}._o")]
        met = rows.alias("r").join(places.alias("p"), on("p", "_p")).join(places.alias("q"), on("q", "_q"))
        met = met.select(F.col("p._g").alias("_g"), "r._y", "r._w", F.col("p._i").alias("_a"), F.col("q._i").alias("_b"), *[f"r.{x}" for x in xs[1:]])
        met.sortWithinPartitions("_g").write.parquet(f"{path}/numbers")
        met = spark.read.schema(met.schema).parquet(f"{path}/numbers")
        sizes = [len(p) for p in players]
        steps = []
        for g, r in enumerate(first):
            xx = np.array([[r[f"_h{max(i, j)}_{min(i, j)}"] for j in range(k)] for i in range(k)])
            steps.append(kernels.student_steps(xx, np.array([r[f"_s{i}"] for i in range(k)]), games[g], np.array([r[f"_t{i}"] for i in range(4)])))
        at, ends = {g: next(s) for g, s in enumerate(steps)}, {}
        while at:
            sums = _student_sums(met, at, sizes, xs[1:])
            for g, v in list(at.items()):
                try:
                    at[g] = steps[g].send(kernels.student_objective(v, sums[g], k, sizes[g]))
                except StopIteration as e:
                    ends[g] = e.value
                    del at[g]
    finally:
        folder = spark._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
    out = []
    for key, g in groups.items():
        found = kernels.student_found(ends[g], k, sizes[g])
        out.append((*key, first[g]["_n"], found["beta"].tolist(), found["sigma0"], found["sigma1"], found["nu"], players[g], found["pace"].tolist()))
    return _fitted(rows, by, out, "n long, beta array<double>, sigma0 double, sigma1 double, nu double, players array<string>, pace array<double>")


def _student_sums(met: DataFrame, at: dict[int, np.ndarray], sizes: list[int], xs: list[str]) -> dict[int, np.ndarray]:
    """student_sums() of each group of at over all its matches."""

    def part(batches):
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            column = {c: batch.column(i).to_numpy(zero_copy_only=False) for i, c in enumerate(batch.schema.names)}
            for g in np.unique(column["_g"]).tolist():
                mine = column["_g"] == g
                c = column if mine.all() else {name: values[mine] for name, values in column.items()}
                x = np.c_[np.ones(len(c["_y"])), *[c[n] for n in xs]]
                sums[g] = sums.get(g, 0.0) + kernels.student_sums(at[g], x, c["_y"], c["_w"], c["_a"], c["_b"], sizes[g])
        yield pa.record_batch([pa.array(list(sums), pa.int32()), pa.array([s.tolist() for s in sums.values()], pa.list_(pa.float64()))], names=["_g", "_s"])

    found = {g: np.zeros(len(v) + 1) for g, v in at.items()}
    parts = met.filter(F.col("_g").isin(list(at))).mapInArrow(part, "_g int, _s array<double>")
    for r in parts.select("_g", F.posexplode("_s").alias("_j", "_s")).groupBy("_g", "_j").agg(F.sum("_s").alias("_s")).collect():
        found[r["_g"]][r["_j"]] = r["_s"]
    return found
