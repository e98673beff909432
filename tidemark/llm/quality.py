"""Operator 6: quality as a logistic regression over hashed word n-grams, trained by follow-the-regularised-leader.

A text's tokens are its words (lower-cased runs of letters, digits and bytes outside ASCII) and its
runs of other printing characters, in order. Features are single tokens, pairs of neighbours (a
token that stands twice in a row gives the same feature whatever it is), and
triples of token shapes (a word's shape says whether it is in capitals, capitalised, lower-case or
has digits; a run of other characters is its own shape), hashed to 2**BITS cells. A feature's value
is its share of the text's features of that kind, so a score is a sparse dot product: the mean
weight of a text's singles, pairs and triples, and a bias.

Weights come from FTRL-proximal with per-coordinate rates and L1 and L2 terms over a documented,
bounded sample: at most SAMPLE labelled documents, those with the smallest hash of the id.

Defined results: null and empty texts have no features, and their score is the bias's; without any
labelled row every score is 0.5; ties and repeated rows are each scored; other columns are not read.
"""

from __future__ import annotations

import math
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import hashing
from tidemark.llm.shared import chunks, fold, text_buffers

BITS, SAMPLE, EPOCHS, CHUNK = 20, 4000, 4, 1 << 21
RATE, BETA, L1, L2, SCALE = 0.5, 1.0, 0.001, 0.05, 8.0
_OTHER = np.array([c if 33 <= c <= 126 and not (48 <= c <= 57 or 65 <= c <= 90 or 97 <= c <= 122) else 0 for c in range(256)], np.uint8)
_UPPER = np.array([65 <= c <= 90 for c in range(256)])
_LOWER = np.array([97 <= c <= 122 for c in range(256)])
_DIGIT = np.array([48 <= c <= 57 for c in range(256)])
_sent: dict = {}


def _sums(flags: np.ndarray) -> np.ndarray:
    return np.r_[0, np.cumsum(flags, dtype=np.int64)]


def features(data: np.ndarray, offsets: np.ndarray, bits: int = BITS) -> list[tuple[np.ndarray, np.ndarray]]:
    """For singles, pairs and triples: text and cell of each."""
    s, e, text, h = hashing.words(data, offsets, hashing.ALNUM)
    s2, _, text2, h2 = hashing.words(data, offsets, _OTHER)
    upper, lower, digit = _sums(_UPPER[data]), _sums(_LOWER[data]), _sums(_DIGIT[data])
    shape = np.where(digit[e] > digit[s], 4, np.where(upper[e] - upper[s] == 0, 1, np.where((lower[e] > lower[s]) | (upper[e] - upper[s] == 1), 2, 3))).astype(np.uint64) if len(s) else h
    order = np.argsort(np.r_[s, s2], kind="stable")
    text, token = np.r_[text, text2][order], np.r_[h, h2 ^ hashing.GOLD][order]
    shape = hashing.mix(np.r_[shape, h2][order])
    shift = np.uint64(64 - bits)
    out = [(text, (token >> shift).astype(np.int64))]
    for size, what in ((2, token), (3, shape)):
        n = max(0, len(what) - size + 1)
        key = np.zeros(n, np.uint64)
        for k in range(size):
            key = hashing.mix(key + what[k : k + n] + np.uint64(size))
        if size == 2:
            key[what[:n] == what[1:]] = 0
        same = text[:n] == text[size - 1 :][:n]
        out.append((text[:n][same], (key[same] >> shift).astype(np.int64)))
    return out


def vectors(data: np.ndarray, offsets: np.ndarray, bits: int = BITS) -> list[tuple[np.ndarray, np.ndarray]]:
    """Cells and values of each text, the three kinds together."""
    n = len(offsets) - 1
    parts = [([], []) for _ in range(n)]
    for text, cell in features(data, offsets, bits):
        at = np.searchsorted(text, np.arange(n + 1))
        for i in range(n):
            if at[i + 1] > at[i]:
                c, k = np.unique(cell[at[i] : at[i + 1]], return_counts=True)
                parts[i][0].append(c)
                parts[i][1].append(SCALE * k / k.sum())
    empty = np.zeros(0, np.int64), np.zeros(0)
    return [(np.concatenate(c), np.concatenate(v)) if c else empty for c, v in parts]


class Ftrl:
    """Follow-the-regularised-leader for logistic loss; the last coordinate is the bias, without L1."""

    def __init__(self, size: int, rate: float = RATE, beta: float = BETA, l1: float = L1, l2: float = L2):
        self.z, self.n = np.zeros(size + 1), np.zeros(size + 1)
        self.rate, self.beta, self.l1, self.l2 = rate, beta, l1, l2

    def weights(self, cells) -> np.ndarray:
        z, n = self.z[cells], self.n[cells]
        return np.where(np.abs(z) <= self.l1, 0.0, -(z - np.sign(z) * self.l1) / ((self.beta + np.sqrt(n)) / self.rate + self.l2))

    def learn(self, cells: np.ndarray, values: np.ndarray, label: int) -> None:
        cells, values = np.r_[cells, len(self.z) - 1], np.r_[values, 1.0]
        w = self.weights(cells)
        p = 1 / (1 + math.exp(-max(-35.0, min(35.0, float(w @ values)))))
        g = (p - label) * values
        sigma = (np.sqrt(self.n[cells] + g * g) - np.sqrt(self.n[cells])) / self.rate
        np.add.at(self.z, cells, g - sigma * w)
        np.add.at(self.n, cells, g * g)


def labelled(docs: DataFrame, labels: DataFrame, label: str, sample: int, id_column: str = "doc_id", text_column: str = "text") -> list[tuple[str, int]]:
    """At most sample (text, label), of the labelled documents with the smallest hash of the id."""
    known = labels.select(F.col(id_column).alias("_id"), F.col(label).cast("int").alias("_label")).dropna().groupBy("_id").agg(F.max("_label").alias("_label"))
    few = known.withColumn("_place", F.xxhash64(F.col("_id").cast("string"))).orderBy("_place", "_id").limit(sample)
    # At most sample rows of an id, a label and a hash.
    texts = docs.select(F.col(id_column).alias("_id"), F.coalesce(F.col(text_column).cast("string"), F.lit("")).alias("_text")).join(F.broadcast(few), "_id")
    rows = texts.groupBy("_id").agg(F.first("_place").alias("_place"), F.min("_text").alias("_text"), F.first("_label").alias("_label")).orderBy("_place", "_id").collect()
    return [(r["_text"], r["_label"]) for r in rows]


def fit(rows: list[tuple[str, int]], bits: int = BITS, epochs: int = EPOCHS) -> np.ndarray:
    """The weights, with the bias last."""
    raw = [t.encode() for t, _ in rows]
    xs = []
    for i in range(0, len(raw), 200):
        part = raw[i : i + 200]
        xs += vectors(np.frombuffer(b"".join(part), np.uint8), np.cumsum([0, *map(len, part)]), bits)
    model = Ftrl(1 << bits)
    order = np.random.default_rng(0)
    for _ in range(epochs if rows else 0):
        for i in order.permutation(len(rows)):
            model.learn(*xs[i], rows[i][1])
    return model.weights(np.arange((1 << bits) + 1)).astype(np.float32)


def scores(data: np.ndarray, offsets: np.ndarray, weights: np.ndarray, bits: int = BITS) -> np.ndarray:
    n = len(offsets) - 1
    total = np.full(n, float(weights[-1]))
    for text, cell in features(data, offsets, bits):
        count = np.bincount(text, minlength=n)
        total += SCALE * np.bincount(text, weights[cell], n) / np.maximum(count, 1)
    return 1 / (1 + np.exp(-np.clip(total, -35, 35)))


def score(docs: DataFrame, weights: np.ndarray, id_column: str = "doc_id", text_column: str = "text", bits: int = BITS) -> DataFrame:
    """Each row's id and score. The weights' size is fixed by bits."""
    sent, key = docs.sparkSession.sparkContext.broadcast(weights), uuid.uuid4().hex
    source = docs.select(F.col(f"`{id_column}`").alias("_id"), F.col(f"`{text_column}`").cast("string").alias("_text"))

    def run(batches):
        if key not in _sent:
            _sent.clear()
            _sent[key] = sent.value
        for batch in batches:
            data, offsets = text_buffers(batch.column(1))
            found = [scores(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], _sent[key], bits) for lo, hi in chunks(offsets, CHUNK)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate(found) if found else np.zeros(0), pa.float64())], ["_id", "score"])

    return source.mapInArrow(run, f"_id {source.schema['_id'].dataType.simpleString()}, score double").withColumnRenamed("_id", id_column)


def query(spark, sf_dir):
    """op6_quality."""
    from tidemark.llm.shared import table

    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    weights = fit(labelled(docs, labels.filter(fold("doc_id", 5) != 0), "quality", SAMPLE))
    return score(docs, weights).select("doc_id", (fold("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
