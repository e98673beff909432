"""Operator 5: toxicity by a subsequence string-kernel support vector machine with Nystrom landmarks.

A text's words are its tokens between white space, lower-cased and less everything but letters and the
signs that are written for letters (`m0ron`), so
`l.o.s-e*r` is the word it hides; a run of four or more single letters is a word, too. Words longer than
LONG bytes are read in overlapping windows. The kernel of two words sums over their common
subsequences of three bytes, each weighted by DECAY to the power of the stretch it takes in
both, so inserted and left-out characters lower it but little. Landmarks are strings learnt from the
labelled sample; a word's features are the kernels with the landmarks, normalised, of those of its
stretches that are most alike (of a landmark's length, one less, and up to two more), a sentence's
are the largest of its words, and the Nystrom map (the inverse root of the landmarks'
kernel matrix) makes them coordinates of the kernel's space, in which a linear support vector machine
(squared hinge, Newton steps) is trained on sentences: of each toxic document the sentence that scores
highest or those that hold a landmark (a value of FULL or more), of the others all. A document's score is that of its worst sentence, made a
probability by Platt's method on the documents of the sample.

Most words share too few letters with a landmark to be near it; a kernel value is computed only where
a word has three quarters of the landmark's letters, and what a value has over NEAR counts, from 0 to
1, so that many words that are a little near do not add up. One character put inside takes more from
a short landmark's kernel than from a long one's (nearly all of it from one of four letters), so a stretch that is a
landmark with one character put in is normalised by what that costs: its value is 1. All of this is part of the definition of the
features, for training as for scoring.

The sample is bounded: at most SAMPLE labelled documents, those with the smallest hash of the id.

Defined results: null and empty texts have the score of a text without a near word; with no
labelled row, or rows of one class only, every score is 0; repeated rows are each scored; other
columns are not read.
"""

from __future__ import annotations

import math
import re
import uuid
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import hashing
from tidemark.llm.quality import labelled
from tidemark.llm.shared import chunks, fold, text_buffers

SAMPLE, LANDMARKS, LONG, CHUNK = 4000, 64, 32, 1 << 22
STRETCHES = (-1, 2)
ORDER, DECAY, NEAR, SHARE, RIDGE, SPELLED, FULL, FAIR, PUT_IN = 3, 0.8, 0.6, 0.75, 1e-3, 4, 0.9, 0.6, 0.2
#: Digits and signs that are written for letters.
_WRITTEN = {ord("0"): ord("o"), ord("1"): ord("i"), ord("3"): ord("e"), ord("4"): ord("a"), ord("5"): ord("s"), ord("7"): ord("t"), ord("@"): ord("a"), ord("$"): ord("s")}
_LETTER = np.array([c + 32 if 65 <= c <= 90 else c if c >= 128 or 97 <= c <= 122 else _WRITTEN.get(c, 0) for c in range(256)], np.uint8)
_KEEP = (_LETTER > 0) | np.array([c == 32 or 9 <= c <= 13 for c in range(256)])
_BIT = np.array([np.uint64(1) << np.uint64(c % 64 if c >= 128 else c & 31) for c in range(256)], np.uint64)
_STOP = re.compile(rb"[.!?](?=\s)|\n")
_sent: dict = {}


def kernels(words: np.ndarray, others: np.ndarray) -> np.ndarray:
    """Subsequence kernel of each row of words with the row of others (bytes)."""
    n, width, height = len(words), words.shape[1], others.shape[1]
    x, y = np.ascontiguousarray(words.T), np.ascontiguousarray(others.T)
    match = [[(y[a] == x[b]).astype(np.float32) for b in range(width)] for a in range(height)]
    step, decay = np.float32(DECAY * DECAY), np.float32(DECAY)
    d = [[m * step for m in row] for row in match]
    for _ in range(ORDER - 1):
        s = [[None] * width for _ in range(height)]
        for a in range(height):
            for b in range(width):
                v = d[a][b].copy()
                if a:
                    v += decay * s[a - 1][b]
                if b:
                    v += decay * s[a][b - 1]
                if a and b:
                    v -= step * s[a - 1][b - 1]
                s[a][b] = v
        none = np.zeros(n, np.float32)
        d = [[match[a][b] * (step * s[a - 1][b - 1]) if a and b else none for b in range(width)] for a in range(height)]
    return sum(sum(row) for row in d)


def alike(words: np.ndarray, z: bytes) -> np.ndarray:
    """The kernel of each row of words with z over the root of the product of their own."""
    if words.shape[1] < ORDER or len(z) < ORDER:
        return np.zeros(len(words))
    other = np.broadcast_to(np.frombuffer(z, np.uint8), (len(words), len(z)))
    own = float(kernels(other[:1], other[:1])[0])
    return kernels(words, other) / np.sqrt(np.maximum(kernels(words, words) * own, 1e-30))


def word_rows(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of all words of the texts: text, sentence, number of the distinct word; and the distinct words as rows of bytes."""
    raw = data.tobytes()
    stops = np.fromiter((m.start() for m in _STOP.finditer(raw)), np.int64)
    kept = _KEEP[data]
    places = np.flatnonzero(kept)
    data, offsets = data[kept], np.r_[0, np.cumsum(kept)][offsets]
    s, e, text, h = hashing.words(data, offsets, _LETTER)
    sentence = np.searchsorted(stops, places[s]) if len(s) else s
    folded = _LETTER[data]
    if len(s) and (e - s).max() > LONG:
        # Windows of LONG bytes, half a window apart.
        parts = np.maximum(1, -(-(e - s - LONG) // (LONG // 2)) + 1)
        row = np.repeat(np.arange(len(s)), parts)
        k = np.arange(len(row)) - np.repeat(np.cumsum(parts) - parts, parts)
        s2 = s[row] + k * (LONG // 2)
        e, s, text, sentence, h = np.minimum(e[row], s2 + LONG), s2, text[row], sentence[row], hashing.mix(h[row] + k.astype(np.uint64))
    _, first, number = np.unique(h, return_index=True, return_inverse=True)
    length = (e - s)[first]
    rows = np.zeros((len(first), LONG), np.uint8)
    at = s[first][:, None] + np.arange(LONG)[None, :]
    inside = np.arange(LONG)[None, :] < length[:, None]
    rows[inside] = folded[np.minimum(at, max(0, len(folded) - 1))][inside] if len(folded) else 0
    # Runs of single letters, a word spelled with blanks.
    single = (e - s == 1) if len(s) else np.zeros(0, bool)
    if single.sum() >= SPELLED:
        edge = np.flatnonzero(np.r_[True, (single[1:] != single[:-1]) | (text[1:] != text[:-1])])
        ends = np.r_[edge[1:], len(single)]
        spelled = [(a, folded[s[a:b]].tobytes()) for a, b in zip(edge, ends, strict=True) if single[a] and b - a >= SPELLED]
        spelled = [(a, w[i : i + LONG]) for a, w in spelled for i in range(0, max(1, len(w) - LONG // 2), LONG // 2)]
        if spelled:
            more = np.zeros((len(spelled), LONG), np.uint8)
            for i, (_, w) in enumerate(spelled):
                more[i, : len(w)] = np.frombuffer(w, np.uint8)
            where = np.array([a for a, _ in spelled])
            text, sentence = np.r_[text, text[where]], np.r_[sentence, sentence[where]]
            number, rows = np.r_[number, len(rows) + np.arange(len(spelled))], np.r_[rows, more]
    return text, sentence, number, rows


def put_in(stretch: np.ndarray, z: bytes) -> np.ndarray:
    """Whether each row is z with one character, of one byte or two, put inside."""
    whole = np.frombuffer(z, np.uint8)
    more = stretch.shape[1] - len(z)
    if more not in (1, 2):
        return np.zeros(len(stretch), bool)
    before = np.logical_and.accumulate(stretch[:, : len(z)] == whole, axis=1).sum(axis=1)
    after = np.logical_and.accumulate((stretch[:, more:] == whole)[:, ::-1], axis=1).sum(axis=1)
    found = (before > 0) & (after > 0) & (before + after >= len(z))
    if more == 2:
        i = np.arange(len(stretch))
        lead, rest = stretch[i, np.minimum(before, len(z))], stretch[i, np.minimum(before, len(z)) + 1]
        found &= (lead >= 0xC2) & (lead < 0xE0) & (rest >= 0x80) & (rest < 0xC0)
    return found


def near(rows: np.ndarray, landmarks: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, landmark, value) of words near a landmark; a word's kernel is that of its stretch that is most alike."""
    bits = np.where(rows > 0, _BIT[rows], np.uint64(0))
    masks = np.bitwise_or.reduce(bits, axis=1) if len(rows) else np.zeros(0, np.uint64)
    length = (rows > 0).sum(axis=1)
    found = []
    for j, z in enumerate(landmarks):
        mask = np.bitwise_or.reduce(_BIT[np.frombuffer(z, np.uint8)])
        need = math.ceil(SHARE * int(np.bitwise_count(mask)))
        some = np.flatnonzero((np.bitwise_count(masks & mask) >= need) & (length >= len(z) + STRETCHES[0]))
        best = np.zeros(len(some))
        for more in range(STRETCHES[0], STRETCHES[1] + 1):
            size = len(z) + more
            if size > rows.shape[1] or not len(some):
                continue
            part = np.bitwise_or.reduce(np.lib.stride_tricks.sliding_window_view(bits[some], size, axis=1), axis=2)
            inside = np.arange(part.shape[1])[None, :] + size <= length[some][:, None]
            i, at = np.nonzero(inside & (np.bitwise_count(part & mask) >= need))
            if len(i):
                stretch = rows[some[i][:, None], at[:, None] + np.arange(size)[None, :]]
                np.maximum.at(best, i, np.where(put_in(stretch, z), 1.0, alike(stretch, z)))
        hit = best >= NEAR
        found.append((some[hit], np.full(hit.sum(), j), (best[hit] - NEAR) / (1 - NEAR)))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def sentences(data: np.ndarray, offsets: np.ndarray, landmarks: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Text and features of each sentence that has a near word."""
    text, sentence, number, rows = word_rows(data, offsets)
    row, j, value = near(rows, landmarks)
    if not len(row):
        return np.zeros(0, np.int64), np.zeros((0, len(landmarks)))
    hits = np.unique(row)
    place = np.full(len(rows), -1)
    place[hits] = np.arange(len(hits))
    table = np.zeros((len(hits), len(landmarks)))
    table[place[row], j] = value
    at = np.flatnonzero(place[number] >= 0)
    key = text[at] * (int(sentence.max()) + 2) + sentence[at]
    known, which = np.unique(key, return_inverse=True)
    out = np.zeros((len(known), len(landmarks)))
    np.maximum.at(out, which, table[place[number[at]]])
    return known // (int(sentence.max()) + 2), out


def _begins(raw: bytes) -> set[bytes]:
    """Beginnings, of four to ten bytes, of the text's words."""
    _, _, _, rows = word_rows(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
    return {w[:k] for w in (r.tobytes().rstrip(b"\0") for r in rows) for k in range(4, min(len(w), 10) + 1)}


def find_landmarks(raw: list[bytes], labels: list[int], most: int = LANDMARKS) -> list[bytes]:
    """Strings that begin words of many toxic documents and hardly any others, by greedy weighted cover of the toxic documents.

    Only beginnings that enough toxic documents share are looked for in the clean ones."""
    where: dict[bytes, list[int]] = {}
    for i, (r, y) in enumerate(zip(raw, labels, strict=True)):
        if y:
            for x in _begins(r):
                where.setdefault(x, []).append(i)
    least = max(4, sum(labels) // 25)
    where = {x: set(v) for x, v in where.items() if len(v) >= least}
    clean = Counter(x for r, y in zip(raw, labels, strict=True) if not y for x in _begins(r) & where.keys())
    where = {x: v for x, v in where.items() if clean[x] <= 0.02 * len(v)}
    # A document counts half as much each time it is covered, so that strings which stand beside others are found, too.
    left, out = dict.fromkeys((i for i, y in enumerate(labels) if y), 1.0), []
    while where and len(out) < most:
        best = max(where, key=lambda x: (sum(left[i] for i in where[x]), len(x), x))
        if sum(left[i] for i in where[best]) < 2:
            break
        # Of strings that begin with each other and cover the same documents the longest is the word itself.
        same = [x for x in where if x.startswith(best) and len(where[x]) >= 0.9 * len(where[best])]
        word = max(same, key=len)
        out.append(word)
        for i in where[best]:
            left[i] /= 2
        where = {x: v for x, v in where.items() if not x.startswith(best) and not best.startswith(x)}
    return out


class Model:
    """Landmarks, Nystrom map, hyperplane and Platt's two numbers."""

    def __init__(self, landmarks: list[bytes], root: np.ndarray, plane: np.ndarray, bias: float, platt: tuple[float, float]):
        self.landmarks, self.root, self.plane, self.bias, self.platt = landmarks, root, plane, bias, platt

    def margins(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        out = np.full(len(offsets) - 1, self.bias)
        if self.landmarks and len(data):
            text, x = sentences(data, offsets, self.landmarks)
            np.maximum.at(out, text, x @ self.root @ self.plane + self.bias)
        return out

    def scores(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        a, b = self.platt
        return 1 / (1 + np.exp(-np.clip(a * self.margins(data, offsets) + b, -35, 35)))


def svm(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = RIDGE) -> tuple[np.ndarray, float]:
    """Linear machine with squared hinge loss by Newton steps on the support vectors; y is -1 or 1."""
    x1 = np.c_[x, np.ones(len(x))]
    w = np.zeros(x1.shape[1])

    def loss(v: np.ndarray) -> float:
        return float(weight @ np.maximum(0, 1 - y * (x1 @ v)) ** 2 + ridge * v @ v)

    for _ in range(200):
        on = y * (x1 @ w) < 1
        h = (x1[on] * weight[on, None]).T @ x1[on] + ridge * np.eye(len(w))
        step, now = np.linalg.solve(h, x1[on].T @ (weight[on] * y[on])) - w, loss(w)
        size = 1.0
        while size > 1e-6 and loss(w + size * step) > now - 1e-12:
            size /= 2
        if size <= 1e-6:
            break
        w = w + size * step
    return w[:-1], float(w[-1])


def platt(margin: np.ndarray, label: np.ndarray) -> tuple[float, float]:
    """Logistic regression of the label on the margin, with targets drawn in a little."""
    n1, n0 = label.sum(), (1 - label).sum()
    target = np.where(label == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    x, w = np.c_[margin, np.ones(len(margin))], np.array([1.0, 0.0])
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -35, 35)))
        step = np.linalg.solve((x * (p * (1 - p) + 1e-9)[:, None]).T @ x + 1e-6 * np.eye(2), x.T @ (p - target))
        w -= step * min(1.0, 5.0 / max(1e-9, np.abs(step).max()))
    return float(w[0]), float(w[1])


def fit(rows: list[tuple[str, int]], most: int = LANDMARKS) -> Model:
    labels = np.array([y for _, y in rows])
    nothing = Model([], np.zeros((0, 0)), np.zeros(0), 0.0, (0.0, -35.0))
    if len(set(labels.tolist())) < 2:
        return nothing
    raw = [t.encode() for t, _ in rows]
    landmarks = find_landmarks(raw, labels.tolist(), most)
    if not landmarks:
        return nothing
    gram = np.array([[float(alike(np.frombuffer(a, np.uint8)[None, :], b)[0]) for b in landmarks] for a in landmarks])
    value, vector = np.linalg.eigh((gram + gram.T) / 2)
    root = vector @ np.diag(1 / np.sqrt(np.maximum(value, 1e-2))) @ vector.T
    at, xs = [], []
    for i in range(0, len(raw), 500):
        part = raw[i : i + 500]
        text, x = sentences(np.frombuffer(b"".join(part), np.uint8), np.cumsum([0, *map(len, part)]), landmarks)
        at.append(text + i)
        xs.append(x @ root)
    at, x = np.concatenate(at), np.concatenate(xs)
    bad = labels[at] == 1
    raw_x = x @ np.linalg.inv(root)
    full = (raw_x >= FULL).any(axis=1)
    # Of a toxic document: the sentences that hold a landmark, or else the one that scores highest, if it is fairly near.
    whole = np.zeros(len(rows), bool)
    whole[at[full]] = True
    spare = bad & ~whole[at] & (raw_x.max(axis=1) >= FAIR)
    score = raw_x.max(axis=1)
    # Landmarks with a foreign letter put in are toxic, too, whether or not the sample has them.
    foreign = [z[:i] + b"x" + z[i:] for z in landmarks for i in range(1, len(z))]
    made = np.zeros((len(foreign), LONG), np.uint8)
    for i, z in enumerate(foreign):
        made[i, : min(LONG, len(z))] = np.frombuffer(z[:LONG], np.uint8)
    row, j, value = near(made, landmarks)
    spelt = np.zeros((len(foreign), len(landmarks)))
    spelt[row, j] = value
    spelt = spelt[spelt.max(axis=1) > 0] @ root
    # One sentence without a near word stands for all such sentences of clean documents.
    zero, many = np.zeros((1, x.shape[1])), float((labels == 0).sum())
    for _ in range(4):
        chosen = np.zeros(len(at), bool)
        order = np.lexsort((score, at))
        chosen[order[np.r_[at[order][1:] != at[order][:-1], True]]] = True
        use = ~bad | full | (spare & chosen)
        y = np.where(bad[use], 1.0, -1.0)
        weight = np.where(y > 0, many / max(1, (y > 0).sum()), many / max(1, (y < 0).sum()))
        plane, bias = svm(np.r_[x[use], spelt, zero], np.r_[y, np.ones(len(spelt)), -1.0], np.r_[weight, np.full(len(spelt), PUT_IN * many / max(1, len(spelt))), many])
        score = x @ plane + bias
    model = Model(landmarks, root, plane, bias, (1.0, 0.0))
    margin = np.full(len(rows), bias)
    np.maximum.at(margin, at, score)
    model.platt = platt(margin, labels)
    return model


def score(docs: DataFrame, model: Model, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Each row's id and score. The model's size is bound by the number of landmarks."""
    sent, key = docs.sparkSession.sparkContext.broadcast(model), uuid.uuid4().hex
    source = docs.select(F.col(f"`{id_column}`").alias("_id"), F.col(f"`{text_column}`").cast("string").alias("_text"))

    def run(batches):
        if key not in _sent:
            _sent.clear()
            _sent[key] = sent.value
        for batch in batches:
            data, offsets = text_buffers(batch.column(1))
            found = [_sent[key].scores(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]) for lo, hi in chunks(offsets, CHUNK)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate(found) if found else np.zeros(0), pa.float64())], ["_id", "score"])

    return source.mapInArrow(run, f"_id {source.schema['_id'].dataType.simpleString()}, score double").withColumnRenamed("_id", id_column)


def query(spark, sf_dir):
    """op5_toxicity."""
    from tidemark.llm.shared import table

    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = fit(labelled(docs, labels.filter(fold("doc_id", 3) != 1), "toxic", SAMPLE))
    return score(docs, model).select("doc_id", (fold("doc_id", 3) == 1).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))
