"""Language-model scoring against counting in Python."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from tidemark.llm import scoring
from tidemark.llm.shared import fold


def brute(docs):
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 10 == 0
    toks = [re.findall(rb"[^\x20\x09-\x0d]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (t or "").encode())) + [None] for _, t in docs]
    c, pairs = Counter(), Counter()
    for (i, _), ws in zip(docs, toks, strict=True):
        if not held(i):
            c.update(ws)
            pairs.update(zip([None, *ws[:-1]], ws, strict=True))
    n, v, d, m = sum(c.values()), len(c), scoring.DISCOUNT, scoring.PRIOR
    p1 = lambda w: (c[w] - d) / n if c[w] else (d * v / n if n else 1.0)
    out = []
    for (i, _), ws in zip(docs, toks, strict=True):
        base = sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in ws)
        full = sum(math.log10((pairs[h, w] + m * p1(w)) / (c[h] + m)) for h, w in zip([None, *ws[:-1]], ws, strict=True))
        out.append((str(i), held(i), len(ws), sum(c[w] > 0 for w in ws), n, base, full))
    return sorted(out)


def corpus():
    rng = random.Random(1)
    words = ["the", "The", "of", "é", "x!", "\x00", "日本", "end"] + [f"w{i}" for i in range(40)]
    docs = [(i, rng.choice([" ", "\n", "\t "]).join(rng.choice(words) for _ in range(rng.randrange(30)))) for i in range(120)]
    return docs + [(500, None), (501, ""), (502, "the of " * 3000), (3, "again w1"), (None, "no id")]


@pytest.mark.parametrize("block", [300, 10_000_000])
def test_against_brute_force(spark, block):
    docs = corpus()
    df = spark.createDataFrame([(i, t, 0.0) for i, t in docs], "doc_id long, text string, score double").repartition(3)
    got = sorted((str(r["doc_id"]), r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"], r["score"]) for r in scoring.score(df, fold("doc_id", 10) != 0, block_bytes=block).collect())
    for g, w in zip(got, brute(docs), strict=True):
        assert g[:5] == w[:5]
        assert g[5:] == pytest.approx(w[5:], rel=1e-9)


def test_empty_table(spark):
    assert scoring.score(spark.createDataFrame([], "doc_id long, text string"), fold("doc_id", 10) != 0).count() == 0


def test_totals_over_32_bits():
    key = np.array([7], np.uint64)
    count = scoring._planes(np.array([3_000_000_000], np.uint32))
    payload = scoring._pack(b"p", scoring._planes8(key), count, scoring._planes8(scoring._gaps(key)), count)
    lists = pa.RecordBatch.from_pylist([{"block": i, "bucket": 0, "payload": payload, "tokens": 1} for i in range(2)])
    for batch in scoring._totals(1)([lists]):
        _, single, pair = scoring._unpack(batch.column(scoring._SCHEMA.names.index("payload"))[0].as_py(), 3)
        assert scoring._whole8(single).tolist() == scoring._whole8(pair).tolist() == [6_000_000_000]
