"""BagMinHash near-dedup against brute force over all pairs."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from tidemark.llm import hashing, minhash

WORD = re.compile(rb"[a-z0-9\x80-\xff]+")


def bag(text, size=5):
    words = WORD.findall(re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))
    if not words:
        return Counter()
    return Counter(tuple(words[i : i + size]) for i in range(max(1, len(words) - size + 1)))


def jaccard(a, b):
    least = sum((a & b).values())
    return least / (sum(a.values()) + sum(b.values()) - least) if a and b else 0.0


def brute(docs, threshold=0.8):
    bags = [bag(t) for _, t in docs]
    root = list(range(len(docs)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(docs)):
        for j in range(i):
            if (docs[i][1] or "") == (docs[j][1] or "") or jaccard(bags[i], bags[j]) >= threshold:
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(docs):
        least[find(i)] = min(least.get(find(i), d), d)
    return {d: least[find(i)] for i, (d, _) in enumerate(docs)}


def corpus(seed, n, far=0.03):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdefé") for _ in range(rng.randrange(1, 7))) for _ in range(300)]
    bases = [[rng.choice(vocabulary) for _ in range(rng.randrange(1, 160))] for _ in range(6)]
    docs = []
    for i in range(n):
        words = list(rng.choice(bases))
        for k in range(len(words)):
            if rng.random() < far * rng.random():
                words[k] = rng.choice(vocabulary) if rng.random() < 0.7 else ""
        docs.append((i, rng.choice([" ", "\n", ", "]).join(words)))
    return docs + [(n, None), (n + 1, ""), (n + 2, "!!"), (n + 3, "!!"), (n + 4, docs[0][1].upper())]


@pytest.mark.parametrize("small", [2, 8])
def test_against_brute_force(spark, monkeypatch, small):
    monkeypatch.setattr(minhash, "SMALL", small)
    monkeypatch.setattr(minhash, "INNER", small)
    monkeypatch.setattr(minhash, "FEW_LINKS", 0 if small == 2 else 1000)
    docs = corpus(small, 90, 0.08)
    df = spark.createDataFrame([(i, t, 1) for i, t in docs], "doc_id long, text string, node int")
    found, _ = minhash.classes(df, broadcast_rows=0 if small == 2 else 1000)
    assert {r["doc_id"]: r["class_id"] for r in found.collect()} == brute(docs)


def test_large_group_of_near_copies(spark, monkeypatch):
    """Most pairs are just under the threshold, nodes are linked in chains, and copies of two bases meet in one bucket."""
    monkeypatch.setattr(minhash, "SMALL", 3)
    monkeypatch.setattr(minhash, "INNER", 3)
    rng = random.Random(5)
    base = [f"w{i}" for i in range(120)]
    other = [f"v{i}" if i % 40 == 7 else w for i, w in enumerate(base)]
    docs = []
    for i in range(160):
        words = list(rng.choice([base, base, other]))
        for _ in range(rng.choice([1, 2, 3, 4, 6, 8])):
            at = rng.randrange(len(words))
            words[at : at + 1] = rng.choice([[f"x{rng.randrange(400)}"], [], [words[at], "the"]])
        docs.append((i, " ".join(words[: rng.choice([len(words), len(words), 100, 90])])))
    found, _ = minhash.classes(spark.createDataFrame(docs, "doc_id long, text string"))
    want = brute(docs)
    assert 10 < len(set(want.values())) < 150
    assert {r["doc_id"]: r["class_id"] for r in found.collect()} == want


def test_words_and_shingles():
    rng = random.Random(3)
    texts = ["".join(rng.choice(["a", "Bc", " ", "!", "é", "\n", "9"]) for _ in range(rng.randrange(40))) for _ in range(300)]
    raw = [t.encode() for t in texts]
    offsets = np.cumsum([0, *map(len, raw)])
    text, _, count = minhash.bags(np.frombuffer(b"".join(raw), np.uint8), offsets)
    for i, t in enumerate(texts):
        assert sorted(count[text == i].tolist()) == sorted(bag(t).values()), t


def test_signatures_agree_as_often_as_bags_are_alike():
    rng = np.random.default_rng(4)
    items = hashing.mix(np.arange(60, dtype=np.uint64))
    for _ in range(5):
        a, b = rng.integers(0, 9, 60), rng.integers(0, 9, 60)
        want = np.minimum(a, b).sum() / np.maximum(a, b).sum()
        text = np.repeat([0, 1], [(a > 0).sum(), (b > 0).sum()])
        both = np.r_[items[a > 0], items[b > 0]], np.r_[a[a > 0], b[b > 0]]
        sig = minhash.signatures(text, *both, 2, 4096)
        assert abs((sig[0] == sig[1]).mean() - want) < 0.04


def test_empty_and_repeated(spark):
    assert minhash.classes(spark.createDataFrame([], "doc_id long, text string"))[0].count() == 0
    df = spark.createDataFrame([(3, "a b c"), (3, "a b c"), (None, "a b c"), (2, "A b, c")], "doc_id long, text string")
    assert sorted(str(r["doc_id"]) + str(r["class_id"]) for r in minhash.classes(df)[0].collect()) == ["22", "32", "32", "None2"]
