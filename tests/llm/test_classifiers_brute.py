"""Quality, toxicity and language scores against second, plain computations of the same definitions, and edge cases of labels and texts."""

import math
import random
import re

import numpy as np
import pytest
import zstandard

from test_quality_toxicity import brute_kernel, corpus
from tidemark.llm import hashing, language, quality, toxicity

M = (1 << 64) - 1


def mix(x):
    return int(hashing.mix(np.array([x & M], np.uint64))[0])


def token_hash(raw, table):
    return int(hashing.words(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]), table)[3][0])


def quality_cells(text, bits):
    """(cell, value) of singles, pairs and triples, by the docstring."""
    tokens, shapes = [], []
    for m in re.finditer(rb"[A-Za-z0-9\x80-\xff]+|[!-/:-@\[-`{-~]+", (text or "").encode()):
        raw = m[0]
        if re.match(rb"[A-Za-z0-9\x80-\xff]", raw):
            upper, lower, digit = (len(re.findall(p, raw)) for p in (rb"[A-Z]", rb"[a-z]", rb"[0-9]"))
            shape = 4 if digit else 1 if not upper else 2 if lower or upper == 1 else 3
            tokens.append(token_hash(raw, hashing.ALNUM))
        else:
            shape = token_hash(raw, quality._OTHER)
            tokens.append(shape ^ int(hashing.GOLD))
        shapes.append(mix(shape))
    out = []
    for size, what in ((1, tokens), (2, tokens), (3, shapes)):
        keys = []
        for i in range(len(what) - size + 1):
            key = what[i] if size == 1 else 0
            for k in range(size if size > 1 else 0):
                key = mix(key + what[i + k] + size)
            keys.append(0 if size == 2 and what[i] == what[i + 1] else key)
        counts = {}
        for key in keys:
            counts[key >> (64 - bits)] = counts.get(key >> (64 - bits), 0) + 1
        out += [(c, quality.SCALE * n / len(keys)) for c, n in sorted(counts.items())]
    return out


def test_quality_weights_and_scores(spark):
    rows = [(t, q) for _, t, q, _ in corpus(4, 60)]
    bits, z, n = 12, {}, {}
    weight = lambda c: 0.0 if abs(z.get(c, 0.0)) <= quality.L1 else -(z[c] - math.copysign(quality.L1, z[c])) / ((quality.BETA + math.sqrt(n[c])) / quality.RATE + quality.L2)
    xs, order = [[*quality_cells(t, bits), ("bias", 1.0)] for t, _ in rows], np.random.default_rng(0)
    for _ in range(2):
        for i in order.permutation(len(rows)):
            w = [weight(c) for c, _ in xs[i]]
            p = 1 / (1 + math.exp(-sum(a * v for a, (_, v) in zip(w, xs[i], strict=True))))
            steps = [((p - rows[i][1]) * v, n.get(c, 0.0)) for c, v in xs[i]]
            for (c, _), a, (g, before) in zip(xs[i], w, steps, strict=True):
                z[c] = z.get(c, 0.0) + g - (math.sqrt(before + g * g) - math.sqrt(before)) / quality.RATE * a
                n[c] = n.get(c, 0.0) + g * g
    got = quality.fit(rows, bits, 2)
    for c in z:
        assert got[-1 if c == "bias" else c] == pytest.approx(weight(c), abs=1e-5)
    texts = [t for t, _ in rows[:10]] + [None, "", "Ünï 12x A!! a a a", "word " * 20_000]
    df = spark.createDataFrame([(i, t, 0.5) for i, t in enumerate(texts)], "doc_id long, text string, score double")
    for r in quality.score(df, got, bits=bits).collect():
        total = sum(float(got[c]) * v for c, v in quality_cells(texts[r["doc_id"]], bits)) + float(got[-1])
        assert r["score"] == pytest.approx(1 / (1 + math.exp(-total)), abs=1e-4)


def plain_margin(model, text):
    """The machine's margin of a text of one sentence in small letters."""
    x = [0.0] * len(model.landmarks)
    bit = lambda raw: np.bitwise_or.reduce(toxicity._BIT[np.frombuffer(raw, np.uint8)]) if raw else np.uint64(0)
    for word in text.encode().split():
        for j, z in enumerate(model.landmarks):
            mask, best = bit(z), 0.0
            need = math.ceil(toxicity.SHARE * int(np.bitwise_count(mask)))
            for size in range(len(z) + toxicity.STRETCHES[0], len(z) + toxicity.STRETCHES[1] + 1):
                for i in range(len(word) - size + 1):
                    s = word[i : i + size]
                    if np.bitwise_count(bit(s) & mask) < need:
                        continue
                    inside = any(s[:k] + s[k + 1 :] == z for k in range(1, len(s) - 1)) and len(s) == len(z) + 1
                    own = brute_kernel(s, s) * brute_kernel(z, z)
                    best = max(best, 1.0 if inside else brute_kernel(s, z) / math.sqrt(own) if own else 0.0)
            if best >= toxicity.NEAR:
                x[j] = max(x[j], (best - toxicity.NEAR) / (1 - toxicity.NEAR))
    return max(model.bias, float(np.array(x) @ model.root @ model.plane + model.bias)) if any(x) else model.bias


def test_toxicity_margins():
    model = toxicity.fit([(t, y) for _, t, _, y in corpus()])
    assert model.landmarks
    rng = random.Random(9)
    for _ in range(60):
        words = ["".join(rng.choice("abcdeghilmnoprstu") for _ in range(rng.randrange(3, 8))) for _ in range(4)]
        insult = list(rng.choice(["idiot", "worthless", "moron"]))
        for _ in range(rng.randrange(3)):
            insult.insert(rng.randrange(1, len(insult)), rng.choice("xaeo"))
        text = " ".join([*words, "".join(insult)] if rng.random() < 0.7 else words)
        raw = text.encode()
        assert float(model.margins(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))[0]) == pytest.approx(plain_margin(model, text), abs=2e-3), text


def test_language_sizes(spark):
    rng = random.Random(5)
    sounds = {"aa": ["ka", "lo", "mi", "tu"], "bb": ["schö", "ung", "ver", "ich"], "cc": ["ció", "que", "ñar", "los"]}
    make = lambda x, n: " ".join("".join(rng.choice(sounds[x]) for _ in range(rng.randrange(1, 4))) for _ in range(n))
    raw = {x: language.normalised(make(x, 3000)) for x in sounds}
    texts = [make(rng.choice("abc") * 2, rng.choice([1, 2, 5, 30])) for _ in range(40)] + [make("aa", 20_000) + make("bb", 30_000), "A-B 12 c", "²", ""]
    params = [{"strategy": zstandard.STRATEGY_GREEDY, "min_match": 4, "search_log": 3}, {"strategy": zstandard.STRATEGY_DFAST, "min_match": 5}, {"strategy": zstandard.STRATEGY_BTULTRA2, "min_match": 3, "search_log": 6, "target_length": 64}]

    def size(text, x, kind):
        """A fresh compressor for every piece."""
        letters = re.sub(rb"[^a-z\x80-\xff]+", b" ", text.lower().encode()).strip()
        whole, total = b" " + letters + b" ", 0
        for i in range(0, len(whole), language.PIECE):
            p = zstandard.ZstdCompressionParameters(window_log=18, hash_log=16, chain_log=16, write_content_size=0, write_checksum=0, write_dict_id=0, **params[kind])
            d = zstandard.ZstdCompressionDict(raw[x], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(compression_params=p)
            total += len(zstandard.ZstdCompressor(dict_data=d, compression_params=p).compress(b" " * 64 + whole[i : i + language.PIECE]))
        return total

    df = spark.createDataFrame(list(enumerate(texts)) * 2, "doc_id long, text string")
    got = {}
    for r in language.classify(df, raw, ["doc_id"]).collect():
        assert got.setdefault(r["doc_id"], r["lang_pred"]) == r["lang_pred"]
    for i, t in enumerate(texts):
        if not any(c.isalpha() for c in t):
            assert got[i] == "und"
            continue
        sizes = {x: size(t, x, 0) for x in sorted(raw)}
        a, b = sorted(sizes.values())[:2]
        if b - a <= language.NARROW + a // 200:
            sizes = {x: sum(size(t, x, k) for k in range(3)) for x in sorted(raw)}
        assert got[i] == min(sizes, key=lambda x: (sizes[x], x)), t[:80]


def test_labels_that_are_null_repeated_or_contradict(spark):
    docs = spark.createDataFrame([(1, "one"), (1, "one"), (2, None), (None, "no id"), (4, "four")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 0), (1, 1), (2, 1), (None, 1), (4, None), (9, 1)], "doc_id long, quality int")
    assert sorted(quality.labelled(docs, labels, "quality", 10)) == [("", 1), ("one", 1)]
    assert quality.labelled(docs.limit(0), labels, "quality", 10) == [] and quality.labelled(docs, labels.limit(0), "quality", 10) == []
