"""Quality and toxicity: kernels by brute force, held-out accuracy, and edge cases."""

import itertools
import random

import numpy as np
import pytest

from tidemark.llm import quality, toxicity


def corpus(seed=1, n=400):
    rng = random.Random(seed)
    plain = ["".join(rng.choice("abcdeghilmnoprstu") for _ in range(rng.randrange(2, 9))) for _ in range(500)]
    rows = []
    for i in range(n):
        words = [rng.choice(plain) for _ in range(rng.randrange(5, 60))]
        toxic, poor = int(i % 4 == 0), int(i % 5 == 0)
        if toxic:
            words.insert(rng.randrange(len(words)), rng.choice(["idiot", "worthless", "Moron!", "i.d.i.o.t"]))
        if poor:
            words = [w.upper() + "!!" for w in words]
        rows.append((i, " ".join(words) + ".", 1 - poor, toxic))
    return rows


def brute_kernel(a, b):
    def weights(x):
        out = {}
        for at in itertools.combinations(range(len(x)), toxicity.ORDER):
            key = bytes(x[i] for i in at)
            out.setdefault(key, []).append(at[-1] - at[0] + 1)
        return out

    u, v = weights(a), weights(b)
    return sum(toxicity.DECAY ** (p + q) for k in u if k in v for p in u[k] for q in v[k])


def test_kernel_against_brute_force():
    rng = random.Random(2)
    for _ in range(50):
        a, b = (bytes(rng.choice(b"abcd") for _ in range(rng.randrange(3, 8))) for _ in range(2))
        got = float(toxicity.kernels(np.frombuffer(a, np.uint8)[None, :], np.frombuffer(b, np.uint8)[None, :])[0])
        assert got == pytest.approx(brute_kernel(a, b), rel=1e-4, abs=1e-6)


def one(model, text):
    raw = text.encode()
    return float(model.scores(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))[0])


def test_toxicity_held_out_and_hidden_insults():
    rows = corpus()
    model = toxicity.fit([(t, y) for i, t, _, y in rows if i % 3])
    for i, t, _, y in rows:
        if i % 3 == 0:
            assert (one(model, t) >= 0.7) == bool(y), t
    for text in ("such an i-d-i-o-t", "w o r t h l e s s", "m0ron"):
        assert one(model, text) >= 0.7, text
    assert one(model, "worthxless stuff") > 0.5
    assert one(model, "") < 0.5 and one(model, "x" * 5000) < 0.5
    assert one(toxicity.fit([]), "idiot") == pytest.approx(0, abs=1e-9)


def test_quality_held_out():
    rows = corpus(3)
    weights = quality.fit([(t, q) for i, t, q, _ in rows if i % 4])
    for i, t, q, _ in rows:
        if i % 4 == 0:
            raw = t.encode()
            assert (quality.scores(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]), weights)[0] >= 0.3) == bool(q)


def test_queries_score_every_row(spark):
    rows = corpus(5, 60)
    docs = spark.createDataFrame([(i, t, 1.0) for i, t, _, _ in rows] + [(900, None, 1.0), (901, "", 1.0), (0, "again", 1.0), (None, "no id", 1.0)], "doc_id long, text string, score double")
    labels = spark.createDataFrame([(i, q, y) for i, _, q, y in rows] + [(900, None, None), (5000, 1, 1)], "doc_id long, quality int, toxic int")
    for module, label in ((quality, "quality"), (toxicity, "toxic")):
        model = module.fit(module.labelled(docs, labels, label, 50) if module is quality else quality.labelled(docs, labels, label, 50))
        got = module.score(docs, model).collect()
        assert sorted(str(r["doc_id"]) for r in got) == sorted(str(r["doc_id"]) for r in docs.collect())
        assert all(0 <= r["score"] <= 1 for r in got)
        assert module.score(docs.limit(0), model).count() == 0


def test_one_character_put_in_short_insults():
    rng, insults = random.Random(8), ["scum", "moron", "loser", "idiot", "stupid"]
    rows = [(t, y) for _, t, _, y in corpus(8) if not y]
    rows += [(f"{rng.choice(insults)} {t} {rng.choice(insults)}.", 1) for t, _ in rows[:150]]
    model = toxicity.fit(rows)
    for z in insults:
        for i in range(1, len(z)):
            for c in "xé":
                assert one(model, f"such a {z[:i]}{c}{z[i:]} here") >= 0.7, (z, i, c)
    assert sum(one(model, t) >= 0.7 for t, y in rows if not y) == 0
    for text in ("sum", "mor", "lost", "studio", "idol", "smug"):
        assert one(model, text) < 0.7, text
