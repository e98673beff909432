"""Sharding, language ID and decontamination against brute force, and edge cases."""

import random
import re
import zlib
from collections import Counter

import pytest

from tidemark.llm import decontamination, language, sharding


def ring_by_hand(counts, homes, n):
    """Row by row: homes first, in ring order, then the rest clockwise."""
    total = sum(counts.values())
    room = [total // n + (s < total % n) for s in range(n)]
    out, late = Counter(), []
    for cell in sorted(counts):
        for _ in range(counts[cell]):
            if room[homes[cell]]:
                room[homes[cell]] -= 1
                out[cell, homes[cell]] += 1
            else:
                late.append(cell)
    for cell in late:
        at = (cell + 1) % len(homes)
        while not room[homes[at]]:
            at = (at + 1) % len(homes)
        room[homes[at]] -= 1
        out[cell, homes[at]] += 1
    return out


def test_plan_against_row_by_row():
    rng = random.Random(1)
    for _ in range(20):
        n = rng.randrange(1, 6)
        _, homes = sharding.ring(n, 4)
        counts = {c: rng.randrange(1, 9) for c in rng.sample(range(len(homes)), 20)}
        got = Counter()
        for cell, lo, hi, shard, _ in sharding.lay_out(counts, homes, n):
            got[cell, shard] += hi - lo
        assert got == ring_by_hand(counts, homes, n)


def test_shards(spark):
    docs = [(i, "x" * (i % 50)) for i in range(401)] + [(7, "twice"), (7, "twice"), (None, None), (None, "é")]
    df = spark.createDataFrame([(i, t, -1) for i, t in docs], "doc_id long, text string, shard int")
    rows = sharding.assign(df, 8, 16).collect()
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in rows) == Counter((i, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t in docs)
    load = Counter(r["shard"] for r in rows)
    assert len(load) == 8 and max(load.values()) - min(load.values()) <= 1
    for s in load:
        assert sorted(r["slot"] for r in rows if r["shard"] == s) == list(range(load[s]))
    assert sum(r["shard"] != r["home_shard"] for r in rows) < 0.3 * len(rows)
    assert sharding.assign(df.limit(0), 8, 16).count() == 0


WORD = re.compile(rb"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def brute(docs, items):
    words = lambda t: WORD.findall(re.sub(rb"[A-Z]", lambda m: m[0].lower(), (t or "").encode()))
    out = []
    for i, t in docs:
        w, hit, ids = words(t), set(), set()
        for item, text in items:
            x = words(text)
            for g in [x[k : k + 10] for k in range(max(1, len(x) - 9))] if x else []:
                for at in range(len(w) - len(g) + 1):
                    if w[at : at + len(g)] == g:
                        hit.update(range(at, at + len(g)))
                        ids.add(item)
        out.append((str(i), len(w), len(hit), tuple(sorted(map(str, ids)))))
    return sorted(out)


@pytest.mark.parametrize("block", [1 << 20, 60])
def test_windows_against_brute_force(spark, block):
    rng = random.Random(4)
    pool = ["alpha", "Beta", "GAMMA", "é9", "d", "日本"]
    items = [(n, " ".join(rng.choice(pool) for _ in range(rng.choice([1, 3, 9, 10, 14])))) for n in range(6)] + [(50, None), (51, "!?"), (0, "alpha alpha d")]
    docs = [(i, rng.choice([" ", ", ", "\n"]).join(rng.choice([*pool, items[rng.randrange(6)][1]]) for _ in range(rng.randrange(25)))) for i in range(40)]
    docs += [(100, None), (101, ""), (3, docs[3][1]), (3, "other"), (None, "alpha alpha D")]
    df = spark.createDataFrame([(i, t, "x") for i, t in docs], "doc_id long, text string, items string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    rows = decontamination.find(df, bench, block_bytes=block).collect()
    got = sorted((str(r["doc_id"]), r["n_words"], sum(x["hi"] - x["lo"] for x in r["runs"]), tuple(r["items"])) for r in rows)
    assert got == brute(docs, items)
    texts = dict(docs[:40])
    for r in rows:
        for s in r["spans"]:
            if r["doc_id"] in texts and r["doc_id"] != 3:
                part = texts[r["doc_id"]][s["lo"] : s["hi"]]
                assert part and part[0].isalnum() and part[-1].isalnum()
    assert decontamination.find(df, bench.limit(0)).filter("size(runs) > 0").count() == 0
    assert decontamination.find(df.limit(0), bench).count() == 0


def test_language_held_out(spark):
    rng = random.Random(3)
    sounds = {"aa": ["ka", "lo", "mi", "tu", "ren"], "bb": ["schö", "ung", "heit", "ver", "ich"], "cc": ["ció", "mente", "que", "ñar", "los"]}
    make = lambda lang, n: " ".join("".join(rng.choice(sounds[lang]) for _ in range(rng.randrange(1, 4))) for _ in range(n))
    train = spark.createDataFrame([(i, make(lang, 60), lang) for i, lang in enumerate(list(sounds) * 30)] + [(999, None, "aa"), (998, "no name", None)], "doc_id long, text string, lang string")
    raw = language.dictionaries(train)
    assert set(raw) == set(sounds)
    tests = [(i, make(lang, rng.choice([8, 40])), lang) for i, lang in enumerate(list(sounds) * 20)]
    odd = [(500, None, None), (501, "", None), (502, "123 !?", None), (None, make("bb", 30), "bb")]
    df = spark.createDataFrame([(i, t, x, 1.0) for i, t, x in tests + odd], "doc_id long, text string, lang string, score double")
    rows = language.classify(df, raw, ["doc_id", "lang", "score"]).collect()
    assert len(rows) == len(tests) + len(odd)
    assert sum(r["lang_pred"] == r["lang"] for r in rows if r["lang"]) >= 0.97 * (len(tests) + 1)
    assert all(r["lang_pred"] == "und" and r["rejected"] for r in rows if r["lang"] is None)
    odd = spark.createDataFrame([(1, "² ½ ①"), (2, "Ⅷ 12 _ !"), (3, None), (4, ""), (5, "é")], "doc_id long, text string")
    assert [r["lang_pred"] == "und" for r in language.classify(odd, raw, ["doc_id"]).orderBy("doc_id").collect()] == [True] * 4 + [False]
    assert language.classify(odd.limit(0), raw, ["doc_id"]).count() == 0
    assert language.dictionaries(train.limit(0)) == {}
    assert {r["lang_pred"] for r in language.classify(df, {}, ["doc_id"]).collect()} == {"und"}


def test_every_part_of_a_long_text_counts():
    rng = random.Random(6)

    def words(letters):
        known = ["".join(rng.choice(letters) for _ in range(rng.randrange(3, 9))) for _ in range(3000)]
        return lambda size: " ".join(rng.choice(known) for _ in range(size // 6 + 1))[:size]

    a, b = words("abcdefghijklm"), words("nopqrstuvwxyz")
    classify = language.Classifier({"aa": a(1 << 17).encode(), "bb": b(1 << 17).encode()})
    assert classify(a(300_000) + " " + b(1_500_000))[0] == "bb"
    assert classify(b(300_000) + " " + a(1_500_000))[0] == "aa"
