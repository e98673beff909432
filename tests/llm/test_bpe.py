"""BPE against the tokenizers library."""

import random

import numpy as np
import pytest
from tokenizers import Tokenizer

from tidemark.llm import bpe

PATH = bpe.vocabulary_path()
PARTS = ["<|endoftext|>", "'s", "'re", " ", "  ", "\n", "é", "日", "a", "Zebra", "99", "!", "\x00", "​", "😀", "<|", "\x85", "\x1c", "՘", "　", " the", "thing"]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def texts(n, seed=1):
    rng = random.Random(seed)
    return ["".join(rng.choice(PARTS) for _ in range(rng.randrange(30))) for _ in range(n)]


def test_words_agree_on_all_characters_that_are_split_here(library):
    s = bpe._loaded(PATH)
    known = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000 and not s["odd"](chr(c))]
    text = "".join(f"\na{c}1{c}{c} {c}!{c}" for c in known)
    assert [text[a:b] for _, (a, b) in library.pre_tokenizer.pre_tokenize_str(text)] == s["words"](text)


def test_against_the_library(spark, library):
    rows = [(i, t, "x") for i, t in enumerate(texts(200))] + [(500, None, "x"), (501, "", "x"), (502, "long word " * 20000, "x"), (500, "again", "x"), (None, "no id", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string").repartition(3)
    got = sorted((str(r["doc_id"]), r["n_tokens"], np.frombuffer(bytes(r["ids"]), "<u4").tolist(), r["decoded"]) for r in bpe.encode(df, block_chars=500).collect())
    want = []
    for i, t, _ in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids
        want.append((str(i), len(ids), ids, library.decode(ids, skip_special_tokens=False)))
    assert got == sorted(want)


def test_empty_table(spark):
    assert bpe.encode(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_decode_by_join(spark, library):
    rows = [(i, library.encode(t, add_special_tokens=False).ids) for i, t in enumerate(texts(40, 2))] + [(90, None), (91, [])]
    got = {r["doc_id"]: r["decoded"] for r in bpe.decode(spark.createDataFrame(rows, "doc_id long, ids array<long>")).collect()}
    assert got == {i: library.decode(ids or [], skip_special_tokens=False) for i, ids in rows}
