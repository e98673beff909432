"""Operator 9: language identification by compression with per-language zstandard raw-content dictionaries.

A text is lower-cased, everything but letters becomes a blank, and each language's dictionary is
used to compress it whole, in pieces of PIECE bytes that fit the window beside the dictionary, so that
every byte counts alike; the language with the smallest sum of sizes wins. Blanks put before each piece
make zstandard write a compressed block even for a few words, so that sizes of short texts can
differ. Where the two smallest sizes are within NARROW bytes (or half a percent), two more parsers
compress the text, one with three-byte matches, and the sums of the sizes decide. The score is a softmax
over sizes; a text with enough letters whose score stays below REJECT is rejected, as is a text
that is null or has no letter.

Dictionaries come from a documented, bounded sample: for each language SAMPLE documents with the
smallest hash, those of at most LONG bytes first, put together up to DICT_BYTES.

Defined results: null, empty and letterless texts are `und` with score 0 and are rejected; ties of
size go to the language that comes first by name; with no labelled rows everything is `und`;
repeated rows are each classified; other columns are kept by classify() only if asked for.
"""

from __future__ import annotations

import math
import re
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.llm.shared import fold

SAMPLE, LONG, DICT_BYTES, PIECE = 150, 8192, 1 << 17, 1 << 16
NARROW, REJECT, ENOUGH, TEMPERATURE = 3, 0.5, 40, 2.0
_PAD = b" " * 64
_TABLE = bytes(c if c >= 128 or 97 <= c <= 122 else 32 for c in range(256))
#: Letters, and numbers that are no digits (² ½ Ⅷ), which are told from letters one by one.
_LETTER = re.compile(r"[^\W\d_]")
_built: dict = {}


def normalised(text: str) -> bytes:
    return b" " + b" ".join(text.lower().encode().translate(_TABLE).split()) + b" "


def has_letter(text: str) -> bool:
    return any(m[0].isalpha() for m in _LETTER.finditer(text))


def dictionaries(docs: DataFrame, sample: int = SAMPLE, dict_bytes: int = DICT_BYTES, id_column: str = "doc_id", text_column: str = "text", lang_column: str = "lang") -> dict[str, bytes]:
    """Raw content for each language, from the rows of docs that have a language and a text."""
    named = docs.select(F.col(id_column).alias("_id"), F.col(text_column).cast("string").alias("_text"), F.col(lang_column).cast("string").alias("_lang")).filter("_lang IS NOT NULL")
    counts = {r["_lang"]: r["n"] for r in named.groupBy("_lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not counts:
        return {}
    # Hashes below a bar that leaves about eight times the sample of each language; the window then sees few rows.
    place = F.pmod(F.xxhash64(F.col("_id").cast("string")), F.lit(1 << 30))
    bars = F.create_map(*[F.lit(x) for lang, n in counts.items() for x in (lang, int(min(1.0, 8 * sample / n) * (1 << 30)))])
    order = Window.partitionBy("_lang").orderBy(F.octet_length("_text") > LONG, "_place", "_text")
    few = named.withColumn("_place", place).filter(F.col("_place") < F.element_at(bars, F.col("_lang"))).filter("_text IS NOT NULL")
    found: dict[str, dict[bytes, None]] = {}
    for r in few.withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= sample).orderBy("_lang", "_n").select("_lang", "_text").collect():
        found.setdefault(r["_lang"], {})[normalised(r["_text"])] = None
    return {lang: b"".join(texts)[:dict_bytes] for lang, texts in sorted(found.items())}


class Classifier:
    """Compressors of all languages. Built once in each Python worker."""

    def __init__(self, raw: dict[str, bytes]):
        import zstandard as z

        rest = {"window_log": 18, "hash_log": 16, "chain_log": 16, "write_content_size": 0, "write_checksum": 0, "write_dict_id": 0}
        parsers = (
            {"strategy": z.STRATEGY_GREEDY, "min_match": 4, "search_log": 3},
            {"strategy": z.STRATEGY_DFAST, "min_match": 5},
            {"strategy": z.STRATEGY_BTULTRA2, "min_match": 3, "search_log": 6, "target_length": 64},
        )
        self.langs = sorted(raw)
        self.parsers = []
        for p in parsers:
            params = z.ZstdCompressionParameters(**rest, **p)
            row = []
            for lang in self.langs:
                d = z.ZstdCompressionDict(raw[lang], dict_type=z.DICT_TYPE_RAWCONTENT)
                d.precompute_compress(compression_params=params)
                row.append(z.ZstdCompressor(dict_data=d, compression_params=params))
            self.parsers.append(row)

    def __call__(self, text: str | None) -> tuple[str, float, bool]:
        """Language, score, rejected."""
        if not text or not self.langs or not has_letter(text):
            return "und", 0.0, True
        content = normalised(text)
        pieces = [_PAD + content[i : i + PIECE] for i in range(0, len(content), PIECE)]
        sizes = [sum(len(c.compress(p)) for p in pieces) for c in self.parsers[0]]
        ranked = sorted(sizes)
        n = 1
        if len(ranked) > 1 and ranked[1] - ranked[0] <= NARROW + ranked[0] // 200:
            n = len(self.parsers)
            for row in self.parsers[1:]:
                sizes = [s + sum(len(c.compress(p)) for p in pieces) for s, c in zip(sizes, row, strict=True)]
        best = min(sizes)
        score = 1 / sum(math.exp(max(-700.0, (best - s) / n / TEMPERATURE)) for s in sizes)
        return self.langs[sizes.index(best)], score, score < REJECT and len(content) >= ENOUGH


def classify(docs: DataFrame, raw: dict[str, bytes], keep: list[str], text_column: str = "text") -> DataFrame:
    """The columns of keep, and lang_pred, score, rejected. The dictionaries' size is bound by DICT_BYTES for each language."""
    sent, key = docs.sparkSession.sparkContext.broadcast(raw), uuid.uuid4().hex
    # Positions, not names: any column of the input may be called like one of the new ones.
    fields = [docs.schema[c] for c in keep]
    inner = docs.select(*[F.col(f"`{c}`").alias(f"_{i}") for i, c in enumerate(keep)], F.col(f"`{text_column}`").cast("string").alias("_text"))
    kind = ", ".join([f"_{i} {f.dataType.simpleString()}" for i, f in enumerate(fields)] + ["_pred string, _score double, _rejected boolean"])
    names = [f"_{i}" for i in range(len(keep))] + ["_pred", "_score", "_rejected"]

    def run(batches):
        if key not in _built:
            _built.clear()
            _built[key] = Classifier(sent.value)
        classifier = _built[key]
        for batch in batches:
            found = [classifier(t.as_py()) for t in batch.column(len(keep))]
            new = [pa.array([x[i] for x in found], k) for i, k in enumerate((pa.string(), pa.float64(), pa.bool_()))]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], *new], names)

    out = inner.mapInArrow(run, kind)
    return out.select(*[F.col(f"_{i}").alias(c) for i, c in enumerate(keep)], F.col("_pred").alias("lang_pred"), F.col("_score").alias("score"), F.col("_rejected").alias("rejected"))


def query(spark, sf_dir):
    """op9_language."""
    from tidemark.llm.shared import table

    docs = table(spark, sf_dir, "documents")
    raw = dictionaries(docs.filter(fold("doc_id", 3) != 1))
    return classify(docs, raw, ["doc_id"]).select("doc_id", (fold("doc_id", 3) == 1).alias("held_out"), "lang_pred", "score", "rejected")
