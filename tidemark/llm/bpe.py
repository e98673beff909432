"""Operator 2: BPE encoding and decoding through a table of distinct words.

1. Texts are split into pre-tokens ("words") where they lie, in blocks of documents. A block keeps
   its texts as numbers into its own list of distinct words, and lists those words by bucket, a
   hash of the word. The blocks are written once to the shared folder.
2. The lists meet by bucket: a bucket holds every word with that hash from all blocks, so each
   distinct word is encoded once there. A block's list comes back as ids in the list's order.
3. Texts and ids meet by block, and ids are joined to texts by word position. Decoding joins every
   id with the vocabulary's piece (a table of fixed size) and puts the pieces together.

A hot word is once in a block's list however often it occurs, so no key outgrows the number of
blocks, and no task holds more than a block or a bucket. The number of buckets is BUCKETS_A_TASK
times spark.sql.shuffle.partitions.

Special tokens of the vocabulary (`<|endoftext|>`) that stand in a text are one word, one id.

Defined results: null and empty texts have no ids and decode to the empty text; repeated documents
and repeated ids are each encoded; an empty table gives no rows; only id and text are read.
"""

from __future__ import annotations

import json
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.shared import written

BLOCK_CHARS, BUCKETS_A_TASK, OUT_BYTES = 32_000_000, 2, 8_000_000
#: Numbers of the commonest words of a block take one byte; this byte says that a longer one follows in another stream.
_ESCAPE = 255
#: The pre-token pattern of byte-level BPE, with white space as Unicode has it.
_SPACE = r"\t-\r \x85\xa0  -     　"
PATTERN = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{_SPACE}\p{{L}}\p{{N}}]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+"
#: Blocks whose letters, digits and spaces the tokenizer's tables and the regex module's agree on (a test compares them).
#: A text with any other character is split by the tokenizer's own pre-tokenizer.
_AGREED = r"[^\x00-\u0377\u0400-\u052f\u0600-\u06ff\u2000-\u206f\u2190-\u21ff\u3041-\u3096\u30a1-\u30fe\u4e00-\u9fa5\uac00-\ud7a3\U0001f300-\U0001f5ff\U0001f600-\U0001f64f]"
_state: dict = {}


def vocabulary_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _byte_of_char() -> dict[str, int]:
    """Byte-level BPE writes printable bytes as themselves and the others as characters from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    found = {chr(b): b for b in plain}
    for n, b in enumerate(b for b in range(256) if b not in set(plain)):
        found[chr(256 + n)] = b
    return found


def pieces(path: str) -> list[bytes]:
    """The bytes of each id."""
    known = json.loads(open(path, encoding="utf-8").read())
    back = _byte_of_char()
    vocab = dict(known["model"]["vocab"]) | {t["content"]: t["id"] for t in known["added_tokens"]}
    out = [b""] * (max(vocab.values()) + 1)
    for token, i in vocab.items():
        out[i] = bytes(back[c] for c in token)
    return out


def _loaded(path: str) -> dict:
    """Pattern, special tokens, tokenizer and pieces; once in each Python worker."""
    if _state.get("path") != path:
        import re

        import regex
        from tokenizers import Tokenizer

        special = [t["content"] for t in json.loads(open(path, encoding="utf-8").read())["added_tokens"]]
        _state.update(
            path=path, words=regex.compile(PATTERN).findall, special=frozenset(special), split=regex.compile("(" + "|".join(map(regex.escape, special)) + ")").split if special else None, any=special,
            tokenizer=Tokenizer.from_file(path), pieces=pieces(path), odd=re.compile(_AGREED).search,
        )
    return _state


def _plain(text: str, s: dict) -> list[str]:
    if s["odd"](text):
        return [text[a:b] for _, (a, b) in s["tokenizer"].pre_tokenizer.pre_tokenize_str(text)]
    return s["words"](text)


def split(text: str, path: str) -> list[str]:
    """The text's words; together they are the text."""
    s = _loaded(path)
    if not any(t in text for t in s["any"]):
        return _plain(text, s)
    return [w for part in s["split"](text) if part for w in ([part] if part in s["special"] else _plain(part, s))]


def encode_words(words: list[str], path: str) -> list[list[int]]:
    s = _loaded(path)
    return [e.ids for e in s["tokenizer"].encode_batch(words, add_special_tokens=False)]


def _pack(*arrays: np.ndarray | bytes, level: int = 3) -> bytes:
    import zstandard

    parts = [a if isinstance(a, bytes) else a.tobytes() for a in arrays]
    return zstandard.ZstdCompressor(level=level).compress(struct.pack(f"<{len(parts)}q", *map(len, parts)) + b"".join(parts))


def _unpack(data: bytes, n: int) -> list[bytes]:
    import zstandard

    raw = zstandard.ZstdDecompressor().decompress(data)
    sizes = struct.unpack_from(f"<{n}q", raw)
    ends = np.cumsum([8 * n, *sizes])
    return [raw[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]


_BLOCK = pa.schema([("block", pa.int64()), ("bucket", pa.int32()), ("payload", pa.binary())])
_BLOCK_KIND = "block long, bucket int, payload binary"


def _finish(ids: list, texts: list[np.ndarray], numbers: dict[str, int], block: int, buckets: int):
    """Rows of a block: its texts under bucket -1, and its distinct words by bucket."""
    words = list(numbers)
    raw = [w.encode() for w in words]
    bucket = np.fromiter((zlib.crc32(w) % buckets for w in raw), np.int64, len(raw))
    lengths = np.array([len(t) for t in texts], np.uint32)
    # Texts use numbers by falling frequency, most of which fit in a byte; a bucket lists its words in the same order.
    codes = np.concatenate(texts) if texts else np.zeros(0, np.uint32)
    common = np.argsort(-np.bincount(codes, minlength=len(raw)), kind="stable")
    rank = np.empty(len(raw), np.uint32)
    rank[common] = np.arange(len(raw), dtype=np.uint32)
    codes = rank[codes]
    bucket = bucket[common]
    order = np.argsort(bucket, kind="stable")
    low, rest = np.minimum(codes, _ESCAPE).astype(np.uint8), codes[codes >= _ESCAPE]
    known = pa.array([x.as_py() for x in ids], ids[0].type)
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, pa.schema([("id", known.type)])) as w:
        w.write_batch(pa.RecordBatch.from_arrays([known], ["id"]))
    rows = [(block, -1, _pack(sink.getvalue().to_pybytes(), lengths, low, _planes(rest), _planes(bucket.astype(np.uint32)), level=9))]
    bounds = np.searchsorted(bucket[order], np.arange(buckets + 1))
    for b in np.flatnonzero(np.diff(bounds)):
        mine = [raw[i] for i in common[order[bounds[b] : bounds[b + 1]]]]
        rows.append((block, int(b), _pack(np.array([len(w) for w in mine], np.uint32), b"".join(mine))))
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), _BLOCK.types, strict=True)], schema=_BLOCK)


def _blocks(path: str, buckets: int, block_chars: int):
    def run(batches):
        from pyspark import TaskContext

        part, n = TaskContext.get().partitionId(), 0
        ids, texts, numbers, chars = [], [], {}, 0
        for batch in batches:
            for key, text in zip(batch.column(0), batch.column(1), strict=True):
                text = text.as_py() or ""
                words = split(text, path) if text else []
                texts.append(np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), np.uint32, len(words)))
                ids.append(key)
                chars += len(text) + 64
                if chars >= block_chars:
                    yield _finish(ids, texts, numbers, (part << 24) + n, buckets)
                    ids, texts, numbers, chars, n = [], [], {}, 0, n + 1
        if ids:
            yield _finish(ids, texts, numbers, (part << 24) + n, buckets)

    return run


def _encoded(path: str):
    """A bucket's lists one after the other: words seen before in the bucket are not encoded again."""

    def run(batches):
        bucket, known = None, {}
        for batch in batches:
            for row in batch.to_pylist():
                if row["bucket"] != bucket:
                    bucket, known = row["bucket"], {}
                lengths, joined = _unpack(row["payload"], 2)
                ends = np.cumsum(np.frombuffer(lengths, np.uint32).astype(np.int64))
                words = [joined[a:b] for a, b in zip(np.concatenate([[0], ends[:-1]]), ends, strict=True)]
                new = [w for w in words if w not in known]
                for w, ids in zip(new, encode_words([w.decode() for w in new], path), strict=True):
                    known[w] = np.array(ids, np.uint32).tobytes()
                found = [known[w] for w in words]
                ids = np.frombuffer(b"".join(found), np.uint32)
                payload = _pack(np.array([len(x) // 4 for x in found], np.uint32), _planes(ids))
                yield pa.RecordBatch.from_arrays([pa.array([row["block"]], pa.int64()), pa.array([bucket], pa.int32()), pa.array([payload], pa.binary())], schema=_BLOCK)

    return run


def _planes(numbers: np.ndarray) -> np.ndarray:
    """The four bytes of 32-bit numbers in four runs; the high bytes are mostly alike and compress to little."""
    return np.ascontiguousarray(numbers.astype(np.uint32, copy=False).view(np.uint8).reshape(-1, 4).T)


def _whole(planes: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(4, -1).T).reshape(-1).view(np.uint32)


def _joined(path: str, text: bool):
    """Texts of a block come first, then the ids of its words; they are joined by position."""

    def finish(packed: bytes, parts: list[bytes]):
        ids_raw, lengths, low, rest, bucket = _unpack(packed, 5)
        ids = pa.ipc.open_stream(ids_raw).read_all().column(0).combine_chunks()
        lengths, codes, bucket = np.frombuffer(lengths, np.uint32).astype(np.int64), np.frombuffer(low, np.uint8).astype(np.uint32), _whole(bucket)
        codes[codes == _ESCAPE] = _whole(rest)
        listed: list[bytes] = []
        for part in parts:
            sizes, id_planes = _unpack(part, 2)
            flat = _whole(id_planes).tobytes()
            sizes = np.frombuffer(sizes, np.uint32)
            ends = np.cumsum(sizes.astype(np.int64)) * 4
            listed += [flat[a:b] for a, b in zip(np.concatenate([[0], ends[:-1]]), ends, strict=True)]
        words: list[bytes] = [b""] * len(listed)
        for i, x in zip(np.argsort(bucket, kind="stable").tolist(), listed, strict=True):
            words[i] = x
        piece = _loaded(path)["pieces"] if text else None
        at, out, size, first = 0, [], 0, 0
        for i, n in enumerate(lengths):
            packed_ids = b"".join([words[c] for c in codes[at : at + n].tolist()])
            at += n
            decoded = b"".join([piece[x] for x in np.frombuffer(packed_ids, "<u4").tolist()]).decode("utf-8", "replace") if text else None
            out.append((packed_ids, decoded))
            size += len(packed_ids) + (len(decoded) if text else 0)
            if size >= OUT_BYTES or i == len(lengths) - 1:
                yield _batch(ids.slice(first, len(out)), out, text)
                first, out, size = i + 1, [], 0

    def run(batches):
        block, packed, parts = None, None, []
        for batch in batches:
            for row in batch.to_pylist():
                if row["block"] != block:
                    if packed is not None:
                        yield from finish(packed, parts)
                    block, packed, parts = row["block"], row["payload"], []
                else:
                    parts.append(row["payload"])
        if packed is not None:
            yield from finish(packed, parts)

    return run


def _batch(ids: pa.Array, out: list, text: bool) -> pa.RecordBatch:
    columns = [ids, pa.array([len(x[0]) // 4 for x in out], pa.int64()), pa.array([x[0] for x in out], pa.binary())]
    if text:
        columns.append(pa.array([x[1] for x in out], pa.string()))
    return pa.RecordBatch.from_arrays(columns, ["_id", "n_tokens", "ids", "decoded"][: len(columns)])


def encode(docs: DataFrame, path: str | None = None, decode: bool = True, id_column: str = "doc_id", text_column: str = "text", block_chars: int = BLOCK_CHARS) -> DataFrame:
    """Each row's id, n_tokens, ids (little-endian unsigned 32-bit integers) and, with decode, the text that the ids decode to."""
    path = path or vocabulary_path()
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    buckets = BUCKETS_A_TASK * parts
    source = docs.select(F.col(f"`{id_column}`").alias("_id"), F.col(f"`{text_column}`").cast("string").alias("_text"))
    blocks = written(source.mapInArrow(_blocks(path, buckets, block_chars), _BLOCK_KIND), "bpe-blocks")
    lists = blocks.filter("bucket >= 0").repartition(parts, "bucket").sortWithinPartitions("bucket", "block")
    ids = lists.mapInArrow(_encoded(path), _BLOCK_KIND)
    meet = blocks.filter("bucket < 0").unionAll(ids).repartition(parts, "block").sortWithinPartitions("block", "bucket")
    kind = f"_id {source.schema['_id'].dataType.simpleString()}, n_tokens long, ids binary" + ", decoded string" * decode
    return meet.mapInArrow(_joined(path, decode), kind).withColumnRenamed("_id", id_column)


def decode(coded: DataFrame, path: str | None = None, id_column: str = "doc_id", ids_column: str = "ids") -> DataFrame:
    """Texts of rows with an array of ids: positions are exploded, joined with the vocabulary's pieces, and put together again.

    Rows with the same id and ids are one. A null or empty array decodes to the empty text; an id that is not in the vocabulary adds nothing."""
    spark = coded.sparkSession
    known = [(i, p) for i, p in enumerate(pieces(path or vocabulary_path()))]
    # The vocabulary is a file of fixed size (about 50 thousand pieces), so it may be broadcast.
    names = F.broadcast(spark.createDataFrame(known, "_token long, _piece binary"))
    rows = coded.select(F.col(id_column).alias("_id"), F.col(ids_column).alias("_ids")).distinct()
    tokens = rows.select("_id", "_ids", F.posexplode_outer("_ids").alias("_at", "_token"))
    joined = tokens.join(names, "_token", "left")
    text = F.decode(F.unhex(F.concat_ws("", F.transform(F.array_sort(F.collect_list(F.struct(F.coalesce("_at", F.lit(0)).alias("a"), F.hex("_piece").alias("p")))), lambda x: x["p"]))), "UTF-8")
    return joined.groupBy("_id", "_ids").agg(text.alias("decoded")).select(F.col("_id").alias(id_column), F.col("_ids").alias(ids_column), "decoded")


def query(spark, sf_dir):
    """op2_bpe."""
    from tidemark.llm.shared import table

    return encode(table(spark, sf_dir, "documents")).select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))
