"""Operator 8: language-model scoring by a weighted backoff automaton.

Tokens are runs of other than white space, A-Z as a-z, and an end after each text. The model is an
interpolated bigram over all training documents: with c counts, N tokens and V distinct tokens,
    p(w)     = (c(w) - D) / N, and D V / N for all unknown tokens together,
    p(w | h) = (c(h, w) + M p(w)) / (c(h) + M).
As an automaton it has a state for each known token and a root. A state has an arc for each pair
that was seen, with log10 p(w | h), and a failure arc to the root with log10 M / (c(h) + M); the root has
an arc for each known token and one for unknown ones. A text starts in the state of the end, and one
traversal from left to right takes an arc, or the failure arc and one of the root's, for each token.

Counts are of the whole corpus, and are never brought together in one place:
1. Texts become blocks. A block lists its distinct tokens and pairs, with their counts in its
   training texts, by bucket, a hash of the token or pair. A hot token is once in a block's list.
2. Lists meet by bucket, where the counts of all blocks are added, and go back as totals in the
   order of the list; N and V are sums over blocks and buckets.
3. The blocks are made again, as texts of numbers into their distinct tokens, and meet the totals.
   Each builds the part of the automaton that its texts can reach and traverses it. A block that is
   not what it was the first time (rows that come in other parts, as after a shuffle) is an error.
Tokens are known by 64-bit hashes, pairs by 48 bits and their bucket.

Defined results: null and empty texts are one end; without training documents all counts are 0,
base_score is that of its formula, and the model gives an unknown token probability 1; repeated
rows are each scored and counted; a null id's fold is that of empty text; other columns are not read.
"""

from __future__ import annotations


import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import hashing
from tidemark.llm.bpe import _ESCAPE, _pack, _planes, _unpack, _whole
from tidemark.llm.shared import chunks, text_buffers, written

BLOCK_BYTES, BUCKETS_A_TASK, DISCOUNT, PRIOR = 2_000_000, 2, 0.7, 200.0
_END = np.uint64(0x5851F42D4C957F2D)
_LOW = np.uint64((1 << 48) - 1)
_KIND = "block long, bucket int, payload binary, tokens long, kinds long"
_SCHEMA = pa.schema([("block", pa.int64()), ("bucket", pa.int32()), ("payload", pa.binary()), ("tokens", pa.int64()), ("kinds", pa.int64())])


def tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the tokens of all texts, each text's end included; and how many each text has."""
    _, _, text, h = hashing.words(data, offsets, hashing.NONSPACE)
    n = len(offsets) - 1
    count = np.bincount(text, minlength=n) + 1
    ends = np.cumsum(count) - 1
    out = np.full(int(count.sum()), _END, np.uint64)
    inside = np.ones(len(out), bool)
    inside[ends] = False
    out[inside] = h
    return out, count


def before(codes: np.ndarray, count: np.ndarray, end: int) -> np.ndarray:
    """The token before each one; the end before a text's first."""
    out = np.empty_like(codes)
    out[1:] = codes[:-1]
    out[(np.cumsum(count) - count)] = end
    return out


def pair_keys(known: np.ndarray, first: np.ndarray, second: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct pairs as (bucket, 48-bit key) in that order, and each position's place among them."""
    key = hashing.mix(known[first] * hashing.GOLD + known[second])
    whole = ((key >> np.uint64(48)) % np.uint64(buckets) << np.uint64(48)) | (key & _LOW)
    distinct, place = np.unique(whole, return_inverse=True)
    return (distinct >> np.uint64(48)).astype(np.int64), distinct & _LOW, place


def _gaps(keys: np.ndarray) -> np.ndarray:
    return np.diff(np.r_[np.uint64(0), keys]).astype(np.uint64)


def _planes8(numbers: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(numbers.astype(np.uint64).view(np.uint8).reshape(-1, 8).T)


def _whole8(planes: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(8, -1).T).reshape(-1).view(np.uint64)


def _block(ids: pa.Array, training: np.ndarray, data: np.ndarray, offsets: np.ndarray, block: int, buckets: int, lists: bool) -> pa.RecordBatch:
    """A block's lists, or else its texts under bucket -1; both bear the same fingerprint of its distinct tokens."""
    all_tokens, count = tokens(data, offsets)
    known, codes = np.unique(np.r_[all_tokens, _END], return_inverse=True)
    codes = codes[:-1].astype(np.uint32)
    print_ = np.array([zlib.crc32(known.tobytes()), zlib.crc32(codes.tobytes())], np.uint32)
    if not lists:
        common = np.argsort(-np.bincount(codes, minlength=len(known)), kind="stable")
        rank = np.empty(len(known), np.uint32)
        rank[common] = np.arange(len(known), dtype=np.uint32)
        ranked = rank[codes]
        low, rest = np.minimum(ranked, _ESCAPE).astype(np.uint8), ranked[ranked >= _ESCAPE]
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, pa.schema([("id", ids.type), ("training", pa.bool_())])) as w:
            w.write_batch(pa.RecordBatch.from_arrays([ids, pa.array(training)], ["id", "training"]))
        rows = [(block, -1, _pack(print_, sink.getvalue().to_pybytes(), count.astype(np.uint32), low, _planes(rest), _planes8(known), _planes(common.astype(np.uint32))), 0, 0)]
    else:
        mine = np.repeat(training, count)
        seen = np.bincount(codes[mine], minlength=len(known))
        end = int(np.searchsorted(known, _END))
        bucket2, key2, place = pair_keys(known, before(codes, count, end), codes, buckets)
        seen2 = np.bincount(place[mine], minlength=len(key2))
        bucket1 = (known >> np.uint64(32)) % np.uint64(buckets)
        order1 = np.argsort(bucket1, kind="stable")
        at1, at2 = np.searchsorted(bucket1[order1], np.arange(buckets + 1)), np.searchsorted(bucket2, np.arange(buckets + 1))
        rows, left = [], int(mine.sum())
        for b in range(buckets):
            one, two = order1[at1[b] : at1[b + 1]], slice(at2[b], at2[b + 1])
            if len(one) or at2[b + 1] > at2[b]:
                # The block's training tokens go with its first list.
                rows.append((block, b, _pack(print_, _planes8(known[one]), _planes(seen[one]), _planes8(_gaps(key2[two])), _planes(seen2[two])), left, 0))
                left = 0
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), _SCHEMA.types, strict=True)], schema=_SCHEMA)


def _blocks(buckets: int, block_bytes: int, lists: bool):
    def run(batches):
        from pyspark import TaskContext

        part, n, held, size = TaskContext.get().partitionId(), 0, [], 0

        def flush():
            table = pa.Table.from_batches(held).combine_chunks()
            data, offsets = text_buffers(table.column(2))
            for lo, hi in chunks(offsets, block_bytes):
                ids = table.column(0).slice(lo, hi - lo).combine_chunks()
                training = table.column(1).slice(lo, hi - lo).to_numpy(zero_copy_only=False).astype(bool)
                yield ids.chunk(0) if isinstance(ids, pa.ChunkedArray) else ids, training, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]

        for batch in batches:
            held.append(batch)
            size += batch.nbytes
            if size >= block_bytes:
                for x in flush():
                    yield _block(*x, (part << 24) + n, buckets, lists)
                    n += 1
                held, size = [], 0
        if sum(b.num_rows for b in held):
            for x in flush():
                yield _block(*x, (part << 24) + n, buckets, lists)
                n += 1

    return run


def _totals(buckets: int):
    """Lists of one bucket after the other, sorted by bucket: keys and counts are held until the bucket ends, then every block gets its totals."""

    def finish(bucket: int, lists: list):
        out = []
        for kind in (0, 1):
            keys, counts = np.concatenate([x[1 + 2 * kind] for x in lists]), np.concatenate([x[2 + 2 * kind] for x in lists]).astype(np.int64)
            distinct, place = np.unique(keys, return_inverse=True)
            total = np.bincount(place, counts, len(distinct)).astype(np.int64)
            out.append((total[place], int((total > 0).sum())))
        at = [0, 0]
        for i, x in enumerate(lists):
            parts = []
            for kind in (0, 1):
                n = len(x[1 + 2 * kind])
                parts.append(_planes8(out[kind][0][at[kind] : at[kind] + n]))
                at[kind] += n
            yield x[0], bucket, _pack(x[5], *parts), x[6], out[0][1] if i == 0 else 0

    def run(batches):
        bucket, lists = None, []
        for batch in batches:
            for row in batch.to_pylist():
                if row["bucket"] != bucket:
                    if lists:
                        yield from _rows(finish(bucket, lists))
                    bucket, lists = row["bucket"], []
                print_, k1, c1, k2, c2 = _unpack(row["payload"], 5)
                lists.append((row["block"], _whole8(k1), _whole(c1), np.cumsum(_whole8(k2)), _whole(c2), print_, row["tokens"]))
        if lists:
            yield from _rows(finish(bucket, lists))

    return run


def _rows(rows):
    for r in rows:
        yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(r, _SCHEMA.types, strict=True)], schema=_SCHEMA)


class Automaton:
    """States are known tokens; arcs are pairs. Weights are log10 probabilities."""

    def __init__(self, count: np.ndarray, pair_count: np.ndarray, first: np.ndarray, second: np.ndarray, n: int, v: int, discount: float, prior: float):
        with np.errstate(divide="ignore"):
            unknown = discount * v / n if n else 1.0
            single = np.where(count > 0, (count - discount) / max(n, 1), unknown)
            self.root = np.log10(single)
            self.failure = np.log10(prior / (count + prior))
            self.arc = np.where(pair_count > 0, np.log10((pair_count + prior * single[second]) / (count[first] + prior)), np.nan)

    def walk(self, state: np.ndarray, token: np.ndarray, arc: np.ndarray) -> np.ndarray:
        """Weight of each step: the arc, or the failure arc and the root's."""
        weight = self.arc[arc]
        return np.where(np.isnan(weight), self.failure[state] + self.root[token], weight)


def _scored(buckets: int, n: int, v: int, discount: float, prior: float):
    def finish(body: bytes, parts: dict[int, bytes]):
        print_, head, count, low, rest, known, common = _unpack(body, 7)
        ids = pa.ipc.open_stream(head).read_all().combine_chunks()
        count, known = np.frombuffer(count, np.uint32).astype(np.int64), _whole8(known)
        ranked = np.frombuffer(low, np.uint8).astype(np.uint32)
        ranked[ranked == _ESCAPE] = _whole(rest)
        codes = _whole(common)[ranked].astype(np.int64)
        end = int(np.searchsorted(known, _END))
        state = before(codes, count, end)
        bucket2, key2, place = pair_keys(known, state, codes, buckets)
        bucket1 = (known >> np.uint64(32)) % np.uint64(buckets)
        totals = [_unpack(parts[b], 3) for b in sorted(parts)]
        if any(x[0] != print_ for x in totals):
            raise ValueError("the rows came in other parts when they were read again; write them as a table first")
        seen = np.zeros(len(known), np.int64)
        seen[np.argsort(bucket1, kind="stable")] = np.concatenate([_whole8(x[1]) for x in totals])
        seen2 = np.concatenate([_whole8(x[2]) for x in totals]).astype(np.int64)
        first, second = np.zeros(len(key2), np.int64), np.zeros(len(key2), np.int64)
        first[place], second[place] = state, codes
        steps = Automaton(seen, seen2, first, second, n, v, discount, prior).walk(state, codes, place)
        base = np.log10((seen + 0.1) / (n + 0.1 * (v + 1)))
        doc = np.repeat(np.arange(len(count)), count)
        add = lambda x: np.bincount(doc, x, len(count))
        return pa.RecordBatch.from_arrays(
            [ids.column(0).combine_chunks(), pa.array(~ids.column(1).to_numpy(zero_copy_only=False).astype(bool)), pa.array(count, pa.int64()), pa.array(add((seen[codes] > 0).astype(float)).astype(np.int64)), pa.array(np.full(len(count), n), pa.int64()), pa.array(add(base[codes])), pa.array(add(steps))],
            ["_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
        )

    def run(batches):
        block, body, parts = None, None, {}
        for batch in batches:
            for row in batch.to_pylist():
                if row["block"] != block:
                    if body is not None:
                        yield finish(body, parts)
                    block, body, parts = row["block"], row["payload"], {}
                else:
                    parts[row["bucket"]] = row["payload"]
        if body is not None:
            yield finish(body, parts)

    return run


def score(docs: DataFrame, training, id_column: str = "doc_id", text_column: str = "text", discount: float = DISCOUNT, prior: float = PRIOR, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Each row's id, held_out (not training), n_tokens, n_known, train_tokens, base_score and score. training: a boolean column."""
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    buckets = BUCKETS_A_TASK * parts
    source = docs.select(F.col(f"`{id_column}`").alias("_id"), training.alias("_training"), F.coalesce(F.col(f"`{text_column}`").cast("string"), F.lit("")).alias("_text"))
    lists = source.mapInArrow(_blocks(buckets, block_bytes, True), _KIND).repartition(parts, "bucket").sortWithinPartitions("bucket", "block")
    totals = written(lists.mapInArrow(_totals(buckets), _KIND), "lm-totals")
    n, v = (x or 0 for x in totals.agg(F.sum("tokens"), F.sum("kinds")).head())
    bodies = source.mapInArrow(_blocks(buckets, block_bytes, False), _KIND)
    meet = bodies.unionAll(totals).repartition(parts, "block").sortWithinPartitions("block", "bucket")
    kind = f"_id {source.schema['_id'].dataType.simpleString()}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return meet.mapInArrow(_scored(buckets, n, v, discount, prior), kind).withColumnRenamed("_id", id_column)


def query(spark, sf_dir):
    """op8_scoring."""
    from tidemark.llm.shared import fold, table

    return score(table(spark, sf_dir, "documents"), fold("doc_id", 10) != 0)
