"""Operator 1: near-duplicate documents by BagMinHash over word shingles.

A document is the multiset of its runs of five words (words as in operator 4, lower-cased; a
document of one to four words is one run). Two documents are linked if the weighted Jaccard
similarity of their multisets, sum of the smaller over sum of the larger counts, is 0.8 or more;
classes are the connected components of the links.

Signatures are BagMinHash: each shingle has independent Poisson processes over the dyadic intervals
(0,1], (1,2], (2,4], (4,8] ... of the discretised weights, with as many points a unit of time as
the interval is long. A shingle of weight w has the points of all intervals below w and, of the
interval that w cuts, the points whose place is at most w: the place's binary digits are the way
down the interval's hierarchy of halves. A point sends its time to a random register, and a register
keeps its least time, so two documents agree in a register with the probability of their similarity.
Points are made in rising time only as far as the registers can still use them.

REGISTERS registers make BANDS bands of ROWS; documents that agree in a band are candidates (a pair
at 0.8 is missed with a probability of 5e-8), and candidates are verified on their exact multisets.

Copies of a text are one node, known by the 128 bits of its MD5, with the set of its units: the nth copy
of a shingle is a unit of its own, so that |A & B| of sets is that of the multisets. A band's bucket of up to
SMALL nodes (INNER at later levels) gives all its pairs. In a larger one the node with the most company over
all its buckets is the pivot, and every node is compared with it. Pivots that are then in one component have
one family, of all their nodes. Unless a family is in one component, a reference set R is made for it, the
units that a quarter of SAMPLE of its nodes have, and each node is kept as what it has beyond R and what it
lacks of R. With i units of A within R and s = |A|, |A & B| = i(A) + i(B) - |R| + the differences that A and B
share, so they are alike, |A & B| >= t (|A| + |B|) with t = 0.8 / 1.8, if they share g(A) + g(B) differences,
g = t s - i + |R| / 2. Every node is compared with the champion, the node of least g. So nodes that need share
no difference are both alike to it, and others share one: they have a unit beyond R in common, or lack one.
Units beyond R are rare, and as |A & B| is at most min(i(A), i(B)) and the shared units beyond R, only the first
few of them, in the order of hashes, have to be looked at. Units lacking matter only where min(i(A), i(B)) >=
t (|A| + |B|), which bounds the size of B by what A has of R; so they are taken with the size class of B. All
nodes of one such shared difference, if they are in several components, are a bucket of the next level, and
are worked off in the same way until none is left. R may be any set for this to hold, so the sample costs no
link. No link between components is lost, and a group of near copies costs a few comparisons a node, not
one a pair. All of this runs as joins; nothing is gathered in one task but SAMPLE sets of units.

Defined results: equal texts are one class, also those without words (a null text is an empty one),
and a text without words is like no other text; the class id is the least document id of the class (nulls last); repeated rows share a class; an
empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.llm import hashing
from tidemark.llm.shared import chunks, forgotten, text_buffers, written

SHINGLE, SIMILARITY, ROWS, BANDS = 5, 0.8, 4, 32
SMALL, INNER, SAMPLE, STEP, BROADCAST_ROWS, BROADCAST_BYTES, CHUNK, SALTS = 8, 192, 16, 1.002, 500_000, 8 << 20, 1 << 21, 32
FEW_LINKS = 200_000


def bags(data: np.ndarray, offsets: np.ndarray, size: int = SHINGLE):
    """text, shingle hash and count of the multisets of the texts."""
    _, _, text, hashes = hashing.words(data, offsets, hashing.ALNUM)
    return hashing.multisets(*hashing.shingles(text, hashes, size))


def signatures(text: np.ndarray, items: np.ndarray, weights: np.ndarray, n: int, registers: int) -> np.ndarray:
    """n rows of registers least times (infinite for an empty multiset)."""
    out = np.full((n, registers), np.inf)
    total = np.bincount(text, weights, n)
    todo = total > 0
    limit = np.where(todo, registers * (np.log(registers) + 6) / np.maximum(total, 1), 0.0)
    # One process for each dyadic interval that a weight reaches into.
    level = np.ceil(np.log2(np.maximum(weights, 1))).astype(np.int64)
    rows = np.repeat(np.arange(len(items)), level + 1)
    k = np.arange(len(rows)) - np.repeat(np.cumsum(level + 1) - (level + 1), level + 1)
    low = np.where(k == 0, 0, 1 << np.maximum(k - 1, 0)).astype(np.float64)
    length = np.where(k == 0, 1, 1 << np.maximum(k - 1, 0)).astype(np.float64)
    seed = hashing.mix(items[rows] + k.astype(np.uint64) * hashing.GOLD)
    owner, weight = text[rows], weights[rows].astype(np.float64)
    flat = out.reshape(-1)
    while todo.any():
        active = np.flatnonzero(todo[owner])
        time, made, block = np.zeros(len(active)), 0, 2
        while len(active):
            x = hashing.mix(seed[active][:, None] + (np.arange(made + 1, made + block + 1, dtype=np.uint64) * hashing.GOLD)[None, :])
            y = hashing.mix(x ^ np.uint64(0xA5A5A5A5A5A5A5A5))
            gaps = -np.log(((x >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53) / length[active][:, None]
            times = time[:, None] + np.cumsum(gaps, axis=1)
            place = low[active][:, None] + length[active][:, None] * ((y >> np.uint64(12)).astype(np.float64) * 2.0**-52)
            good = (times <= limit[owner[active]][:, None]) & (place <= weight[active][:, None])
            cell = (owner[active] * registers)[:, None] + (y & np.uint64(0xFFF)).astype(np.int64) % registers
            np.minimum.at(flat, cell[good], times[good])
            time, made, block = times[:, -1], made + block, min(block * 2, 64)
            on = time <= limit[owner[active]]
            active, time = active[on], time[on]
        todo &= np.isinf(out).any(axis=1)
        limit = np.where(todo, limit * 2, limit)
    return out


def bands(sig: np.ndarray, rows: int = ROWS) -> np.ndarray:
    """A 64-bit key for each band of each signature."""
    bits = sig.view(np.uint64).reshape(len(sig), -1, rows)
    key = np.zeros(bits.shape[:2], np.uint64)
    for r in range(rows):
        key = hashing.mix(key + bits[:, :, r] + hashing.GOLD)
    return hashing.mix(key + (np.arange(key.shape[1], dtype=np.uint64) + np.uint64(1)) * hashing.GOLD)


def _signed(size: int, n_bands: int, rows: int):
    def run(batches):
        seen: set[int] = set()
        for batch in batches:
            new = [i for i, h in enumerate(batch.column(0).to_pylist()) if h not in seen and not seen.add(h)]
            if len(seen) > 1_000_000:
                seen = set()
            batch = batch.take(pa.array(new, pa.int32()))
            data, offsets = text_buffers(batch.column(1))
            for lo, hi in chunks(offsets, CHUNK):
                text, items, weights = bags(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], size)
                known = np.unique(text)
                if len(known):
                    keys = bands(signatures(np.searchsorted(known, text), items, weights, len(known), n_bands * rows), rows).view(np.int64)
                    flat = pa.FixedSizeListArray.from_arrays(pa.array(keys.reshape(-1)), n_bands).cast(pa.list_(pa.int64()))
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(known + lo)), flat], ["node", "keys"])

    return run


def units(items: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """A hash for each copy of each item."""
    nth = np.arange(weights.sum()) - np.repeat(np.cumsum(weights) - weights, weights)
    return np.repeat(items, weights) + hashing.mix(nth.astype(np.uint64)) * (nth > 0).astype(np.uint64)


def _bagged(size: int):
    """Rows (node, text) as (node, bag): the units in order."""

    def run(batches):
        for batch in batches:
            data, offsets = text_buffers(batch.column(1))
            for lo, hi in chunks(offsets, CHUNK):
                text, items, weights = bags(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], size)
                at = np.searchsorted(text, np.arange(hi - lo + 1))
                out = [np.unique(units(items[i:j], weights[i:j])).tobytes() for i, j in zip(at[:-1], at[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(out, pa.binary())], ["node", "bag"])

    return run


def _held(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which of the units b are in a; both in order."""
    return a[np.minimum(np.searchsorted(a, b), len(a) - 1)] == b if len(a) else np.zeros(len(b), bool)


def _opened(scalar) -> np.ndarray:
    return np.frombuffer(scalar.as_py(), np.uint64)


def _verified(batches):
    """Rows (a, b, bag of a, bag of b) as (a, b, size_a, size_b, common)."""
    for batch in batches:
        out, last = [], (None, None)
        for x, s, t in zip(batch.column(0).to_pylist(), batch.column(2), batch.column(3), strict=True):
            last = last if last[0] == x else (x, _opened(s))
            other = _opened(t)
            out.append((len(last[1]), len(other), int(_held(last[1], other).sum())))
        numbers = np.array(out, np.int64).reshape(-1, 3)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(numbers[:, k]) for k in range(3))], ["a", "b", "size_a", "size_b", "common"])


def _references(batches):
    """Rows (a, bags) as (a, bag): the units that a quarter of the bags have."""
    for batch in batches:
        out = []
        for bags_ in batch.column(1):
            found, count = np.unique(np.concatenate([_opened(x) for x in bags_]), return_counts=True)
            out.append(found[4 * count >= len(bags_)].tobytes())
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], ["a", "bag"])


def _told(batches):
    """Rows (a, node, reference set of a, bag of node) as the sizes of the three sets and the units beyond and lacking."""
    for batch in batches:
        out, last = [], (None, None)
        for x, s, t in zip(batch.column(0).to_pylist(), batch.column(2), batch.column(3), strict=True):
            last = last if last[0] == x else (x, _opened(s))
            bag = _opened(t)
            inside = _held(last[1], bag)
            lacking = last[1][~_held(bag, last[1])]
            out.append((len(last[1]), len(bag), int(inside.sum()), bag[~inside].view(np.int64), lacking.view(np.int64)))
        rest = list(zip(*out, strict=True)) or [[]] * 5
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(x, k) for x, k in zip(rest, kinds, strict=True))], ["a", "node", "of", "size", "held", "beyond", "lacking"])


def _joined(batches):
    """Links (a, b) as (node, root), by union of trees."""
    up: dict[bytes, bytes] = {}

    def root(x: bytes) -> bytes:
        while up.setdefault(x, x) != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            low, high = sorted((root(a), root(b)))
            up[high] = low
    nodes = list(up)
    yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.binary()), pa.array([root(x) for x in nodes], pa.binary())], ["node", "root"])


def components(links: DataFrame) -> DataFrame:
    """(node, root): the least node of each component, for nodes that have links. Up to FEW_LINKS are joined in one task; beyond, large-star and small-star alternate until nothing changes."""
    links = written(links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links")
    if links.count() <= FEW_LINKS:
        return links.coalesce(1).mapInArrow(_joined, "node binary, root binary")
    mark = _fingerprint(links)
    while True:
        both = links.select("a", "b").unionAll(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        # Large star: every larger neighbour is tied to the least node around; small star: the smaller ones are.
        large = both.filter("b > a").join(least, "a").select(F.col("m").alias("a"), "b").filter("a != b").distinct()
        up = large.groupBy("b").agg(F.min("a").alias("m"))
        small = large.join(up, "b").select(F.explode(F.array(F.struct(F.col("m").alias("a"), F.col("b").alias("b")), F.struct(F.col("m").alias("a"), F.col("a").alias("b")))).alias("x")).select("x.a", "x.b").filter("a != b").distinct()
        before, links = links, written(small, "links")
        forgotten(before)
        last, mark = mark, _fingerprint(links)
        if mark == last:
            return links.select(F.col("b").alias("node"), F.col("a").alias("root")).unionAll(links.select(F.col("a").alias("node"), F.col("a").alias("root")).distinct())


def _fingerprint(links: DataFrame) -> tuple:
    """How many rows, and two sums of hashes over them: the same for two tables if and, but for chance, only if their rows are."""
    return tuple(links.agg(F.count(F.lit(1)), *[F.sum(F.xxhash64(F.lit(seed), "a", "b").cast("decimal(38,0)")) for seed in (1, 2)]).head())


def _met(pairs: DataFrame, heads: DataFrame, known: DataFrame) -> DataFrame:
    """Pairs (a, b), the sets (a, bag) and the bags (node, bag), joined: (a, b, _s, _t)."""
    heads = heads.select("a", F.col("bag").alias("_s"))
    others = pairs.select("a", "b").join(known.select(F.col("node").alias("b"), F.col("bag").alias("_t")), "b")
    if (heads.agg(F.sum(F.octet_length("_s") + 64)).head()[0] or 0) <= BROADCAST_BYTES:
        met = others.join(F.broadcast(heads), "a")
    else:
        # A pivot has many partners: its set goes to SALTS places, and only to those where partners are.
        place = F.pmod(F.xxhash64("b"), F.lit(SALTS)).cast("int")
        met = others.withColumn("s", place).join(pairs.select("a", place.alias("s")).distinct().join(heads, "a"), ["a", "s"])
    return met.select("a", "b", "_s", "_t")


def _alike(common, size_a, size_b, threshold: float):
    """The similarity, from the sizes, and whether it is enough."""
    return (common / F.greatest(size_a + size_b - common, F.lit(1))).alias("similarity"), common / F.greatest(size_a + size_b - common, F.lit(1)) >= threshold


def _by_bags(met: DataFrame, threshold: float) -> DataFrame:
    """(a, b, similarity) of those rows (a, b, bag of a, bag of b) that are alike."""
    found = met.select("a", "b", "_s", "_t").mapInArrow(_verified, "a binary, b binary, size_a long, size_b long, common long")
    share, enough = _alike(F.col("common"), F.col("size_a"), F.col("size_b"), threshold)
    return found.filter(enough).select("a", "b", share)


def _opposite(pairs: DataFrame, known: DataFrame) -> DataFrame:
    """Pairs (a, b) with both bags. They are of small buckets, so no node has many partners."""
    x, y = (known.select(F.col("node").alias(n), F.col("bag").alias(v)) for n, v in (("a", "_s"), ("b", "_t")))
    return pairs.select("a", "b").join(y, "b").join(x, "a")


_PARTS = ("of", "size", "held", "beyond", "lacking")


def _by_differences(met: DataFrame, threshold: float) -> DataFrame:
    """(a, b, similarity) of those rows (a, b, x, y) that are alike, x and y being their differences to one reference set."""
    shared = F.size(F.array_intersect("x.beyond", "y.beyond")) + F.size(F.array_intersect("x.lacking", "y.lacking"))
    met = met.select("a", "b", "x.size", F.col("y.size").alias("size_b"), (F.col("x.held") + F.col("y.held") - F.col("x.of") + shared).alias("common"))
    share, enough = _alike(F.col("common"), F.col("size"), F.col("size_b"), threshold)
    return met.filter(enough).select("a", "b", share)


def _in_family(pairs: DataFrame, told: DataFrame) -> DataFrame:
    """Pairs (family, a, b) of small buckets with their differences x and y."""
    x, y = (told.select(F.col("a").alias("family"), F.col("node").alias(n), F.struct(*_PARTS).alias(v)) for n, v in (("a", "x"), ("b", "y")))
    return pairs.join(x, ["family", "a"]).join(y, ["family", "b"])


def _with_champion(told: DataFrame, champions: DataFrame) -> DataFrame:
    """Every node of a family beside its champion: (a, b, x, y). The champion goes to SALTS places."""
    heads = told.join(champions.select("a", F.col("champion").alias("node")), ["a", "node"]).select(F.col("a").alias("family"), F.col("node").alias("a"), F.struct(*_PARTS).alias("x"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("s"))
    nodes = told.select(F.col("a").alias("family"), F.col("node").alias("b"), F.struct(*_PARTS).alias("y"), F.pmod(F.xxhash64("node"), F.lit(SALTS)).cast("int").alias("s"))
    return nodes.join(heads, ["family", "s"]).filter("a != b").select("family", "a", "b", "x", "y")


def _merged(roots: DataFrame | None, links: DataFrame) -> DataFrame:
    """The roots after further links (a, b): components of the components so far."""
    if roots is None:
        return written(components(links.select("a", "b")), "roots")
    ends = _rooted(_rooted(links.select("a", "b"), roots, "a", "x"), roots, "b", "y").filter("x != y")
    over = written(components(ends.select(F.col("x").alias("a"), F.col("y").alias("b"))), "over")
    known = roots.join(over.select(F.col("node").alias("root"), F.col("root").alias("_root")), "root", "left").select("node", F.coalesce("_root", "root").alias("root"))
    return written(known.unionByName(over.join(roots, "node", "left_anti")), "roots")


def _rooted(rows: DataFrame, roots: DataFrame, column: str, root: str) -> DataFrame:
    """rows with the root of the node in a column."""
    named = roots.select(F.col("node").alias(column), F.col("root").alias("_root"))
    return rows.join(named, column, "left").withColumn(root, F.coalesce("_root", column)).drop("_root")


def _families(stars: DataFrame, known: DataFrame) -> DataFrame:
    """(a, node, of, size, held, beyond, lacking): the nodes of each pivot's family against its reference set."""
    order = Window.partitionBy("a").orderBy(F.xxhash64("b"), "b")
    some = stars.withColumn("_i", F.row_number().over(order)).filter(F.col("_i") <= SAMPLE).select("a", F.col("b").alias("node"))
    gathered = some.join(known, "node").groupBy("a").agg(F.collect_list("bag").alias("bags"))
    references = written(gathered.mapInArrow(_references, "a binary, bag binary"), "references")
    kind = "a binary, node binary, of long, size long, held long, beyond array<long>, lacking array<long>"
    return written(_met(stars, references, known).mapInArrow(_told, kind), "families")


def _inner(told: DataFrame, champions: DataFrame, roots: DataFrame, threshold: float) -> DataFrame:
    """(key, a, node, root): the buckets of the next level; see the top."""
    need = threshold / (1 + threshold)
    lead = _rooted(champions.select("a", "champion"), roots, "champion", "_lead").select("a", "_lead")
    rows = _rooted(told, roots, "node", "root").join(lead, "a").withColumn("_out", F.col("root") != F.col("_lead"))
    rows = written(rows.select("a", "node", "root", "size", "held", "beyond", "lacking", "_out"), "rooted")
    rows = written(rows.join(rows.filter("_out").select("a").distinct(), "a", "left_semi"), "open")
    # So many units beyond the reference set a node must share with any other of its family, and of these one is among the first of both in the order of hashes.
    # One of the two is not in the champion's component, and has no more within the set than any such node.
    # The least size that another can have is the least that is about in the family and not too small to be alike.
    step = lambda x: F.floor(F.log(F.greatest(x.cast("double"), F.lit(1.0))) / math.log(1.01) + 1e-9).cast("int")
    about = rows.groupBy("a").agg(F.collect_set(step(F.col("size"))).alias("_sizes"), F.max(F.when(F.col("_out"), F.col("held"))).alias("_most"))
    lowest = F.pow(F.lit(1.01), F.array_min(F.filter("_sizes", lambda x: x >= step(F.col("size") * threshold - 1e-6))))
    least = F.greatest(F.col("size") * threshold, lowest - 1e-6)
    shared = F.greatest(F.lit(1), F.ceil((F.col("size") + least) * need - F.least("held", "_most") - 1e-6))
    first = (F.size("beyond") - shared + 1).cast("int")
    beyond = rows.join(about, "a").filter(first > 0).select("a", "node", "root", F.explode(F.slice("beyond", F.lit(1), first)).alias("unit")).select(F.xxhash64(F.lit("+"), "a", "unit").alias("key"), "a", "node", "root")
    # Of two nodes of which one is not in the champion's component, A, the other, B, is held in its class of size, and A asks for the classes in which B may be.
    size = lambda x: F.floor(F.log(x.cast("double")) / F.log(F.lit(STEP)) + 1e-9).cast("int")
    fit = rows.filter(F.col("held") >= threshold * F.col("size") - 1e-6).filter("size > 0")
    held = fit.select("a", size(F.col("size")).alias("class"), "node", "root", "lacking")
    least, most = F.greatest(F.col("size") * threshold - 1e-6, F.lit(1.0)), F.least(F.col("held") / need - F.col("size") + 1e-6, F.col("size") / threshold + 1e-6)
    occupied = held.groupBy("a").agg(F.collect_set("class").alias("classes"))
    inside = F.filter("classes", lambda x: x.between(size(least), size(most)))
    asked = fit.filter("_out").filter(most >= least).join(occupied, "a").select("a", F.explode(inside).alias("class"), "node", "root", "lacking")
    held = held.join(asked.select("a", "class").distinct(), ["a", "class"], "left_semi")
    lacking = held.unionByName(asked).select("a", "class", "node", "root", F.explode("lacking").alias("unit")).select(F.xxhash64(F.lit("-"), "a", "class", "unit").alias("key"), "a", "node", "root")
    both = written(beyond.unionAll(lacking.distinct()), "differences")
    # Differences that come together, as the runs around one changed word do, have the same nodes; one of them is enough.
    nodes = [F.bit_xor(F.xxhash64(F.lit(seed), "node")).alias(f"_x{seed}") for seed in (1, 2)]
    keys = both.groupBy("key").agg(F.min("a").alias("_a"), F.count(F.lit(1)).alias("_n"), F.min("root").alias("_lo"), F.max("root").alias("_hi"), *nodes).filter("_lo != _hi")
    mixed = keys.groupBy("_a", "_n", "_x1", "_x2").agg(F.min("key").alias("key")).select("key")
    return both.join(mixed, "key", "left_semi").distinct()


def classes(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", size: int = SHINGLE, threshold: float = SIMILARITY, n_bands: int = BANDS, rows: int = ROWS, broadcast_rows: int = BROADCAST_ROWS
) -> tuple[DataFrame, DataFrame]:
    """(id, class_id) for every row; and the links (a, b, similarity) found between nodes, which are hashes of texts."""
    text = F.coalesce(F.col(f"`{text_column}`").cast("string"), F.lit(""))
    identity = F.unhex(F.md5(text.cast("binary")))
    source = docs.select(identity.alias("node"), text.alias("text"))
    signed = source.mapInArrow(_signed(size, n_bands, rows), "node binary, keys array<long>")
    keyed = signed.groupBy("node").agg(F.first("keys").alias("keys")).select("node", F.explode("keys").alias("key"))
    # Nodes are their own roots as long as nothing is known of them.
    buckets = written(keyed.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("key"))).filter("n > 1").withColumn("root", F.col("node")).withColumn("a", F.col("node")).withColumn("fresh", F.lit(True)).withColumn("fresh_n", F.col("n")), "bands")
    # The multiset of each node that has company is made once, for all levels.
    wanted = written(buckets.select("node").distinct(), "wanted")
    few = wanted.count() <= broadcast_rows
    texts = source.join(F.broadcast(wanted) if few else wanted, "node", "left_semi").groupBy("node").agg(F.min("text").alias("text"))
    known = written(texts.mapInArrow(_bagged(size), "node binary, bag binary"), "bags")
    tested = links = used = told = roots = None
    while True:
        # A node is a pivot at one level only, so the levels end; a bucket of nothing but former pivots gives all its pairs.
        few = (F.col("n") <= (SMALL if told is None else INNER)) | (F.col("fresh_n") == 0)
        small = buckets.filter(few).groupBy("key").agg(F.first("a").alias("family"), F.sort_array(F.collect_list(F.struct("node", "root"))).alias("g"))
        pairs = small.select("family", "g", F.posexplode("g").alias("i", "x")).select("family", "x", F.explode(F.filter(F.slice("g", F.col("i") + 2, F.size("g")), lambda y: y["root"] != F.col("x")["root"])).alias("y"))
        pairs = pairs.select("family", F.col("x.node").alias("a"), F.col("y.node").alias("b")).dropDuplicates(["a", "b"])
        if tested is not None:
            pairs = pairs.join(tested, ["a", "b"], "left_anti")
        pairs = written(pairs.select("family", "a", "b"), "pairs")
        alike = _by_bags(_opposite(pairs, known), threshold) if told is None else _by_differences(_in_family(pairs, told), threshold)
        hot = buckets.filter(~few)
        company = hot.groupBy("node").agg(F.sum("n").alias("c"))
        pivots = hot.filter("fresh").join(company, "node").groupBy("key").agg(F.max(F.struct("c", "node"))["node"].alias("pivot"))
        stars = written(pivots.join(hot, "key").select(F.col("pivot").alias("a"), F.col("node").alias("b")).distinct(), "stars")
        last = stars.isEmpty()
        if not last:
            heads = written(stars.select("a").distinct().join(known.select(F.col("node").alias("a"), "bag"), "a"), "heads")
            others = stars.filter("a != b")
            alike = alike.unionAll(_by_bags(_met(others, heads, known), threshold))
            pairs = pairs.unionAll(others.select(F.col("a").alias("family"), "a", "b"))
            former = heads.select(F.col("a").alias("node"))
            used = former if used is None else used.unionAll(former)
        links = alike if links is None else links.unionAll(alike)
        if last and roots is not None and pairs.isEmpty():
            break
        roots = _merged(roots, alike)
        if last:
            break
        # Pivots that are in one component have one family.
        families = _rooted(_rooted(stars, roots, "a", "family"), roots, "b", "root").select(F.col("family").alias("a"), "b", "root").distinct()
        open_ = families.groupBy("a").agg(F.min("root").alias("_lo"), F.max("root").alias("_hi")).filter("_lo != _hi").select("a")
        families = written(families.join(open_, "a", "left_semi").select("a", "b"), "members")
        told = _families(families, known)
        g = F.col("size") * (threshold / (1 + threshold)) - F.col("held")
        champions = written(told.groupBy("a").agg(F.min(F.struct(g.alias("g"), "node"))["node"].alias("champion")), "champions")
        beside = _with_champion(told, champions)
        alike = _by_differences(beside, threshold)
        links = links.unionAll(alike)
        roots = _merged(roots, alike)
        pairs = pairs.unionAll(beside.select("family", "a", "b"))
        done = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        tested = done if tested is None else tested.unionAll(done)
        inner = _inner(told, champions, roots, threshold)
        inner = inner.join(used.select("node", F.lit(False).alias("fresh")).distinct(), "node", "left").withColumn("fresh", F.coalesce("fresh", F.lit(True)))
        w = Window.partitionBy("key")
        buckets = written(inner.withColumn("n", F.count(F.lit(1)).over(w)).withColumn("fresh_n", F.sum(F.col("fresh").cast("long")).over(w)), "buckets")
        if buckets.isEmpty():
            break
    node = docs.select(F.col(f"`{id_column}`").alias("_id"), identity.alias("node"))
    rooted = node.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    # The least id of each class is found before the rows meet it.
    least = rooted.groupBy("root").agg(F.min("_id").alias("_class"))
    out = rooted.join(least, "root")
    return out.select(F.col("_id").alias(id_column), F.col("_class").alias("class_id")), links


def query(spark, sf_dir):
    """op1_minhash: one row for each document with its class, and whether it is the one that stays."""
    from tidemark.llm.shared import table

    found, _ = classes(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "class_id", F.col("doc_id").eqNullSafe(F.col("class_id")).alias("stays"))
