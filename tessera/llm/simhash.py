"""SimHash near-duplicates by deletion-variant signatures.

A text's 64-bit fingerprint is the bitwise majority over the XXH64 hashes of its word
shingles. Two fingerprints at most ``2`` bits apart, cut into two halves, have one half
that differs by at most one bit. So each half is indexed under its 32 one-wildcard
variants (that bit cleared), an equality grouping on the variant brings every such pair
together, and the whole fingerprints are verified there.

Exact copies share a fingerprint and are folded before anything is shuffled. A variant's
group is never expanded into pairs of rows: a group is verified inside its task with
blocked bit operations and leaves a spanning forest, at most one row per member. Groups
beyond ``dense`` members take an exact second way, in which no comparison is needed: two
wildcards over the whole fingerprint, whose groups are cliques and link to their minimum.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tessera.llm import _bytes
from tessera.llm._store import cut

_P1, _P2, _P3, _P4, _P5 = (np.uint64(x) for x in (11400714785074694791, 14029467366897019727, 1609587929392839161, 9650029242287828579, 2870177450012600261))
_U = np.uint64


def _rotl(x: np.ndarray, r: int) -> np.ndarray:
    return (x << _U(r)) | (x >> _U(64 - r))


def _round(acc: np.ndarray, lane: np.ndarray) -> np.ndarray:
    return _rotl(acc + lane * _P2, 31) * _P1


def xxh64(data: np.ndarray, start: np.ndarray, length: np.ndarray, seed: int = 42) -> np.ndarray:
    """XXH64 of ``data[start : start + length]`` for all spans at once."""
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[: len(data)] = data
    eight = np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))
    four = np.ndarray((len(data) + 1,), "<u4", padded, strides=(1,))
    start = start.astype(np.int64)
    length = length.astype(np.int64)
    with np.errstate(over="ignore"):
        s = _U(seed)
        h = np.full(len(start), s + _P5, np.uint64)
        big = np.flatnonzero(length >= 32)
        if big.size:
            acc = [np.full(big.size, x, np.uint64) for x in (s + _P1 + _P2, s + _P2, s, s - _P1)]
            rows, at, stripes = np.arange(big.size), start[big], length[big] // 32
            for k in range(int(stripes.max())):
                rows = rows[stripes[rows] > k]
                for i in range(4):
                    acc[i][rows] = _round(acc[i][rows], eight[at[rows] + 32 * k + 8 * i])
            g = _rotl(acc[0], 1) + _rotl(acc[1], 7) + _rotl(acc[2], 12) + _rotl(acc[3], 18)
            for a in acc:
                g = (g ^ _round(np.zeros_like(a), a)) * _P1 + _P4
            h[big] = g
        h += length.astype(np.uint64)
        at, rest = start + (length & ~31), length & 31
        for k in range(3):
            rows = np.flatnonzero(rest >= 8)
            if not rows.size:
                break
            h[rows] = _rotl(h[rows] ^ _round(np.zeros(rows.size, np.uint64), eight[at[rows]]), 27) * _P1 + _P4
            at[rows] += 8
            rest[rows] -= 8
        rows = np.flatnonzero(rest >= 4)
        h[rows] = _rotl(h[rows] ^ (four[at[rows]].astype(np.uint64) * _P1), 23) * _P2 + _P3
        at[rows] += 4
        rest[rows] -= 4
        for k in range(3):
            rows = np.flatnonzero(rest >= 1)
            if not rows.size:
                break
            h[rows] = _rotl(h[rows] ^ (padded[at[rows]].astype(np.uint64) * _P5), 11) * _P1
            at[rows] += 1
            rest[rows] -= 1
        h = (h ^ (h >> _U(33))) * _P2
        h = (h ^ (h >> _U(29))) * _P3
        return h ^ (h >> _U(32))


#: A byte's eight bits, each in a byte of its own.
_SPREAD = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").copy().view("<u8").ravel()


def majority(hashes: np.ndarray, first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """For each row the bits set in over half of its hashes ``[first, first + count)``; none: 0."""
    out = np.zeros(len(first), np.uint64)
    rows = np.flatnonzero(count)
    if not rows.size:
        return out
    first, count = first[rows], count[rows]
    parts = -(-count // 255)  # a byte counts to 255
    owner = np.repeat(np.arange(rows.size), parts)
    head = np.concatenate(([0], np.cumsum(parts)))[:-1]
    begin = first[owner] + 255 * (np.arange(owner.size) - head[owner])
    spread = _SPREAD[np.ascontiguousarray(hashes).view(np.uint8).reshape(-1, 8)]
    sums = np.add.reduceat(spread, begin, axis=0).view(np.uint8)
    totals = np.add.reduceat(sums.astype(np.uint32), head, axis=0)
    out[rows] = np.packbits(2 * totals > count[:, None], axis=1, bitorder="little").view("<u8").ravel()
    return out


def shingle_hashes(texts: pa.Array, words: int) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of all texts' word shingles one behind the other, and how many each text has."""
    data, off = _bytes.raw(texts)
    data = data + ((data - np.uint8(65)) < 26).astype(np.uint8) * np.uint8(32)
    starts, ends, first = _bytes.word_spans(data, off)
    length = ends - starts
    plain, at = _bytes.gathered(data, starts, length, gap=1)
    n = np.diff(first)
    own = np.repeat(np.arange(len(n)), n)  # the row of each word
    rank = np.arange(len(starts)) - first[own]
    begins = np.flatnonzero(rank <= np.maximum(n[own] - words, 0))
    row = own[begins]
    last = np.where(n[row] >= words, begins + words - 1, first[row + 1] - 1)
    h = xxh64(plain, at[begins], at[last] + length[last] - at[begins])
    return h, np.where(n > 0, np.maximum(n - words + 1, 1), 0)


def fingerprints(texts: pa.Array, words: int = 3) -> np.ndarray:
    """The fingerprint of each text. Null and texts without a word have 0."""
    h, shingles = shingle_hashes(texts, words)
    return majority(h, np.concatenate(([0], np.cumsum(shingles)))[:-1], shingles)


def with_fingerprint(docs: DataFrame, words: int = 3, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(id, fp long) of every row; nothing else is kept."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _bytes.pieces(batches, "text"):
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(fingerprints(b.column("text"), words).view(np.int64))], ["id", "fp"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text).cast("string").alias("text")).mapInArrow(run, f"id {kind}, fp bigint")


def forest(fps: np.ndarray, distance: int, block: int = 256) -> tuple[np.ndarray, np.ndarray]:
    """Links (member, smallest member of its component) among one group's fingerprints.

    Labels sink to the least of their neighbours' until none changes; neighbours are found
    anew each round, ``block`` members at a time, so that no list of links is held.
    """
    n = len(fps)
    label = np.arange(n)
    while True:
        low = np.empty_like(label)
        for i in range(0, n, block):
            near = np.bitwise_count(fps[i : i + block, None] ^ fps[None, :]) <= distance
            low[i : i + block] = np.where(near, label, n).min(axis=1)
        low = np.minimum(low, low[low])
        if (low == label).all():
            break
        label = low
    rows = np.flatnonzero(label != np.arange(n))
    return fps[rows], fps[label[rows]]


def group_links(batches: Iterator[tuple[np.ndarray, np.ndarray]], distance: int, dense: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """From (key, fp) sorted by key: links (fp, other, -1), and (fp, 0, key) for members of groups beyond ``dense``.

    At most ``dense`` rows of the group in hand are held, whatever its size.
    """
    key, fps, over = np.zeros(0, np.int64), np.zeros(0, np.uint64), None

    def done(key: np.ndarray, fps: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        cuts = np.flatnonzero(np.diff(key)) + 1
        begin, end = np.concatenate(([0], cuts)), np.concatenate((cuts, [len(key)]))
        size = end - begin
        two = begin[size == 2]
        two = two[np.bitwise_count(fps[two] ^ fps[two + 1]) <= distance]
        out = [(fps[two], fps[two + 1])] if two.size else []
        hot = []
        for g in np.flatnonzero(size > 2):
            (hot if size[g] > dense else out).append((key[begin[g] : end[g]], fps[begin[g] : end[g]]) if size[g] > dense else forest(fps[begin[g] : end[g]], distance))
        for a, b in out:
            yield a, b, np.full(len(a), -1)
        for k, f in hot:
            yield f, np.zeros_like(f), k

    for k, f in batches:
        if over is not None:  # the rest of a group that is known to be hot
            n = int(np.searchsorted(k, over, "right"))
            yield f[:n], np.zeros(n, np.uint64), k[:n]
            if n == len(k):
                continue
            k, f, over = k[n:], f[n:], None
        key, fps = np.concatenate((key, k)), np.concatenate((fps, f))
        if not len(key):
            continue
        tail = int(np.searchsorted(key, key[-1]))
        if tail:
            yield from done(key[:tail], fps[:tail])
        key, fps = key[tail:], fps[tail:]
        if len(key) > dense:
            over = key[-1]
            yield fps, np.zeros_like(fps), key
            key, fps = key[:0], fps[:0]
    if len(key):
        yield from done(key, fps)


def _cleared(value: Column, bit: Column) -> Column:
    return value.bitwiseAND(F.bitwise_not(F.call_function("shiftleft", F.lit(1).cast("bigint"), bit)))


def links(fps: DataFrame, dense: int = 4096) -> DataFrame:
    """Links (a, b) whose components are those of all pairs at most two bits apart. ``fps``: distinct ``fp``."""
    half = F.when(F.col("w") < 32, F.shiftrightunsigned("fp", 32)).otherwise(F.col("fp").bitwiseAND(F.lit(0xFFFFFFFF)))
    bit = F.col("w") % 32
    keyed = fps.select("fp", F.explode(F.sequence(F.lit(0), F.lit(63))).alias("w")).select(
        "fp", F.shiftleft(F.col("w").cast("bigint"), 32).bitwiseOR(_cleared(half, bit)).alias("key")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = ((b.column("key").to_numpy(zero_copy_only=False), b.column("fp").to_numpy(zero_copy_only=False).view(np.uint64)) for b in batches if b.num_rows)
        for a, b, k in group_links(rows, 2, dense):
            yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64)), pa.array(k)], ["a", "b", "key"])
        _bytes.release()

    found = cut(keyed.repartition("key").sortWithinPartitions("key").mapInArrow(run, "a bigint, b bigint, key bigint").distinct())
    plain = found.where("key < 0").select("a", "b")
    hot = found.where("key >= 0")
    if hot.isEmpty():
        return plain
    # Beyond ``dense``: a second wildcard. One in either half, and two in the half
    # that is not the group's own where the group's half is the same.
    wild = hot.select(F.col("a").alias("fp"), F.shiftrightunsigned("key", 32).alias("w"))
    first = F.when(F.col("w") < 32, F.col("w") + 32).otherwise(F.col("w") - 32)
    lo = F.when(F.col("w") < 32, 0).otherwise(32)
    one = wild.select("fp", first.alias("i"), F.explode(F.sequence(lo, lo + 31)).alias("j"))
    sides = wild.select("fp", lo.alias("lo")).distinct()
    two = sides.select("fp", F.col("lo"), F.explode(F.sequence(F.col("lo"), F.col("lo") + 31)).alias("i")).where(F.col("i") < F.col("lo") + 31).select("fp", "i", F.explode(F.sequence(F.col("i") + 1, F.col("lo") + 31)).alias("j"))
    both = one.select("fp", F.least("i", "j").alias("i"), F.greatest("i", "j").alias("j")).unionByName(two).distinct()
    keys = both.select("fp", "i", "j", _cleared(_cleared(F.col("fp"), F.col("i").cast("int")), F.col("j").cast("int")).alias("v"))
    low = keys.groupBy("i", "j", "v").agg(F.min("fp").alias("b"), F.max("fp").alias("m")).where("b <> m")
    more = keys.join(low, ["i", "j", "v"]).where("fp <> b").select(F.col("fp").alias("a"), "b")
    return plain.unionByName(more).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for each node of ``edges(a, b)``; root is its component's smallest node.

    Alternating large and small stars: minima per node and joins, so hubs are split like
    any skewed join, and the edges of a round go to the shared folder.
    """
    def stars(edges: DataFrame, large: bool) -> DataFrame:
        """Large: each node's greater neighbours go to its least. Small: the others do, and the node itself."""
        pair = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges
        low = pair.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        near = pair.join(low, "u")
        moved = near.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")) if large else near.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
        return cut(moved.where("u <> v").distinct())

    now = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    state = None
    while True:
        now = stars(stars(now, True), False)
        told = now.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if tuple(told) == state:
            return now.groupBy("u").agg(F.min("v").alias("root")).select(F.col("u").alias("node"), "root")
        state = tuple(told)


def near_duplicates(docs: DataFrame, words: int = 3, dense: int = 4096, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(id_col, fingerprint string, component_id) of every row.

    Null and empty texts, and texts of white space alone, have fingerprint zero and link
    like any other; texts under ``words`` words are one shingle. A row with a null id keeps
    its fingerprint, and null ids do not count as the smallest of a component (null if it
    has no other). Repeated rows stay repeated. An empty table gives no rows; further
    columns of ``docs`` are not looked at.
    """
    marked = cut(with_fingerprint(docs, words, text, id_col))
    least = cut(marked.groupBy("fp").agg(F.min("id").alias("least")))
    root = components(links(least.select("fp"), dense))
    named = least.join(root, least.fp == root.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    smallest = named.groupBy("root").agg(F.min("least").alias("component_id"))
    of = named.join(smallest, "root").select(F.col("fp").alias("of_fp"), "component_id")
    return marked.join(of, marked.fp == of.of_fp).select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def query(spark, sf_dir: str) -> DataFrame:
    """op8: every document's fingerprint and component."""
    from tessera.llm._store import documents

    return near_duplicates(documents(spark, sf_dir))
