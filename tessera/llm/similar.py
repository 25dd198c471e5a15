"""Near copies by SimHash, completed: all pairs of texts whose word shingles have a Jaccard similarity of ``least`` or more.

Fingerprints of the same shingles, linked by the deletion-variant signatures of ``simhash``,
bring the nearest copies together at once; each such link is verified on the whole sets.
Fingerprints at most 2 bits apart, however, miss most pairs that are just above 0.8, and a
radius that reached them all would link whatever has a common passage. Hence the rest is
found by prefix filtering.

Prefix filtering: under one order of all shingles, two such sets share ``k`` of the first
``n - ceil(least * n) + k`` shingles of either, so an equality grouping on those brings
every such pair together and none is missed, whatever the order; and a pair that meets in
fewer groups is none. ``k`` grows with ``n``, so that texts with a passage in common, which
meet in a few, are seldom compared. The order puts the shingles that are common in a sample
last, so that a common passage makes no large groups.

Groups are not expanded into pairs at once. First each text meets one text alone: the one
that its fingerprint links it to or, of those that lead its groups, the one it shares most
with. What these links join is not compared again. Then each text meets the nearest one of
another component in each of its groups, then the 16 that follow, then 256, until
nothing is left: a round makes rows by the member, not by the pair, and near copies are
joined in the first ones. Each pair is decided by the whole sets of both texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tessera.llm import _bytes
from tessera.llm._store import cut, swept
from tessera.llm.simhash import components, links, majority, shingle_hashes

_LAST = np.uint64(1 << 63)
#: One text in so many is looked at for common shingles, and so many of these are put last.
SAMPLE, COMMON = 16, 1 << 18
#: Rows of shingles in a partition, and partitions at most.
ROWS_A_PART, MOST_PARTS = 400_000, 20_000
#: Bits of a set's bitmap.
BITS = 512
#: A text meets its hub first if they share this part of the groups that similar texts share; a lack of it is made up for later.
HALF = 0.5
#: So many pairs of one text are decided in one place; rows (some tens of bytes each) up to which a list of texts is sent to all executors.
SPLIT, BROADCAST_ROWS = 256, 2_000_000


def text_key(text: Column) -> Column:
    """Equal texts, and no others but by chance of 64 bits, have an equal key; null is empty."""
    return F.xxhash64(F.coalesce(text.cast("string"), F.lit("")))


def sets(texts: pa.Array, words: int, common: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, shingle) of every distinct shingle of every text, by row and then by the order of shingles."""
    return ordered(*shingle_hashes(texts, words), common)


def ordered(h: np.ndarray, count: np.ndarray, common: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same from all texts' shingle hashes and how many each has.

    A text without a word has one shingle of its own kind. ``common``: sorted (hash, place
    among the last) as two rows.
    """
    blank = np.flatnonzero(count == 0)
    row = np.concatenate((np.repeat(np.arange(len(count)), count), blank))
    h = np.concatenate((h >> np.uint64(1), np.zeros(blank.size, np.uint64)))
    if common.shape[1]:
        at = np.minimum(np.searchsorted(common[0], h), common.shape[1] - 1)
        h = np.where(common[0][at] == h, _LAST | common[1][at], h)
    order = np.lexsort((h, row))
    row, h = row[order], h[order]
    new = np.ones(len(h), bool)
    new[1:] = (row[1:] != row[:-1]) | (h[1:] != h[:-1])
    return row[new], h[new]


def shared(n: np.ndarray) -> np.ndarray:
    """In how many groups two similar sets meet at least, the smaller of which has ``n`` shingles."""
    return 1 + n // 20


def prefix(n: np.ndarray, least: float) -> np.ndarray:
    """How many of ``n`` shingles have to be looked at."""
    return np.minimum(n, n - np.ceil(least * n - 1e-9).astype(np.int64) + shared(n))


def common_shingles(docs: DataFrame, words: int) -> np.ndarray:
    """Hashes of the most common shingles of a sample, sorted, and the place of each by its count."""
    none = np.zeros((2, 0), np.uint64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _bytes.pieces(batches, "text"):
            h, n = np.unique(sets(b.column("text"), words, none)[1], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n.astype(np.int64))], ["h", "n"])

    some = docs.where(F.pmod("tid", F.lit(SAMPLE)) == 0).select("text").mapInArrow(run, "h bigint, n bigint")
    top = some.groupBy("h").agg(F.sum("n").alias("n")).where("n > 2").orderBy(F.desc("n"), "h").limit(COMMON).select("h").toArrow()
    h = top.column("h").to_numpy()[::-1].astype(np.int64).view(np.uint64)
    order = np.argsort(h)
    return np.stack((h[order], order.astype(np.uint64)))


def bitmaps(row: np.ndarray, h: np.ndarray, rows: int, bits: int = BITS) -> np.ndarray:
    """(row, byte): for each of ``bits`` bits, a power of two, whether an odd number of the row's shingles fall on it.

    Two sets differ in at least as many shingles as their bitmaps do in bits.
    """
    with np.errstate(over="ignore"):
        bit = ((h * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - bits.bit_length() + 1)).astype(np.int64)
    return np.packbits(np.bincount(row * bits + bit, minlength=rows * bits).reshape(rows, bits) & 1, axis=1)


def wide_bitmaps(row: np.ndarray, h: np.ndarray, n: np.ndarray) -> list[bytes]:
    """The bitmap of each row, of as many bits as it has shingles or up to twice as many, at least ``BITS``."""
    head = np.cumsum(n) - n
    return [bitmaps(row[i : i + k] * 0, h[i : i + k], 1, max(BITS, 1 << int(k - 1).bit_length())).tobytes() for i, k in zip(head, n)]


def differing(x: bytes, y: bytes) -> int:
    """In how many bits two bitmaps differ, the longer one folded to the length of the other."""
    x, y = sorted((np.frombuffer(x, np.uint8), np.frombuffer(y, np.uint8)), key=len)
    while len(x) < len(y):  # the highest bits of the product tell the bit, so neighbours fall together
        even, odd = np.unpackbits(y).reshape(-1, 2).T
        y = np.packbits(even ^ odd)
    return int(np.bitwise_count(x ^ y).sum())


def can_be(apart: np.ndarray, n: np.ndarray, m: np.ndarray, least: float) -> np.ndarray:
    """Whether sets of ``n`` and ``m`` shingles that differ in ``apart`` or more can be as similar as ``least``."""
    return apart * (1 + least) <= (n.astype(np.int64) + m) * (1 - least) + 1e-6


def looked_at(docs: DataFrame, words: int, least: float, common: np.ndarray) -> DataFrame:
    """(tid, n, fp, bits, wide, h) of every distinct text: the size of its set, its fingerprint, its bitmaps and its first shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _bytes.pieces(batches, "text"):
            raw, count = shingle_hashes(b.column("text"), words)
            fp = majority(raw, np.cumsum(count) - count, count)
            row, h = ordered(raw, count, common)
            n = np.bincount(row, minlength=b.num_rows)
            head = np.cumsum(n) - n
            take = prefix(n, least)
            first = np.arange(len(row)) - head[row] < take[row]
            off = np.concatenate(([0], np.cumsum(take))).astype(np.int32)
            bits = pa.array([x.tobytes() for x in bitmaps(row, h, b.num_rows)], pa.binary())
            wide = pa.array(wide_bitmaps(row, h, n), pa.binary())
            yield pa.RecordBatch.from_arrays([b.column("tid"), pa.array(n.astype(np.int32)), pa.array(fp.view(np.int64)), bits, wide, pa.ListArray.from_arrays(pa.array(off), pa.array(h[first].view(np.int64)))], ["tid", "n", "fp", "bits", "wide", "h"])

    found = docs.mapInArrow(run, "tid bigint, n int, fp bigint, bits binary, wide binary, h array<bigint>")
    return cut(found.groupBy("tid").agg(*[F.first(c).alias(c) for c in ("n", "fp", "bits", "wide", "h")]))


def grouped(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[list[np.ndarray]]:
    """Columns of rows sorted by their first, cut where it changes."""
    held = None
    for b in batches:
        if not b.num_rows:
            continue
        now = [b.column(x).to_numpy(zero_copy_only=False) for x in names]
        held = now if held is None else [np.concatenate(x) for x in zip(held, now)]
        tail = int(np.searchsorted(held[0], held[0][-1]))
        if tail:
            yield [x[:tail] for x in held]
            held = [x[tail:] for x in held]
    if held is not None:
        yield held
    held = now = None
    _bytes.release()


def hub_pairs(n: np.ndarray, first: np.ndarray, least: float) -> np.ndarray:
    """For each row, sorted by group, the row it is compared with first; itself if none.

    ``first`` is the place of the row's group. A hub serves the sizes that can be similar to its own.
    """
    hub = first.copy()
    while True:
        far = np.minimum(n[hub], n) < least * np.maximum(n[hub], n) - 1e-9
        if not far.any():
            return hub
        # the first of those that a hub cannot serve is the next hub of its group
        at = np.flatnonzero(far)
        lead = np.concatenate(([True], hub[at][1:] != hub[at][:-1]))
        hub[at] = at[lead][np.cumsum(lead) - 1]


def _groups(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    begin = np.concatenate(([0], np.flatnonzero(np.diff(key)) + 1))
    return begin, np.diff(np.concatenate((begin, [len(key)])))


def alike(marked: DataFrame) -> DataFrame:
    """Pairs (a, b) of text keys with a link between their fingerprints ``marked(id, fp)``; a key is ``b`` once at most."""
    least = cut(marked.groupBy("fp").agg(F.min("id").alias("least")))
    linked = links(least.select("fp")).where("a <> b").groupBy(F.greatest("a", "b").alias("fp")).agg(F.min(F.least("a", "b")).alias("other"))
    equal = marked.join(least, "fp").where("id <> least").select(F.col("least").alias("a"), F.col("id").alias("b"))
    other = least.select(F.col("fp").alias("other"), F.col("least").alias("a"))
    return equal.unionByName(linked.join(least, "fp").join(other, "other").select("a", F.col("least").alias("b")))


def dealt(rows: DataFrame, n: int, by: str) -> DataFrame:
    """``rows``, about ``n`` of them, in partitions of so many that two fit beside each other in a small executor."""
    return rows.repartition(min(MOST_PARTS, max(1, -(-n // ROWS_A_PART))), by)


def groups_of_several(keys: DataFrame) -> DataFrame:
    """(h, tid, n, size) of the members of groups of two or more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for h, tid, n in grouped(batches, ["h", "tid", "n"]):
            _, size = _groups(h)
            size = np.repeat(size, size)
            keep = size > 1
            yield pa.RecordBatch.from_arrays([pa.array(x[keep]) for x in (h, tid, n, size)], ["h", "tid", "n", "size"])

    return cut(dealt(keys, keys.count(), "h").sortWithinPartitions("h").mapInArrow(run, "h bigint, tid bigint, n int, size bigint"))


def stars(members: DataFrame, least: float) -> DataFrame:
    """(tid, n, hub): for each group the text that each could meet first, which is the one whose groups are the largest.

    Of many near copies of one text, two may be too far apart, but all are near that one; and
    it has what most of them have.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for h, tid, n in grouped(batches, ["h", "tid", "n"]):
            begin, size = _groups(h)
            hub = tid[hub_pairs(n, np.repeat(begin, size), least)]
            keep = hub != tid
            yield pa.RecordBatch.from_arrays([pa.array(x[keep]) for x in (tid, n, hub)], ["tid", "n", "hub"])

    central = members.groupBy("tid").agg(F.sum("size").alias("central"))
    ranked = dealt(members.join(central, "tid"), members.count(), "h").sortWithinPartitions("h", F.desc("central"), "tid").select("h", "tid", "n")
    return ranked.mapInArrow(run, "tid bigint, n int, hub bigint")


def of_several_roots(members: DataFrame) -> DataFrame:
    """The ``members(h, tid, n, was, root)`` of groups whose texts are not all joined yet."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for columns in grouped(batches, ["h", "tid", "n", "was", "root"]):
            begin, size = _groups(columns[0])
            keep = np.repeat(np.minimum.reduceat(columns[4], begin) != np.maximum.reduceat(columns[4], begin), size)
            yield pa.RecordBatch.from_arrays([pa.array(x[keep]) for x in columns], ["h", "tid", "n", "was", "root"])

    return cut(dealt(members, members.count(), "h").sortWithinPartitions("h").mapInArrow(run, "h bigint, tid bigint, n int, was bigint, root bigint"))


def of_roots(members: DataFrame, now: DataFrame) -> DataFrame:
    """``members`` and the root of each; a text that is joined with none is its own."""
    return members.join(now.withColumnRenamed("node", "tid"), "tid", "left").withColumn("root", F.coalesce("root", "tid"))


def nearest(members: DataFrame, seen: DataFrame, lo: int, hi: int, least: float, cells: int = 1 << 19) -> DataFrame:
    """(h, a, b): the pairs of a text and its ``lo``-th to ``hi``-th nearest in each group, and a row (h, null, null) where a group has more.

    A pair is looked at from the text that comes first by size, if the sizes and bitmaps of
    the two allow them to be similar and they had different roots at first (``was``), so that
    the places do not change while texts are joined; pairs joined since (``root``) are left
    out. A group makes at most ``hi - lo`` pairs a member, and a task makes a pair of many
    groups about once; ``h`` is null beside them.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0
        for h, tid, n, was, root, bits in grouped(batches, ["h", "tid", "n", "was", "root", "bits"]):
            begin, size = _groups(h)
            words, left = np.frombuffer(b"".join(bits), np.uint64).reshape(len(h), -1), np.zeros(len(begin), bool)
            for g, (s, k) in enumerate(zip(begin, size)):
                t, m, f, r, w = (x[s : s + k] for x in (tid, n, was, root, words))  # by size
                block = max(1, min(128, cells // int(k)))
                for i in range(0, k, block):
                    o = slice(i, i + block)
                    j = int(np.searchsorted(m, m[min(i + block, k) - 1] / least + 1, "right"))
                    x, y = np.nonzero((least * m[i:j] <= m[o, None] + 1e-9) & (f[o, None] != f[i:j]) & (np.arange(len(m[o]))[:, None] < np.arange(j - i)))
                    p, q, apart = i + x, i + y, np.zeros(x.size, np.int64)
                    for c in range(0, x.size, 1 << 16):
                        apart[c : c + (1 << 16)] = np.bitwise_count(w[p[c : c + (1 << 16)]] ^ w[q[c : c + (1 << 16)]]).sum(axis=1)
                    ok = np.flatnonzero(can_be(apart, m[p], m[q], least))
                    ok = ok[np.lexsort((apart[ok], p[ok]))]
                    p, q = p[ok], q[ok]
                    at, free = np.arange(p.size) - np.searchsorted(p, p), r[p] != r[q]
                    left[g] |= bool((free & (at >= hi)).any())
                    free &= (at >= lo) & (at < hi)
                    if free.any():
                        p, q = t[p[free]], t[q[free]]
                        held.append(np.stack((np.minimum(p, q), np.maximum(p, q)), axis=1))
                        rows += len(p)
                    if rows >= 1 << 18:
                        held = [np.unique(np.concatenate(held), axis=0)]
                        if (rows := len(held[0])) >= 1 << 17:
                            yield pairs(held[0])
                            held, rows = [], 0
            if left.any():
                none = pa.nulls(int(left.sum()), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(h[begin[left]]), none, none], ["h", "a", "b"])
        if held:
            yield pairs(np.unique(np.concatenate(held), axis=0))

    def pairs(of: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.nulls(len(of), pa.int64()), pa.array(of[:, 0].copy()), pa.array(of[:, 1].copy())], ["h", "a", "b"])

    marked = members.join(seen.select("tid", "bits"), "tid").select("h", "tid", "n", "was", "root", "bits")
    return cut(dealt(marked, members.count(), "h").sortWithinPartitions("h", "n", "tid").mapInArrow(run, "h bigint, a bigint, b bigint"))


def allowed(pairs: DataFrame, seen: DataFrame, least: float) -> DataFrame:
    """The pairs (a, b) whose bitmaps of a bit a shingle or more allow them to be similar."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, m = (b.column(x).to_numpy() for x in ("na", "nb"))
            apart = np.array([differing(x, y) for x, y in zip(b.column("wa").to_pylist(), b.column("wb").to_pylist())], np.int64)
            ok = pa.array(can_be(apart, n, m, least))
            yield pa.RecordBatch.from_arrays([b.column(x).filter(ok) for x in ("a", "b")], ["a", "b"])

    of = lambda end: seen.select(F.col("tid").alias(end), F.col("n").alias(f"n{end}"), F.col("wide").alias(f"w{end}"))
    return cut(pairs.join(of("a"), "a").join(of("b"), "b").select("a", "b", "na", "nb", "wa", "wb").mapInArrow(run, "a bigint, b bigint"))


def verified(pairs: DataFrame, docs: DataFrame, rows: DataFrame, words: int, least: float) -> DataFrame:
    """The pairs (a, b) whose texts are as similar as ``least``.

    Each text goes once to every text it is compared with, of which many in one place share
    a copy; a text that has more than ``SPLIT`` of them is dealt to several places.
    """
    none = np.zeros((2, 0), np.uint64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for b in _bytes.pieces(batches, "text"):
            b = b if held is None else pa.Table.from_batches([held, b]).combine_chunks().to_batches()[0]
            row, h = sets(b.column("text"), words, none)
            lead = b.column("lead").to_numpy(zero_copy_only=False)
            hub = np.maximum.accumulate(np.where(lead, np.arange(b.num_rows), 0))
            place = np.unique(h, return_inverse=True)[1] + (hub[row] << 32)
            same = np.isin(place, place[lead[row]])
            size = np.bincount(row, minlength=b.num_rows)
            both = np.bincount(row[same], minlength=b.num_rows)
            ok = np.flatnonzero(~lead & (both >= least * (size + size[hub] - both) - 1e-9))
            yield pa.RecordBatch.from_arrays([b.column("a").take(pa.array(ok)), b.column("tid").take(pa.array(ok))], ["a", "b"])
            held = b.slice(int(hub[-1]), 1)

    busy = pairs.groupBy("a").count().where(F.col("count") > SPLIT).select("a", F.ceil(F.col("count") / SPLIT).alias("ways"))
    spread = pairs.join(busy, "a", "left").select("a", "b", F.coalesce(F.pmod(F.xxhash64("b"), F.col("ways")), F.lit(0)).cast("int").alias("part"))
    leads = spread.select("a", F.col("a").alias("tid"), "part", F.lit(True).alias("lead")).distinct()
    need = cut(leads.unionByName(spread.select("a", F.col("b").alias("tid"), "part", F.lit(False).alias("lead"))).join(rows, "tid"))
    need = F.broadcast(need) if need.count() <= BROADCAST_ROWS else need
    both = docs.join(need, ["tid", "row"]).select("a", "part", "lead", "tid", "text")
    return cut(both.repartition("a", "part").sortWithinPartitions("a", "part", F.desc("lead")).mapInArrow(run, "a bigint, b bigint"))


def roots(docs: DataFrame, words: int = 5, least: float = 0.8) -> DataFrame:
    """(node, root) of every text key of ``docs(tid, row, text)`` that has near copies with another key.

    ``row`` tells rows with an equal text apart. Components of all pairs of texts with a
    Jaccard similarity of ``least`` or more; texts of fewer than ``words`` words are one
    shingle, texts without a word are alike.
    """
    if not 0 < least <= 1:
        raise ValueError(f"least is {least}; a number above 0 and up to 1 is asked for")
    rows = cut(docs.groupBy("tid").agg(F.min("row").alias("row")))
    keyed = docs.select("tid", "text")
    seen = looked_at(keyed, words, least, common_shingles(keyed, words))
    members = groups_of_several(seen.select(F.explode("h").alias("h"), "tid", "n"))
    near = cut(alike(seen.select(F.col("tid").alias("id"), "fp")))
    met = stars(members, least).groupBy("tid", "n", "hub").count().where(F.col("count") > F.col("n") / 20 * HALF)
    led = met.groupBy("tid").agg(F.min_by("hub", F.struct(-F.col("count"), "hub")).alias("a")).select("a", F.col("tid").alias("b"))
    pairs = cut(near.unionByName(led.join(near.select("b"), "b", "left_anti").select("a", "b")))
    swept(docs.sparkSession)
    now = cut(components(verified(pairs, docs, rows, words, least)))
    done = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    members = of_roots(members, now).withColumn("was", F.col("root"))
    lo, hi = 0, 1
    while True:
        swept(docs.sparkSession)
        # the nearest text of each first, then the 16 that follow, then 256, until no group has any left
        open_ = of_several_roots(members.select("h", "tid", "n", "was", "root"))
        if open_.isEmpty():
            return now
        met = nearest(open_, seen, lo, hi, least)
        left = allowed(met.where("a is not null").select("a", "b").distinct().join(done, ["a", "b"], "left_anti"), seen, least)
        more = verified(left, docs, rows, words, least)
        swept(docs.sparkSession)
        if not more.isEmpty():
            now = cut(components(now.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(more)))
        members = of_roots(open_.drop("root").join(met.where("a is null").select("h"), "h"), now)
        lo, hi = hi, 16 * hi + 1
