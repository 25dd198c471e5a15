"""Packing along a space-filling curve.

Documents are tokenized once into a table in the shared folder, each with its hashed
vector: every token id adds a pseudo-random sign in each of a few dimensions. The drift
that common ids give to all documents is taken off, the sums are scaled to the corpus's
spread and cut to a grid of about equal shares, whose cells are put in order by a Hilbert
curve. A histogram of ids over coarse stretches of the curve tells which range of about
equal size a document lies in; a stretch that reaches over several ranges (a third of all
rows may share one place) is dealt to them by a hash of the row. Each range is sorted by
place and packed as one stream cut every ``length`` ids: neighbours on the curve share
sequences. The end of a range is cut into sequences of power-of-two lengths, which need no
padding.
"""

from __future__ import annotations

import functools
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from tessera.llm import _bytes
from tessera.llm._store import cut, documents, written
from tessera.llm.encoding import encoder

DIMS, GRID = 4, 10
#: The first bits of a place that name its stretch of the curve; a row of two numbers for each is sent to all executors.
STRETCH = 18
SUMS = [f"d{d}" for d in range(DIMS)]


@functools.cache
def signs(vocab: int) -> np.ndarray:
    """For each id a 1 in those of four 16-bit lanes whose dimension it adds to, from a hash of the id."""
    with np.errstate(over="ignore"):
        h = (np.arange(vocab, dtype=np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(31)
    return sum(((h >> np.uint64(8 * d)) & np.uint64(1)) << np.uint64(16 * d) for d in range(DIMS))


def vectors(ids: np.ndarray, upto: np.ndarray, vocab: int) -> np.ndarray:
    """The (document, dimension) sums of signs."""
    n = np.diff(upto)
    parts = np.maximum(1, -(-n // 65535))  # a lane counts to 65,535
    head = np.cumsum(parts) - parts
    begin = np.repeat(upto[:-1], parts) + 65535 * (np.arange(int(parts.sum())) - np.repeat(head, parts))
    lanes = np.add.reduceat(np.append(signs(vocab)[ids], np.uint64(0)), begin).view("<u2").reshape(-1, DIMS)
    plus = np.add.reduceat(lanes.astype(np.int64), head, axis=0)
    plus[n == 0] = 0
    return 2 * plus - n[:, None]


def hilbert(cells: np.ndarray, bits: int) -> np.ndarray:
    """The place on the Hilbert curve of integer cells (row, dimension), by Skilling's transform."""
    x = cells.astype(np.int64).T.copy()
    dims = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        for i in range(dims):
            hit = (x[i] & q) != 0
            swap = (x[0] ^ x[i]) & (q - 1)
            x[0] ^= np.where(hit, q - 1, swap)
            x[i] ^= np.where(hit, 0, swap)
        q >>= 1
    for i in range(1, dims):
        x[i] ^= x[i - 1]
    turn, q = np.zeros_like(x[0]), 1 << (bits - 1)
    while q > 1:
        turn ^= np.where(x[-1] & q, q - 1, 0)
        q >>= 1
    x ^= turn
    place = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(dims):
            place = (place << 1) | ((x[i] >> b) & 1)
    return place


def places(sums: np.ndarray, n: np.ndarray, drift: np.ndarray, spread: np.ndarray) -> np.ndarray:
    """Each document's place on the curve, from its ``vectors`` sums and its number of ids.

    The logistic curve gives the cells about equal shares and leaves no sum outside.
    """
    z = (sums - n[:, None] * drift) / np.sqrt(np.maximum(n, 1))[:, None] / spread
    cells = np.minimum((1 << GRID) / (1 + np.exp(np.clip(-1.7 * z, -40, 40))), (1 << GRID) - 1)
    return hilbert(cells.astype(np.int64), GRID)


def tokenized(docs: DataFrame, tokenizer: str, end_id: int, text: str, id_col: str) -> DataFrame:
    """(id, n, d0 to d3, ids binary) of every row: ids as 16 or 32 bits, as the vocabulary needs, ``n`` of them with the end id, and the sums of signs without it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        vocab = enc.library.get_vocab_size() + 1
        kind = np.dtype("<u2" if vocab <= 65536 else "<u4")
        for b in _bytes.pieces(batches, "text", 1 << 18):
            ids, upto = enc.encode(b.column("text"))
            closed = np.insert(ids, upto[1:], end_id).astype(kind)
            n = np.diff(upto) + 1
            off = np.concatenate(([0], np.cumsum(n))) * kind.itemsize
            blob = pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer(off.astype(np.int32)), pa.py_buffer(closed)])
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(n), *map(pa.array, vectors(ids, upto, vocab).T), blob], ["id", "n", *SUMS, "ids"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text).cast("string").alias("text")).mapInArrow(run, f"id {kind}, n bigint, {', '.join(f'{d} bigint' for d in SUMS)}, ids binary")


def placed(found: DataFrame) -> DataFrame:
    """``found`` with ``place``, by the drift and spread of all documents; a few sums come to the driver."""
    n = F.col("n") - 1
    stats = [x for d in SUMS for x in (F.sum(d), F.sum(F.pow(F.col(d), F.lit(2)) / F.greatest(n, F.lit(1))))]
    total, *told = (x or 0 for x in found.agg(F.sum(n), F.count("*"), *stats).first())
    rows, first, second = max(1, told[0]), np.array(told[1::2], float), np.array(told[2::2], float)
    drift = first / max(1, total)
    spread = np.sqrt(np.maximum((second - 2 * drift * first + drift**2 * total) / rows, 1e-6))

    @F.arrow_udf("bigint")
    def place(n: pa.Array, *sums: pa.Array) -> pa.Array:
        return pa.array(places(np.stack([x.to_numpy(zero_copy_only=False) for x in sums], axis=1), n.to_numpy(zero_copy_only=False) - 1, drift, spread))

    return found.withColumn("place", place("n", *SUMS))


def ranged(found: DataFrame, ids_a_range: int, most_ranges: int) -> tuple[DataFrame, int]:
    """``found`` with ``range``, of about ``ids_a_range`` ids each and in the curve's order, and how many there are.

    Beyond ``most_ranges`` they hold more. ``found`` is a table in files; a row's place in
    them decides where in a stretch of several ranges it lies, so that even equal rows spread.
    """
    stretch = F.shiftrightunsigned("place", DIMS * GRID - STRETCH)
    sums = cut(found.groupBy(stretch.alias("stretch")).agg(F.sum("n").alias("weight")))
    total = sums.agg(F.sum("weight")).first()[0] or 0
    ranges = min(most_ranges, max(1, -(-total // ids_a_range)))
    before = F.sum("weight").over(W.orderBy("stretch").rowsBetween(W.unboundedPreceding, -1))  # 2 ** STRETCH rows at most
    ends = sums.select("stretch", F.coalesce(before, F.lit(0)).alias("before"), "weight")
    part = F.shiftrightunsigned(F.xxhash64(F.regexp_extract("_metadata.file_name", r"part-(\d+)", 1), "_metadata.row_index"), 11).cast("double") / float(1 << 53)
    at = F.floor((F.col("before") + F.col("weight") * F.col("part")) * ranges / max(1, total))
    marked = found.withColumn("part", part).withColumn("stretch", stretch).join(F.broadcast(ends), "stretch")
    return marked.withColumn("range", F.least(at, F.lit(ranges - 1)).cast("int")), ranges


class Packer:
    """One stream of ids, cut every ``length``; what the last cut left over is cut at powers of two."""

    def __init__(self, length: int):
        self.length, self.done = length, 0
        self.open: list[tuple] = []  # pieces of the sequence that is not full: (id, start, ids, doc_tokens)
        self.filled = 0

    def add(self, ids: np.ndarray, upto: np.ndarray, names: list) -> list[tuple]:
        """Rows (id, start, length, crc, doc_tokens, sequence, offset) of the sequences that are full now."""
        out = []
        for i, name in enumerate(names):
            at, end = int(upto[i]), int(upto[i + 1])
            start, n = 0, end - at
            while at < end:
                take = min(end - at, self.length - self.filled)
                self.open.append((name, start, ids[at : at + take], n))
                self.filled += take
                at, start = at + take, start + take
                if self.filled == self.length:
                    out += self._close()
        self.open = [(a, b, c.copy(), d) for a, b, c, d in self.open]
        return out

    def _close(self) -> list[tuple]:
        out, offset = [], 0
        for name, start, ids, n in self.open:
            out.append((name, start, len(ids), zlib.crc32(ids), n, self.done, offset))
            offset += len(ids)
        self.done, self.open, self.filled = self.done + 1, [], 0
        return out

    def finish(self) -> list[tuple]:
        out, rest, left, full = [], self.open, self.filled, self.length
        self.open, self.filled = [], 0
        while left:
            self.length = 1 << (left.bit_length() - 1)
            left -= self.length
            while self.filled < self.length:
                name, start, ids, n = rest[0]
                take = min(len(ids), self.length - self.filled)
                self.open.append((name, start, ids[:take], n))
                self.filled += take
                rest = ([(name, start + take, ids[take:], n)] if take < len(ids) else []) + rest[1:]
            out += self._close()
        self.length = full
        return out


def pack(docs: DataFrame, length: int = 1024, tokenizer: str = "byte_bpe_50k.json", end_id: int = 0, ids_a_range: int = 4_000_000, most_ranges: int = 20_000, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(id_col, start, length, ids_crc32, doc_tokens, sequence_id, offset) of every piece.

    Null and empty texts have their end id alone. Each row is packed, repeated ones as often
    as they come, and a null id is an id. A text of any length is tokenized whole. Sequence
    ids are unique, not gapless: the range's number, then the sequence's in it. Other columns
    are not read. An empty table gives no rows.
    """
    found = written(tokenized(docs, tokenizer, end_id, text, id_col), "packing")
    marked, ranges = ranged(placed(found), ids_a_range, most_ranges)
    by = ["place", "id", "ids"]
    dealt = marked.select("range", *by).repartitionById(ranges, "range").sortWithinPartitions("range", F.col("place"), F.xxhash64("id"), "id", "ids").select("range", "id", "ids")
    names = ["id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer, now, id_type = Packer(length), None, None
        width = np.dtype("<u2" if encoder(tokenizer).library.get_vocab_size() + 1 <= 65536 else "<u4")

        def rows(found: list[tuple]) -> pa.RecordBatch:
            columns = list(zip(*found, strict=True))
            arrays = [pa.array(columns[0], id_type), *[pa.array(c, pa.int64()) for c in columns[1:5]], pa.array(np.array(columns[5], np.int64) + (now << 40)), pa.array(columns[6], pa.int64())]
            return pa.RecordBatch.from_arrays(arrays, names)

        for whole in _bytes.pieces(batches, "ids"):
            id_type = whole.schema.field("id").type
            own = whole.column("range").to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(own)) + 1).tolist(), len(own)]
            for lo, hi in zip(cuts[:-1], cuts[1:]):
                if own[lo] != now:
                    if now is not None and (rest := packer.finish()):
                        yield rows(rest)
                    packer, now = Packer(length), int(own[lo])
                b = whole.slice(lo, hi - lo)
                data, off = _bytes.raw(b.column("ids"))
                ids = np.frombuffer(data, width).astype("<u4")
                if full := packer.add(ids, off // width.itemsize, b.column("id").to_pylist()):
                    yield rows(full)
        if now is not None and (rest := packer.finish()):
            yield rows(rest)

    return dealt.mapInArrow(run, f"id {kind}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint").withColumnRenamed("id", id_col)


def query(spark, sf_dir: str) -> DataFrame:
    """op10: every document packed into sequences of 1,024."""
    return pack(documents(spark, sf_dir))
