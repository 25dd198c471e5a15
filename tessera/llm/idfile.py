"""Token ids in files, coded by an adaptive context-mixing range coder.

Three predictions of the next id are mixed into one interval each: the id that last
followed the two ids before (order 2), the one that last followed the id before (order 1),
and all ids as often as the block has had them (order 0). An order's interval is as wide as
its context's confidence, averaged with how often that order was right of late in this
lane; what the two leave over belongs to order 0, with an escape for ids that are new to
the block, spelled out evenly. Everything adapts as it goes, on integers alone, so that any
machine decodes what another has coded. A carry-less 64-bit range coder turns each id's
interval into 16-bit words.

A block of ``BLOCK`` ids starts from a fresh model and carries the CRC of its ids, so it
can be decoded, checked and repaired by itself. Within a block, ``LANES`` equal parts are
coded side by side with a coder each and one model for all, and the blocks of a segment
go in step too: numpy then codes a few thousand ids at a time.

A segment holds about ``SEGMENT`` ids of whole documents in id order, and is one row of a
Parquet file: its number, the documents' ids and lengths, its blocks and their CRCs. Files
are written and committed by Spark, on whatever store the path names.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from tessera.llm import _bytes
from tessera.llm._store import documents, shared_dir
from tessera.llm.encoding import encoder

LANES, BLOCK, SEGMENT = 512, 1 << 18, 1 << 23
#: About so many blocks are coded in step; their tables fit a core's cache.
GROUP = 8
#: Up to so many segments (24 bytes each) their places in the whole are sent to all executors.
BROADCAST_ROWS = 1_000_000
#: Order 0 deals out 2**16 slots; so do the two candidates and what they leave over.
SLOTS = 1 << 16
LEAST, FRESH, STALE = 2048, 12000, 9000
_U = np.uint64


class _Model:
    """The mixed predictions in each lane of some blocks; the same steps for coder and decoder.

    Row 0 of the paired arrays is order 2 and row 1 order 1. A context's entry holds its
    candidate and how far that is trusted, an id's entry its slots' first and number.
    """

    def __init__(self, blocks: int, bits: int, slots: bool):
        lanes = np.repeat(np.arange(blocks), LANES)
        self.blocks, self.bits = blocks, bits
        wide = max(bits, 16)
        self.base, self.base2 = lanes << bits, lanes << 16
        self.bases = np.stack((lanes << wide, (lanes + blocks) << wide))
        self.context = np.zeros(2 * blocks << wide, np.uint32 if bits <= 16 else np.uint64)
        self.recent = np.zeros((2, len(lanes)), np.int32)
        self.one = self.two = np.zeros(len(lanes), np.int64)
        self.counts = np.zeros(blocks << bits, np.int32)
        self.distinct = np.zeros(blocks, np.int64)
        self.entry = np.zeros(blocks << bits, np.uint32)
        self.new = np.full(len(lanes), SLOTS - 1, np.uint32)  # the escape's entry; its slots are the last
        self.slot = np.full(blocks << 16, -1, np.int32) if slots else None
        self.pending: list[np.ndarray] = []
        self.step, self.rebuild_at = 0, 1
        self.at = np.empty((2, len(lanes)), np.int64)

    def predict(self) -> None:
        """Sets the candidates, and the widths f2, f1 and rest of the three intervals, which sum to SLOTS."""
        np.add(self.bases[0], ((self.one * 0x9E3779B1 + self.two * 0x85EBCA6B) >> 7) & 0xFFFF, out=self.at[0])
        np.add(self.bases[1], self.one, out=self.at[1])
        entry = self.context[self.at]
        self.guess, self.trust = (entry >> 16).astype(np.int32), (entry & 0xFFFF).astype(np.int32)
        sure = (self.trust + self.recent) >> 1
        self.f2 = np.minimum(sure[0], SLOTS - 2 * LEAST) + 1
        self.f1 = (sure[1].astype(np.int64) * (SLOTS - LEAST - self.f2) >> 16) + 1
        self.both = (self.f1 + self.f2).astype(np.uint64)
        self.rest = _U(SLOTS) - self.both

    def update(self, ids: np.ndarray, hit: np.ndarray) -> None:
        """``hit``: whether each order's candidate was the id."""
        goal = hit * np.int32(65535)
        trust = self.trust + ((goal - self.trust) >> 3)
        anew = ((trust < STALE) & ~hit).astype(np.int32)  # arithmetic, as no processor foresees these
        guess = self.guess + (ids.astype(np.int32) - self.guess) * anew
        trust += (FRESH - trust) * anew
        self.context[self.at] = (guess.astype(self.context.dtype) << 16) | trust.astype(self.context.dtype)
        self.recent += (goal - self.recent) >> 5
        self.two, self.one = self.one, ids
        self.pending.append(self.base + ids)
        self.step += 1
        if self.step == self.rebuild_at:
            self._rebuild()
            self.rebuild_at += max(1, self.step * 3 // 4)

    def _rebuild(self) -> None:
        """Order 0 anew from all ids so far; the escape is as wide as new ids were common since the last time."""
        since = len(self.pending) * LANES
        self.counts += np.bincount(np.concatenate(self.pending), minlength=len(self.counts)).astype(np.int32)
        self.pending = []
        least, seen = 1, np.flatnonzero(self.counts)
        while (distinct := np.bincount(seen >> self.bits, minlength=self.blocks)).max() > SLOTS // 2:  # rare ids stay with the escape
            least += 1
            seen = np.flatnonzero(self.counts >= least)
        block = seen >> self.bits
        wish = SLOTS * (distinct - self.distinct + 1) // (since + 2) if least == 1 else np.full(self.blocks, SLOTS // 2)
        free = np.maximum(SLOTS - 1 - distinct - np.clip(wish, 16, SLOTS // 2), 0)
        self.distinct = distinct
        share = 1 + self.counts[seen] * free[block] // (self.step * LANES)
        upto = np.cumsum(share)
        ends = np.cumsum(distinct)
        total = np.diff(np.concatenate(([0], upto))[np.concatenate(([0], ends))])
        below = upto - share - (np.cumsum(total) - total)[block]
        if least > 1:
            self.entry[:] = 0
        self.entry[seen] = (below << 16) | share
        self.new = np.repeat((total << 16) | (SLOTS - total), LANES).astype(np.uint32)
        if self.slot is not None:
            for b in range(self.blocks):
                lo, hi = ends[b] - distinct[b], ends[b]
                self.slot[b << 16 : (b << 16) + total[b]] = np.repeat(seen[lo:hi] - (b << self.bits), share[lo:hi])
                self.slot[(b << 16) + total[b] : (b + 1) << 16] = -1


def _laid_out(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First id and number of ids of each lane of blocks of these sizes, one behind the other."""
    per = -(-sizes // LANES)
    lane = np.arange(LANES)
    first = np.minimum(lane[None, :] * per[:, None], sizes[:, None])
    count = np.minimum(first + per[:, None], sizes[:, None]) - first
    return (first + (np.cumsum(sizes) - sizes)[:, None]).ravel(), count.ravel()


class _Coder:
    """The range coders' state in all lanes: intervals of 64-bit numbers, moved on by 16 bits."""

    def __init__(self, width: int):
        self.low, self.range = np.zeros(width, np.uint64), np.full(width, 0xFFFFFFFFFFFFFFFF, np.uint64)

    def narrow(self, start: np.ndarray, size: np.ndarray, bits: int) -> None:
        self.range >>= _U(bits)
        self.low += self.range * start
        self.range *= size

    def spell(self, ids: np.ndarray, bits: int, rows: np.ndarray) -> None:
        """An id as one of ``2 ** bits``, in some lanes."""
        unit = self.range[rows] >> _U(bits)
        self.low[rows] += unit * ids.astype(np.uint64)
        self.range[rows] = unit

    def ready(self, rows: np.ndarray | None = None) -> np.ndarray:
        """Lanes whose first 16 bits are settled, having cut short those whose interval is too narrow to go on."""
        low, wide = (self.low, self.range) if rows is None else (self.low[rows], self.range[rows])
        settled = (low ^ (low + wide)) < _U(1 << 48)
        narrow = wide < _U(1 << 40)
        narrow &= ~settled
        if narrow.any():
            cut = np.flatnonzero(narrow)
            at = cut if rows is None else rows[cut]
            self.range[at] = (_U(0) - low[cut]) & _U((1 << 40) - 1)
            settled |= narrow
        out = np.flatnonzero(settled)
        return out if rows is None else rows[out]

    def move(self, rows: np.ndarray) -> None:
        self.low[rows] <<= _U(16)
        self.range[rows] <<= _U(16)


def _intervals(model: _Model, entry: np.ndarray, two: np.ndarray, one: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and size, of 2**32, of each lane's id: its candidate's interval in the lanes ``two`` and ``one``, else its slots of the rest."""
    size = (entry & 0xFFFF) * model.rest
    start = (entry >> 16) * model.rest + (model.both << _U(16))
    start[two] = 0
    size[two] = model.f2[two].astype(np.uint64) << _U(16)
    start[one] = model.f2[one].astype(np.uint64) << _U(16)
    size[one] = model.f1[one].astype(np.uint64) << _U(16)
    return start, size


def encode(ids: np.ndarray, bits: int) -> list[bytes]:
    """The coded blocks of ``ids`` (all under ``2 ** bits``)."""
    return [b for lo, hi in _groups(-(-len(ids) // BLOCK)) for b in _encode(ids[lo * BLOCK : hi * BLOCK], bits)]


def _groups(blocks: int) -> list[tuple[int, int]]:
    """Blocks dealt evenly to groups, so that none is left over to run all steps by itself."""
    n = max(1, round(blocks / GROUP))
    return [(blocks * k // n, blocks * (k + 1) // n) for k in range(n if blocks else 0)]


def _encode(ids: np.ndarray, bits: int) -> list[bytes]:
    sizes = np.diff(np.append(np.arange(0, len(ids), BLOCK), len(ids)))
    first, count = _laid_out(sizes)
    width, steps = len(first), int(count.max())
    model, coder = _Model(len(sizes), bits, slots=False), _Coder(width)
    out = np.zeros((width, steps * 4 + 16), np.uint16)
    fill = np.zeros(width, np.int64)
    padded = np.append(ids.astype(np.int64), 0)

    def emit() -> None:
        rows = coder.ready()
        while rows.size:
            at = fill[rows]
            out[rows, at] = coder.low[rows] >> _U(48)
            fill[rows] = at + 1
            coder.move(rows)
            rows = coder.ready(rows)

    for t in range(steps):
        symbol = padded[np.where(t < count, first + t, len(ids))]  # a lane that is done codes zeros
        model.predict()
        hit = model.guess == symbol
        entry = model.entry[model.base + symbol]
        new = entry == 0
        rows = np.flatnonzero(new)
        entry[rows] = model.new[rows]
        coder.narrow(*_intervals(model, entry, np.flatnonzero(hit[0]), np.flatnonzero(hit[1] & ~hit[0])), 32)
        emit()
        rows = np.flatnonzero(new & ~hit[0] & ~hit[1])
        if rows.size:
            coder.spell(symbol[rows], bits, rows)
            emit()
        model.update(symbol, hit)
    last = coder.low + coder.range - _U(1)  # two words of it lie in the interval, whatever follows them
    out[np.arange(width), fill] = last >> _U(48)
    out[np.arange(width), fill + 1] = (last >> _U(32)) & _U(0xFFFF)
    fill += 2
    blocks = []
    for k, size in enumerate(sizes):
        lanes = slice(k * LANES, (k + 1) * LANES)
        used = np.arange(out.shape[1])[None, :] < fill[lanes, None]
        blocks.append(np.array([size, bits], "<u4").tobytes() + fill[lanes].astype("<u2").tobytes() + out[lanes][used].astype("<u2").tobytes())
    return blocks


def decode(blocks: list[bytes]) -> np.ndarray:
    """The ids of coded blocks, all of one ``bits``."""
    parts = [_decode(blocks[lo:hi]) for lo, hi in _groups(len(blocks))]
    return np.concatenate(parts) if parts else np.zeros(0, np.uint32)


def _decode(blocks: list[bytes]) -> np.ndarray:
    sizes = np.array([np.frombuffer(b, "<u4", 1)[0] for b in blocks], np.int64)
    bits = int(np.frombuffer(blocks[0], "<u4", 2)[1])
    fill = np.concatenate([np.frombuffer(b, "<u2", LANES, 8) for b in blocks]).astype(np.int64)
    data = np.frombuffer(b"".join(b[8 + 2 * LANES :] for b in blocks) + bytes(4), "<u2").astype(np.uint64)
    at = np.cumsum(fill) - fill
    end = at + fill
    last = len(data) - 1  # a zero, read behind a lane's end
    first, count = _laid_out(sizes)
    width, steps = len(first), int(count.max())
    model, coder = _Model(len(sizes), bits, slots=True), _Coder(width)
    code = np.zeros(width, np.uint64)
    for _ in range(4):
        code = (code << _U(16)) | data[np.where(at < end, at, last)]
        at = at + 1
    out = np.zeros(int(sizes.sum()) + 1, np.uint32)

    def take() -> None:
        rows = coder.ready()
        while rows.size:
            coder.move(rows)
            here = at[rows]
            code[rows] = (code[rows] << _U(16)) | data[np.where(here < end[rows], here, last)]
            at[rows] = here + 1
            rows = coder.ready(rows)

    for t in range(steps):
        model.predict()
        value = np.minimum((code - coder.low) // (coder.range >> _U(32)), _U(0xFFFFFFFF))
        edge = model.both << _U(16)
        candidate = value < edge
        # whole numbers under 2**32 by such under 2**17: the quotient of doubles has the right floor
        slot = ((np.maximum(value, edge) - edge).astype(np.float64) / model.rest.astype(np.float64)).astype(np.int64)
        symbol = model.slot[model.base2 + slot].astype(np.int64)
        new = symbol < 0
        rows = np.flatnonzero(new)
        symbol[rows] = 0
        entry = model.entry[model.base + symbol]
        entry[rows] = model.new[rows]
        two = value < model.f2.astype(np.uint64) << _U(16)
        one, two = np.flatnonzero(candidate & ~two), np.flatnonzero(two)
        coder.narrow(*_intervals(model, entry, two, one), 32)
        take()
        rows = np.flatnonzero(new & ~candidate)
        if rows.size:
            plain = np.minimum((code[rows] - coder.low[rows]) // (coder.range[rows] >> _U(bits)), _U((1 << bits) - 1)).astype(np.int64)
            coder.spell(plain, bits, rows)
            take()
            symbol[rows] = plain
        symbol[two], symbol[one] = model.guess[0][two], model.guess[1][one]
        model.update(symbol, model.guess == symbol)
        out[np.where(t < count, first + t, len(out) - 1)] = symbol
    return out[:-1]


def write_ids(docs: DataFrame, path: str, tokenizer: str = "word_bpe_49k.json", end_id: int = 1, bytes_a_part: int = 12 << 20, most_parts: int = 20_000, text: str = "text", id_col: str = "doc_id") -> None:
    """The ids of all documents, each followed by ``end_id``, to ``path`` in ascending id order.

    Null texts count as empty and have the end id alone; null ids come first; equal ids lie
    together, by a hash of the text. An empty table gives files without segments. Beyond ``most_parts``
    parts they grow, and have more segments each. Rows of one id are parted by their text, and
    equal rows by where they lie, so that no id is one task's.
    """
    slim = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    parts = min(most_parts, max(1, -(-(slim.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // bytes_a_part)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        bits = max(enc.library.get_vocab_size() - 1, end_id).bit_length()
        part, segment, names, lengths, ids, held = None, 0, [], [], [], 0

        def closed() -> pa.RecordBatch:
            nonlocal segment, names, lengths, ids, held
            whole = np.concatenate(ids)
            blocks = encode(whole, bits)
            sums = [zlib.crc32(whole[k : k + BLOCK].astype("<u4")) for k in range(0, len(whole), BLOCK)]
            row = [[part], [segment], [len(whole)], [names], [lengths], [blocks], [sums]]
            kinds = [pa.int32(), pa.int32(), pa.int64(), pa.list_(id_type), pa.list_(pa.int64()), pa.list_(pa.binary()), pa.list_(pa.int64())]
            segment, names, lengths, ids, held = segment + 1, [], [], [], 0
            return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(row, kinds, strict=True)], ["part", "segment", "n_ids", "docs", "lengths", "blocks", "crcs"])

        for b in _bytes.pieces(batches, "text"):
            part, id_type = b.column("part")[0].as_py(), b.schema.field("id").type
            found, upto = enc.encode(b.column("text"))
            at, n = 0, b.num_rows
            named = b.column("id").to_pylist()
            while at < n:  # whole documents until the segment is full
                to = min(n, max(at + 1, int(np.searchsorted(upto + np.arange(n + 1), upto[at] + at + SEGMENT - held, "left"))))
                names += named[at:to]
                lengths += (np.diff(upto[at : to + 1]) + 1).tolist()
                ids.append(np.insert(found[upto[at] : upto[to]], upto[at + 1 : to + 1] - upto[at], end_id))
                held += len(ids[-1])
                at = to
                if held >= SEGMENT:
                    yield closed()
        if held:
            yield closed()

    kind = docs.schema[id_col].dataType.simpleString()
    dealt = slim.withColumns({"hash": F.xxhash64("text"), "row": F.monotonically_increasing_id()}).repartitionByRange(parts, "id", "hash", "row").sortWithinPartitions("id", "hash", "row").select("id", "text", F.spark_partition_id().alias("part"))
    rows = dealt.mapInArrow(run, f"part int, segment int, n_ids bigint, docs array<{kind}>, lengths array<bigint>, blocks array<binary>, crcs array<bigint>")
    rows.write.option("compression", "uncompressed").parquet(path)


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids binary of 32 bits each) of every document in the files.

    A block whose ids do not have its CRC is an error that names it.
    """
    table = spark.read.parquet(path)
    heads = table.select("part", "segment", "n_ids")  # a row for each SEGMENT ids
    parts = heads.groupBy("part").agg(F.sum("n_ids").alias("n"))
    before = parts.select("part", F.coalesce(F.sum("n").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    inside = F.sum("n_ids").over(W.partitionBy("part").orderBy("segment").rowsBetween(W.unboundedPreceding, 0)) - F.col("n_ids")
    starts = heads.join(before, "part").select("part", "segment", (F.col("before") + inside).alias("start"))
    few = heads.count() <= BROADCAST_ROWS
    placed = table.join(F.broadcast(starts) if few else starts, ["part", "segment"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(b.num_rows):
                row = b.slice(k, 1)
                part, segment = row.column("part")[0].as_py(), row.column("segment")[0].as_py()
                ids = decode(row.column("blocks")[0].as_py())
                for j, crc in enumerate(row.column("crcs")[0].as_py()):
                    if zlib.crc32(ids[j * BLOCK : (j + 1) * BLOCK].astype("<u4")) != crc:
                        raise ValueError(f"block {j} of segment {segment} in part {part} is damaged")
                lengths = row.column("lengths")[0].values.to_numpy()
                off = np.concatenate(([0], np.cumsum(lengths)))
                blob = pa.Array.from_buffers(pa.binary(), len(lengths), [None, pa.py_buffer((off * 4).astype(np.int32)), pa.py_buffer(ids.astype("<u4"))])
                out = pa.RecordBatch.from_arrays([row.column("docs")[0].values, pa.array(row.column("start")[0].as_py() + off[:-1]), pa.array(lengths), blob], ["doc_id", "start", "n_tokens", "ids"])
                yield from _bytes.pieces([out], "ids", 8 << 20)

    kind = table.schema["docs"].dataType.elementType.simpleString()
    return placed.mapInArrow(run, f"doc_id {kind}, start bigint, n_tokens bigint, ids binary")


def query(spark, sf_dir: str) -> DataFrame:
    """op6: what the files say of every document."""
    import uuid

    path = f"{shared_dir(spark)}/ids-{uuid.uuid4().hex}"
    write_ids(documents(spark, sf_dir), path)
    return read_ids(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
