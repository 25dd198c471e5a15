"""Token counts, with overlap resynchronisation for huge documents.

A huge text is encoded in chunks that overlap. Both vocabularies' patterns read from left
to right with no look-behind, so an encoding goes on alike from any place at which a piece
begins. Hence a place in the overlap at which both neighbours begin a piece, and which the
left one sees with enough text behind it (its last characters could still join with what
follows), is a proven boundary: the left chunk's pieces count up to it, the right one's
from it. Where an overlap has no such place, the left chunk is made longer, by twice as
much each time, until it has one or has taken in its neighbour.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tessera.llm import _bytes
from tessera.llm._native import n_bytes
from tessera.llm._store import documents
from tessera.llm.encoding import Encoder, encoder

#: A piece's end is settled once so many bytes behind it are known (the longest contraction, of the widest characters).
LOOKAHEAD = 16
#: About so many bytes of chunks or of short texts are encoded at a time.
AT_ONCE = 1 << 20


def _whole(data: np.ndarray, at: int) -> int:
    """``at``, or the place before it at which a character begins."""
    while 0 < at < len(data) and data[at] & 0xC0 == 0x80:
        at -= 1
    return at


def _chunks(enc: Encoder, data: np.ndarray, chunk: int, overlap: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(begin, end, first bytes, tokens) of the overlapping chunks of one text, some at a time."""
    n, group = len(data), max(1, AT_ONCE // (chunk + overlap))
    starts = range(0, max(1, n - overlap), chunk)
    for k in range(0, len(starts), group):
        spans = [(_whole(data, q), n if q == starts[-1] else _whole(data, q + chunk + overlap)) for q in starts[k : k + group]]
        cuts = np.concatenate(([0], np.cumsum([b - a for a, b in spans])))
        at, size, _, _ = enc.pieces(np.concatenate([data[a:b] for a, b in spans]), cuts, np.full(len(spans), -1))
        first = np.searchsorted(at, cuts)
        for (a, b), lo, hi, base in zip(spans, first[:-1], first[1:], cuts):
            yield a, b, at[lo:hi] - base + a, size[lo:hi]


def spliced(enc: Encoder, data: np.ndarray, chunk: int, overlap: int) -> int:
    """The tokens of one text without special strings, of which two neighbouring chunks are looked at."""
    chunks, n, total = _chunks(enc, data, chunk, overlap), len(data), 0
    begin, end, at, size = next(chunks)
    after = next(chunks, None)
    while end < n:
        while after[1] <= end and after[1] < n:  # taken in whole
            after = next(chunks)
        start_b, end_b, at_b, size_b = after
        common = np.intersect1d(at[(at > begin) & (at <= end - LOOKAHEAD)], at_b, assume_unique=True)
        if common.size:
            cut = int(common[0])
            total += int(size[(at >= begin) & (at < cut)].sum())
            begin, end, at, size, after = cut, end_b, at_b, size_b, next(chunks, None)
            continue
        end = _whole(data, min(n, end + 2 * max(end - start_b, LOOKAHEAD)))
        at, size, _, _ = enc.pieces(data[begin:end], np.array([0, end - begin]), np.full(1, -1))
        at = at + begin
    return total + int(size[at >= begin].sum())


def count(enc: Encoder, texts: pa.Array | Sequence[str], chunk: int = 1 << 14, overlap: int = 128) -> np.ndarray:
    """The number of tokens of each text; texts of over ``chunk`` bytes are cut. Null is empty."""
    data, off = _bytes.raw(texts if isinstance(texts, pa.Array) else pa.array(texts, pa.large_string()))
    cuts, then = enc.parts(data, off)
    n = np.zeros(len(then), np.int64)
    # No place is kept for pieces of normalized text, so the word vocabulary's texts stay whole.
    long = np.zeros(len(then), bool) if enc.word_level else (np.diff(cuts) > chunk + overlap) & (then < 0)
    lo = 0
    while lo < len(then):
        if long[lo]:
            n[lo] = spliced(enc, data[cuts[lo] : cuts[lo + 1]], chunk, overlap)
            lo += 1
            continue
        hi = max(lo + 1, int(np.searchsorted(cuts, cuts[lo] + AT_ONCE, "right")) - 1)
        stop = lo + 1 + np.flatnonzero(long[lo + 1 : hi])
        hi = int(stop[0]) if stop.size else min(hi, len(then))
        here = cuts[lo : hi + 1]
        at, size, _, _ = enc.pieces(data[here[0] : here[-1]], here - here[0], then[lo:hi])
        n[lo:hi] = np.diff(np.concatenate(([0], np.cumsum(size)))[np.searchsorted(at, here - here[0])])
        lo = hi
    return np.bincount(np.searchsorted(off, cuts[:-1], "right") - 1, n, len(off) - 1).astype(np.int64)


def token_counts(docs: DataFrame, tokenizer: str = "byte_bpe_50k.json", limit: int = 512, chunk: int = 1 << 14, overlap: int = 128, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(id_col, n_bytes, n_tokens, over_limit) of every row.

    Counts are those of the tokenizers library over the whole text, special strings in it
    being special. Null counts as empty: no bytes, no tokens. Repeated rows stay repeated,
    other columns are not read, and an empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        for b in _bytes.pieces(batches, "text"):
            n = count(enc, b.column("text"), chunk, overlap)
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("n_bytes"), pa.array(n)], ["id", "n_bytes", "n_tokens"])

    kind = docs.schema[id_col].dataType.simpleString()
    found = docs.select(F.col(id_col).alias("id"), n_bytes(F.col(text)).alias("n_bytes"), F.col(text).alias("text")).mapInArrow(run, f"id {kind}, n_bytes bigint, n_tokens bigint")
    return found.select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


def query(spark, sf_dir: str) -> DataFrame:
    """op5: the tokens of every document."""
    return token_counts(documents(spark, sf_dir))
