"""CPython's Mersenne Twister from any place of its stream, so that draws in line order split over tasks.

The generator is linear over bits: the state after n steps is a sum of the first states,
those that the polynomial x**n modulo the generator's characteristic polynomial names. The
polynomials are Python integers, a bit a coefficient.
"""

from __future__ import annotations

import functools
import random
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from tessera.sources.shared import cut

DEGREE = 19937
WORDS = 624


def _bits(key: np.ndarray) -> np.random.MT19937:
    out = np.random.MT19937()
    out.state = {"bit_generator": "MT19937", "state": {"key": key, "pos": WORDS}}
    return out


def _key(seed: int) -> np.ndarray:
    """The words that ``random.Random(seed)`` starts from."""
    return np.array(random.Random(seed).getstate()[1][:WORDS], np.uint32)


@functools.cache
def characteristic() -> int:
    """The generator's polynomial: the shortest recurrence of one bit of its output (Berlekamp and Massey)."""
    now, last, gap, length, seen = 1, 1, 1, 0, 0
    for n, bit in enumerate((_bits(_key(1)).random_raw(2 * DEGREE) & np.uint64(1)).tolist()):
        seen = (seen << 1) | bit
        if (now & seen).bit_count() & 1:
            if 2 * length <= n:
                now, last, gap, length = now ^ (last << gap), now, 1, n + 1 - length
                continue
            now ^= last << gap
        gap += 1
    return int(format(now, f"0{DEGREE + 1}b")[::-1], 2)


def _reduced(p: int) -> int:
    whole = characteristic()
    while (over := p.bit_length() - 1 - DEGREE) >= 0:
        p ^= whole << over
    return p


def _steps(n: int) -> int:
    """x**n modulo the characteristic polynomial."""
    p = 1
    for bit in format(n, "b"):
        p = _reduced(int("0".join(format(p, "b")), 2) << (bit == "1"))  # a square has the coefficients two apart
    return p


def _untempered(y: np.ndarray) -> np.ndarray:
    """The state's words of the words drawn: the four shifts undone, last first."""
    u = np.uint32
    y = y.astype(u)
    y ^= y >> u(18)
    y ^= (y << u(15)) & u(0xEFC60000)
    x = y.copy()
    for _ in range(4):
        x = y ^ ((x << u(7)) & u(0x9D2C5680))
    y = x.copy()
    for _ in range(2):
        y = x ^ (y >> u(11))
    return y


def advanced(seed: int, n: int) -> np.random.MT19937:
    """The words of ``random.Random(seed)`` behind its first ``n``."""
    key = _key(seed)
    if n == 0:
        return _bits(key)
    line = np.concatenate((key, _untempered(_bits(key).random_raw(DEGREE))))
    p = _steps(n)
    out = np.zeros(WORDS, np.uint32)
    for k in np.flatnonzero(np.frombuffer(format(p, "b")[::-1].encode(), np.uint8) == ord("1")):
        out ^= line[k : k + WORDS]
    return _bits(out)


def below(spark: SparkSession, seed: int, limit: int, n: int, stretch: int = 1 << 22) -> DataFrame:
    """(number, drawn): the first ``n`` results of ``random.Random(seed).randrange(limit)``.

    A draw takes words until one is under ``limit``. The stream of words is cut into
    stretches; a first pass counts the words of each that count, a sum over the stretches
    says which number each begins with, and a second pass gives the draws. ``limit`` is 1 to 2**31.
    """
    if not 1 <= limit <= 1 << 31:
        raise ValueError("a limit of 1 to 2**31")
    bits = limit.bit_length()
    chunk = min(stretch, 1 << 18)

    def words(ids: list[int]) -> Iterator[tuple[int, np.ndarray]]:
        """(stretch, the draws of a part of it); neighbours go on without a jump."""
        at, source = None, None
        for k in ids:
            source = source if at == k else advanced(seed, k * stretch)
            for lo in range(0, stretch, chunk):
                drawn = source.random_raw(min(chunk, stretch - lo)) >> np.uint64(32 - bits)
                yield k, drawn[drawn < limit].astype(np.int64)
            at = k + 1

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            told: dict[int, int] = {}
            for k, d in words(b.column("id").to_pylist()):
                told[k] = told.get(k, 0) + len(d)
            yield pa.RecordBatch.from_pydict({"stretch": pa.array(list(told), pa.int64()), "n": pa.array(list(told.values()), pa.int64())})

    def give(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            base = dict(zip(b.column("stretch").to_pylist(), b.column("base").to_pylist(), strict=True))
            for k, d in words(list(base)):
                d, first = d[: max(0, n - base[k])], base[k]
                base[k] += len(d)
                if len(d):
                    yield pa.RecordBatch.from_pydict({"number": pa.array(np.arange(first, first + len(d))), "drawn": pa.array(d)})

    def ranges(lo: int, hi: int) -> DataFrame:
        tasks = max(1, min(hi - lo, max(spark.sparkContext.defaultParallelism, (hi - lo) // 64)))
        return spark.range(lo, hi, numPartitions=tasks)

    # Words expected, and a margin of many deviations: what is too much is cut off behind n.
    need = n * (1 << bits) / limit
    have = max(1, -(-int(need + 12 * need**0.5 + 64) // stretch))
    counted = cut(ranges(0, have).mapInArrow(count, "stretch bigint, n bigint"))
    while (counted.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]) < n:
        counted, have = counted.unionByName(cut(ranges(have, 2 * have).mapInArrow(count, "stretch bigint, n bigint"))), 2 * have
    # A row for millions of draws: the sum over them is one small window.
    placed = counted.withColumn("base", F.coalesce(F.sum("n").over(W.orderBy("stretch").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    placed = cut(placed.where(F.col("base") < n).select("stretch", "base"))
    tasks = max(1, min(have, spark.sparkContext.defaultParallelism * 4))
    return placed.repartitionByRange(tasks, "stretch").sortWithinPartitions("stretch").mapInArrow(give, "number bigint, drawn bigint")
