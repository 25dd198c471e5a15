"""Counter-based random numbers: a row's draw depends on its number and the seed alone, not on where the row is.

The generator is Philox 4x64 with ten rounds, as numpy has it: number ``k`` of a key is the
first of the four words of the block that counter ``k + 1`` gives.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, functions as F

#: Fixed values of the generator: multipliers and what is added to the key each round.
M0, M1 = 0xD2E7470EE14C6C93, 0xCA5A826395121157
W0, W1 = 0x9E3779B97F4A7C15, 0xBB67AE8584CAA73B
LOW = np.uint64(0xFFFFFFFF)


def _product(a: int, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """High and low word of a 64-bit by 64-bit product."""
    x0, x1 = np.uint64(a & 0xFFFFFFFF), np.uint64(a >> 32)
    y0, y1, half = b & LOW, b >> np.uint64(32), np.uint64(32)
    mid = x1 * y0 + (x0 * y0 >> half)
    cross = x0 * y1 + (mid & LOW)
    return x1 * y1 + (mid >> half) + (cross >> half), np.uint64(a) * b


def philox(number: np.ndarray, seed: int) -> np.ndarray:
    """The word of each number, as unsigned 64-bit integers."""
    with np.errstate(over="ignore"):
        c0 = number.astype(np.int64).view(np.uint64) + np.uint64(1)
        c1 = (c0 == 0).astype(np.uint64)
        c2 = c3 = np.zeros_like(c0)
        k0, k1 = seed & (1 << 64) - 1, seed >> 64 & (1 << 64) - 1
        for _ in range(10):
            h0, l0 = _product(M0, c0)
            h1, l1 = _product(M1, c2)
            c0, c1, c2, c3 = h1 ^ c1 ^ np.uint64(k0), l1, h0 ^ c3 ^ np.uint64(k1), l0
            k0, k1 = k0 + W0 & (1 << 64) - 1, k1 + W1 & (1 << 64) - 1
        return c0


def uniform(number: Column, seed: int) -> Column:
    """A double in [0, 1) for each row's number; null numbers have none."""

    @F.pandas_udf("double")
    def draw(n: pd.Series) -> pd.Series:
        got = pd.Series((philox(n.fillna(0).to_numpy(), seed) >> np.uint64(11)) * 2.0**-53)
        return got.where(n.notna().to_numpy())

    return draw(number.cast("bigint"))


def multinomial(weights: Column, u: Column) -> Column:
    """The index, from 0, that a uniform number ``u`` falls on among the running sums of an array of weights, none negative.

    Null weights are zero. Null if there is no weight over zero or no ``u``. What rounding leaves at the end
    goes to the last weight over zero.
    """
    w = F.transform(weights, lambda x: F.coalesce(x.cast("double"), F.lit(0.0)))
    total = F.aggregate(w, F.lit(0.0), lambda a, x: a + x)
    start = F.struct(F.lit(0.0).alias("sum"), F.lit(0).alias("i"), F.lit(-1).alias("hit"), F.lit(-1).alias("last"))

    def step(s: Column, x: Column) -> Column:
        now = s.sum + x
        hit = F.when((s.hit < 0) & (x > 0) & (u * total < now), s.i).otherwise(s.hit)
        return F.struct(now.alias("sum"), (s.i + 1).alias("i"), hit.alias("hit"), F.when(x > 0, s.i).otherwise(s["last"]).alias("last"))

    return F.when((total > 0) & u.isNotNull(), F.aggregate(w, start, step, lambda s: F.when(s.hit >= 0, s.hit).otherwise(s["last"])))
