"""Sums in a fixed order over any number of rows: balanced pairs in aligned power-of-two blocks.

``n`` values are cut into blocks, the powers of two of ``n`` from the largest; a block is
summed by adjacent pairs, and blocks' sums are added from the left. Every block begins at a
multiple of its size, so a stretch of 2**k positions that is aligned to its size is a node of
the tree: it can be summed in a task of its own and be put in its place later by its number. Only the
last stretch of a level is not whole; the blocks it is made of are kept with their places
until the end.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

#: Children of a node that meet in one row, as a power of two.
BITS = 8

ROOTS = "array<struct<start:bigint,v:double>>"


def _level(values: Column, number: Column, below: int) -> Column:
    """(values, roots) of a stretch's child nodes: pairs added ``BITS`` times, one that finds no partner kept as a root with its place."""

    def step(s: Column, level: Column) -> Column:
        n = F.size(s.values)
        pairs = F.transform(F.sequence(F.lit(1), F.floor(n / 2).cast("int")), lambda i: F.element_at(s.values, 2 * i - 1) + F.element_at(s.values, 2 * i))
        place = F.shiftleft(number, BITS) + F.call_function("shiftleft", (n - 1).cast("bigint"), level)
        root = F.struct(F.call_function("shiftleft", place, F.lit(below)).alias("start"), F.element_at(s.values, -1).alias("v"))
        return F.struct(
            F.when(n > 1, pairs).otherwise(F.array().cast("array<double>")).alias("values"),
            F.when(n % 2 == 1, F.concat(s.roots, F.array(root))).otherwise(s.roots).alias("roots"),
        )

    start = F.struct(values.alias("values"), F.array().cast(ROOTS).alias("roots"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(BITS - 1)), start, step)


def tree_total(df: DataFrame, position: str, value: str, group: Sequence[str] = ()) -> DataFrame:
    """(group, n, total): the tree sum of ``value`` by ``position``, which counts 0, 1, 2, ... in each group.

    Bit for bit what ``arrays.tree_sum`` gives for all values in one array. A null value is
    zero. Groups meet by their values, so none may be null in a ``group`` column. A null ``position`` or a gap
    between positions is an error. Without rows there is no row.
    """
    keys = list(group)
    nodes = df.select(*keys, F.col(position).cast("bigint").alias("i"), F.coalesce(F.col(value).cast("double"), F.lit(0.0)).alias("v"))
    told = nodes.groupBy(*keys).agg(F.count("*").alias("n"), F.min("i").alias("low"), F.max("i").alias("high"), F.count_if(F.col("i").isNull()).alias("lost"))
    gap = (F.col("low") != 0) | (F.col("high") != F.col("n") - 1) | (F.col("lost") > 0)
    told = told.select(*keys, F.when(gap, F.raise_error(F.lit("positions must count 0, 1, 2, ..."))).otherwise(F.col("n")).alias("n"))
    most, below, roots = told.agg(F.max("n")).first()[0] or 0, 0, None
    while True:
        number = F.shiftright("i", BITS)
        lists = nodes.groupBy(*keys, number.alias("number")).agg(F.array_sort(F.collect_list(F.struct("i", "v"))).alias("l"))
        summed = lists.select(*keys, "number", _level(F.transform("l", lambda x: x.v), F.col("number"), below).alias("s"))
        open_ = summed.select(*keys, F.inline("s.roots"))
        roots = open_ if roots is None else roots.unionByName(open_)
        below += BITS
        nodes = summed.where(F.size("s.values") == 1).select(*keys, F.col("number").alias("i"), F.element_at("s.values", 1).alias("v"))
        if most >> below == 0:
            break
    whole = roots.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("start", "v"))).alias("l"))
    fold = F.aggregate(F.slice("l", 2, F.size("l")), F.element_at("l", 1).v, lambda a, x: a + x.v)
    totals = whole.select(*keys, fold.alias("total"))
    return told.join(totals, keys).select(*keys, "n", "total") if keys else told.crossJoin(totals).where("n > 0")
