"""Array expressions whose order of evaluation is part of the result."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def ordered_fold(pairs: Column) -> Column:
    """The sum of ``value`` in ascending order of the first field of ``array<struct<order, value>>``, left to right."""
    return F.aggregate(F.transform(F.array_sort(pairs), lambda x: x["value"]), F.lit(0.0), lambda a, x: a + x)


def log_sum_exp(values: Column) -> Column:
    """log of the sum of exponentials, shifted by the maximum."""
    top = F.array_max(values)
    return top + F.log(F.aggregate(F.transform(values, lambda x: F.exp(x - top)), F.lit(0.0), lambda a, x: a + x))


def inputs_and_labels(tokens: Column) -> Column:
    """A window without its last token, and without its first."""
    n = F.size(tokens)
    return F.struct(F.slice(tokens, F.lit(1), n - 1).alias("input_ids"), F.slice(tokens, F.lit(2), n - 1).alias("labels"))


def tree_blocks(n: int) -> list[int]:
    """``n`` as powers of two, largest first."""
    return [1 << b for b in range(n.bit_length() - 1, -1, -1) if n >> b & 1]


def tree_sum(values: Column) -> Column:
    """The sum of an ordered array by balanced pairs in power-of-two blocks, the blocks' sums from the left.

    Kept like a binary counter: slot k holds the sum of a finished block of 2**k values, and
    a value carries upward through the slots that are taken, the earlier sum on the left.
    There are as many slots as the number of values has bits; an empty array gives null.
    """
    none = F.lit(None).cast("double")

    def put(slots: Column, value: Column) -> Column:
        start = F.struct(F.array().cast("array<double>").alias("out"), value.cast("double").alias("carry"))
        return F.aggregate(
            slots,
            start,
            lambda s, x: F.struct(
                F.concat(s["out"], F.array(F.when(s["carry"].isNull(), x).when(x.isNull(), s["carry"]))).alias("out"),
                F.when(s["carry"].isNotNull() & x.isNotNull(), x + s["carry"]).alias("carry"),
            ),
            lambda s: s["out"],
        )

    full = F.aggregate(values, F.array_repeat(none, F.length(F.bin(F.size(values)))), put)
    blocks = F.filter(F.reverse(full), lambda x: x.isNotNull())
    return F.aggregate(blocks, none, lambda a, x: F.when(a.isNull(), x).otherwise(a + x))


def continuation_score(logits: Column, targets: Column) -> Column:
    """(ll, greedy) of a continuation: the log-probability of ``targets`` under the logits of their places, and whether each is the first of the largest.

    ``logits``: an array of doubles for each place; an empty continuation scores 0 and is greedy.
    """
    at = F.zip_with(logits, targets, lambda x, t: F.struct((F.get(x, t) - log_sum_exp(x)).alias("ll"), (F.array_position(x, F.array_max(x)) == t + 1).alias("greedy")))
    first = F.struct(F.lit(0.0).alias("ll"), F.lit(True).alias("greedy"))
    return F.aggregate(at, first, lambda a, x: F.struct((a["ll"] + x["ll"]).alias("ll"), (a["greedy"] & x["greedy"]).alias("greedy")))
