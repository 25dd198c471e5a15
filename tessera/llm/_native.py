"""Column expressions for words and for naming a value inside a larger expression."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F

SPACES = " \t\n\x0b\f\r"
#: Java's spelling of the words' separators, ``[\x20\x09-\x0D]+``.
GAP = r"[\x20\x09-\x0D]+"


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once a row, even where ``body`` uses it inside lambdas."""
    return F.transform(F.array(value), body)[0]


def words(text: Column) -> Column:
    """The words ``[^\x20\x09-\x0D]+`` of a text; null has none."""
    inner = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACES))
    return F.when(inner == "", F.array().cast("array<string>")).otherwise(F.split(inner, GAP))


def n_words(text: Column) -> Column:
    return F.size(words(text)).cast("bigint")


def n_bytes(text: Column) -> Column:
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("bigint")


def running(values: Column, step: Callable[[Column, Column], Column], kind: str = "int") -> Column:
    """The running fold of an array of whole numbers by an associative ``step`` (a sum, a maximum).

    An array that grows by one is copied each time; so values are folded in blocks of about
    the root of their number, and the blocks' ends among themselves.
    """

    def fold(xs: Column) -> Column:
        add = lambda a, x: F.concat(a, F.array(F.when(F.size(a) == 0, x).otherwise(step(F.element_at(a, -1), x))))
        return F.aggregate(xs, F.array().cast(f"array<{kind}>"), add)

    def blocks(xs: Column) -> Column:
        width = F.greatest(F.lit(32), F.ceil(F.sqrt(F.size(xs).cast("double")))).cast("int")
        parts = F.transform(F.sequence(F.lit(0), F.floor((F.size(xs) - 1) / width).cast("int")), lambda k: fold(F.slice(xs, k * width + 1, width)))
        ends = lambda ps: fold(F.transform(ps, lambda p: F.element_at(p, -1)))
        moved = lambda ps, es: F.transform(ps, lambda p, k: F.when(k == 0, p).otherwise(F.transform(p, lambda x: step(F.get(es, k - 1), x))))
        return bind(parts, lambda ps: bind(ends(ps), lambda es: F.flatten(moved(ps, es))))

    return bind(values, lambda xs: F.when(F.size(xs) == 0, F.array().cast(f"array<{kind}>")).otherwise(blocks(xs)))
