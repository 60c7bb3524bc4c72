"""Running sums and maxima over an array inside its row, linear in its length.

An ``aggregate`` that appends to an array copies it at every step.  Here an element's
running value is that of its block plus those inside the block before it; the block
totals are run over in the same way, or directly where there are few.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

SHIFT = 6           # blocks of 64
SIZE = 1 << SHIFT


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is evaluated once, however often the body names it."""
    return F.transform(F.array(value), body)[0]


def _blocks(a: Column, fold: Callable[[Column], Column]) -> Column:
    """``fold`` of every block."""
    return F.transform(F.sequence(F.lit(0), F.shiftright(F.greatest(F.size(a) - 1, F.lit(0)), SHIFT)),
                       lambda k: fold(F.slice(a, k * SIZE + 1, F.lit(SIZE))))


def _in_block(a: Column, i: Column) -> Column:
    """The elements of element ``i``'s block before it."""
    return F.slice(a, i.bitwiseAND(F.lit(-SIZE)) + 1, i.bitwiseAND(F.lit(SIZE - 1)))


def running_sum(values: Column) -> Column:
    """Sum of the elements before each one (ints)."""
    def total(part: Column) -> Column:
        return F.aggregate(part, F.lit(0), lambda a, b: a + b)

    def direct(a: Column) -> Column:
        return F.transform(a, lambda _, i: total(F.slice(a, F.lit(1), i)))

    def spread(a: Column, before: Column) -> Column:
        return F.transform(a, lambda _, i: F.get(before, F.shiftright(i, SHIFT)) + total(_in_block(a, i)))

    def blocked(a: Column) -> Column:
        return let(_blocks(a, total), lambda b: let(let(direct(_blocks(b, total)), lambda c: spread(b, c)), lambda c: spread(a, c)))

    return let(values, lambda a: F.when(F.size(a) <= SIZE, direct(a)).otherwise(blocked(a)))


def running_max(values: Column, least: int = 0) -> Column:
    """Greatest of ``least`` and the elements before each one (ints)."""
    def spread(a: Column, before: Column) -> Column:
        return F.transform(a, lambda _, i: F.greatest(F.lit(least), F.get(before, F.shiftright(i, SHIFT)), F.array_max(_in_block(a, i))))

    def so_far(b: Column) -> Column:
        return F.transform(b, lambda _, k: F.array_max(F.slice(b, F.lit(1), k)))

    return let(values, lambda a: let(let(_blocks(a, F.array_max), so_far), lambda before: spread(a, before)))
