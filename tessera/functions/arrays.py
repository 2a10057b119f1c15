"""Helpers for expressions over arrays."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Values that one step of ``running`` takes in turn.
BLOCK = 64


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once, however often it is used."""
    return F.transform(F.array(value), use)[0]


def running(values: Column, join: Callable[[Column, Column], Column], start: Column, levels: int = 3) -> Column:
    """For each value, ``start`` joined with all values before it: an exclusive running sum or maximum.

    Blocks of BLOCK values are run through in turn and then moved on by what the blocks before them come to, which is
    found the same way. So an array of n values costs about n * BLOCK steps, not n * n.
    """

    def in_turn(a: Column) -> Column:
        return F.slice(F.aggregate(a, F.array(start), lambda out, x: F.concat(out, F.array(join(F.element_at(out, -1), x)))), 1, F.size(a))

    if levels == 1:
        return in_turn(values)

    def moved(a: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(a) - 1) / BLOCK).cast("int")), lambda b: F.slice(a, b * BLOCK + 1, F.lit(BLOCK)))

        def add(blocks: Column) -> Column:
            before = running(F.transform(blocks, lambda b: F.aggregate(b, start, join)), join, start, levels - 1)
            return F.flatten(F.zip_with(blocks, before, lambda block, so_far: F.transform(in_turn(block), lambda x: join(so_far, x))))

        return bound(blocks, add)

    return bound(values, lambda a: F.when(F.size(a) <= BLOCK, in_turn(a)).otherwise(moved(a)))


def running_sum(values: Column) -> Column:
    """Sums of doubles before each value."""
    return running(values, lambda x, y: x + y, F.lit(0.0))
