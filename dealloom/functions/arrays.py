"""Values that are computed once, and running sums, within a row."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

BLOCK = 64  # values that one fold appends one by one


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """then of a value that is computed once, however often then names it."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def _appended(values: Column) -> Column:
    """Sums of the values up to each; a fold that copies its array with each value, for short arrays."""
    add = lambda sums, v: F.array_append(sums, F.coalesce(F.try_element_at(sums, F.lit(-1)), F.lit(0)) + v)
    return F.aggregate(values, F.array().cast("array<int>"), add)


def running_sums(values: Column, block: int = BLOCK) -> Column:
    """Sums of an array of ints up to each value. Blocks are summed by themselves and then moved, so long arrays take little more than their length."""

    def sums(values: Column) -> Column:
        n = F.size(values)
        blocks = F.transform(F.sequence(F.lit(0), F.ceil(n / block).cast("int") - 1), lambda b: _appended(F.slice(values, b * block + 1, F.lit(block))))
        moved = lambda blocks: F.zip_with(blocks, _appended(F.transform(blocks, lambda b: F.element_at(b, -1))), lambda b, end: F.transform(b, lambda s: s + end - F.element_at(b, -1)))
        return F.when(n > block, F.flatten(let(blocks, moved))).when(n > 0, _appended(values)).otherwise(F.array().cast("array<int>"))

    return let(values, sums)
