"""Column helpers over arrays."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once; a column named in a lambda would be computed at every step."""
    return F.element_at(F.transform(F.array(value), lambda x: use(x)), 1)


def running(lengths: Column, step: int = 256) -> Column:
    """Inclusive running sums of an array of ints, in two levels so that long arrays stay near linear."""
    zero = F.lit(0)
    total = lambda xs: F.aggregate(xs, zero, lambda a, v: a + v)

    def within(block: Column, before: Column) -> Column:
        return F.transform(block, lambda _, i: before + total(F.slice(block, F.lit(1), i + 1)))

    def over(blocks: Column) -> Column:
        return let(F.transform(blocks, total), lambda totals: F.transform(
            blocks, lambda block, b: let(total(F.slice(totals, F.lit(1), b)), lambda before: within(block, before))))

    def cut(xs: Column) -> Column:
        last = F.greatest(zero, F.ceil(F.size(xs) / step).cast("int") - 1)
        return F.transform(F.sequence(zero, last), lambda b: F.slice(xs, b * step + 1, F.lit(step)))

    return let(lengths, lambda xs: F.flatten(let(cut(xs), over)))
