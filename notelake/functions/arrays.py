"""Expressions over arrays, all on the JVM side."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(c: Column, f: Callable[[Column], Column]) -> Column:
    """f(c) with c evaluated once."""
    return F.get(F.transform(F.array(c), f), F.lit(0))


def sums_before(n: Column) -> Column:
    """The sum of the earlier entries of a filled array at each of its entries, in steps of the root of its length."""
    add = lambda xs: F.aggregate(xs, F.lit(0).cast("bigint"), lambda a, x: a + x)

    def steps(n: Column) -> Column:
        step = F.greatest(F.ceil(F.sqrt(F.size(n))).cast("int"), F.lit(1))
        whole = F.transform(F.sequence(F.lit(0), F.floor((F.size(n) - 1) / step).cast("int")), lambda c: add(F.slice(n, c * step + 1, step)))
        entry = lambda w: F.transform(n, lambda _, i: F.get(w, F.floor(i / step).cast("int")) + add(F.slice(n, i - i % step + 1, i % step)))
        return let(whole, lambda w: let(F.transform(w, lambda _, c: add(F.slice(w, F.lit(1), c))), entry))

    return let(n, steps)
