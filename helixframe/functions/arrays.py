"""Array expressions whose time grows with the array's length (times its logarithm), not with its square.

Accumulating an array inside ``aggregate`` copies it at each step.  Running sums and maxima are made here by
doubling instead: step k adds to each element what stands 2**k places before it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def running(values: Column, combine: Callable[[Column, Column], Column], neutral: Column) -> Column:
    """Inclusive running ``combine`` (associative, with the neutral element given) of an array."""

    def step(acc: Column, k: Column) -> Column:
        shifted = F.slice(F.concat(F.array_repeat(neutral, F.pow(F.lit(2), k).cast("int")), acc), F.lit(1), F.size(acc))
        return F.zip_with(acc, shifted, combine)

    def whole(v: Column) -> Column:
        steps = F.sequence(F.lit(0), F.ceil(F.log2(F.size(v))).cast("int") - 1)
        return F.when(F.size(v) > 1, F.aggregate(steps, v, step)).otherwise(v)

    return let(values, whole)


def running_sum(values: Column) -> Column:
    return running(values, lambda a, b: a + b, F.lit(0))


def before(values: Column, neutral: Column) -> Column:
    """Each element's predecessor, the first one's being ``neutral``."""
    return let(values, lambda v: F.slice(F.concat(F.array(neutral), v), F.lit(1), F.size(v)))


def after(values: Column, neutral: Column) -> Column:
    """Each element's successor, the last one's being ``neutral``."""
    return let(values, lambda v: F.slice(F.concat(v, F.array(neutral)), F.lit(2), F.size(v)))


def ends(matches: Column, pieces: Column) -> Column:
    """Where each match ends, given the pieces of the text between matches."""
    return running_sum(F.zip_with(F.slice(pieces, F.lit(1), F.size(matches)), matches, lambda p, m: F.length(p) + F.length(m)))
