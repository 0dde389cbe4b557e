"""Running values over an array inside one row.

Adding to an array copies it, so a plain fold that keeps its steps takes square time.  Here the array is cut into blocks:
each block is summed up, the blocks are run over, and only then each block's own steps are kept.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

BLOCK = 256


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def steps(start: Column, xs: Column, step: Callable[[Column, Column], Column]) -> Column:
    """``start`` and the value after each of ``xs``: for short arrays."""
    return F.aggregate(xs, F.array(start), lambda acc, x: F.concat(acc, F.array(step(F.element_at(acc, -1), x))))


def depths(changes: Column) -> Column:
    """Depth after each change (a whole number), which never falls below 0.

    Changes of a block taken together move a depth d to greatest(d + total, least), so blocks can be run over first.
    """
    above = lambda d, c: F.greatest(d + c, F.lit(0))

    def whole(block: Column) -> Column:
        start = F.struct(F.lit(0).alias("total"), F.lit(0).alias("least"))
        return F.aggregate(block, start, lambda a, c: F.struct((a["total"] + c).alias("total"), F.greatest(a["least"] + c, F.lit(0)).alias("least")))

    def run(xs: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(xs) - 1) / BLOCK).cast("int")), lambda b: F.slice(xs, b * BLOCK + 1, F.lit(BLOCK)))

        def inside(bs: Column) -> Column:
            before = steps(F.lit(0), F.transform(bs, whole), lambda d, w: F.greatest(d + w["total"], w["least"]))
            return let(before, lambda at: F.flatten(F.transform(bs, lambda block, b: F.slice(steps(F.get(at, b), block, above), F.lit(2), F.size(block)))))

        return F.when(F.size(xs) > 0, let(blocks, inside)).otherwise(F.array().cast("array<int>"))

    return let(changes, run)
