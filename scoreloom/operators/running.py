"""Running sums that do not put a whole group into one task."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.staging import stored


def summed_before(rows: DataFrame, keys: list[str], pos: str, values: dict[str, Column], first: Column | None = None) -> DataFrame:
    """``rows`` with, for each name in ``values``, its sum over the rows of the group before this one.

    Order: ``first``, then ``pos``; nulls come first, and a null key is a group.  Rows are cut into ranges of (keys, order)
    by sampled bounds, so ranges are even however the positions lie.  Totals of a group's ranges are run up, one row a
    range, and inside a range a window sees only that.  The ranged rows are stored once, so that both steps see the same
    ranges; hand over no more columns than needed.
    """
    cut = rows.withColumns({"_first": F.lit(0) if first is None else first, **{f"_v_{n}": v for n, v in values.items()}})
    ranged = stored(cut.repartitionByRange(*keys, "_first", pos).withColumn("_range", F.spark_partition_id()), "ranges")
    earlier = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    sums = ranged.groupBy(*keys, "_range").agg(*[F.sum(f"_v_{n}").alias(f"_s_{n}") for n in values])
    sums = sums.select(
        *[F.col(k).alias(f"_k_{k}") for k in keys], F.col("_range").alias("_r"), *[F.coalesce(F.sum(f"_s_{n}").over(earlier), F.lit(0)).alias(f"_b_{n}") for n in values]
    )
    inside = Window.partitionBy(*keys, "_range").orderBy("_first", pos).rowsBetween(Window.unboundedPreceding, -1)
    within = {n: F.col(f"_b_{n}") + F.coalesce(F.sum(f"_v_{n}").over(inside), F.lit(0)) for n in values}
    same = reduce(and_, [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys], F.col("_range") == F.col("_r"))
    return ranged.join(sums, same).withColumns(within).select(*rows.columns, *values)
