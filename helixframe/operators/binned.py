"""Ordered operators over long keys, a bin at a time.

A window over a whole contig is one task for hundreds of millions of rows.  Here windows run inside
bins of a coordinate, and what passes from bin to bin is one small row for each: its greatest value.
Rows of a key are ordered by ``order``, of which the first column is the coordinate, and keys are not null.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Positions of a bin.
WIDTH = 1 << 20


def running_max(df: DataFrame, keys: list[str], order: list[str], value: Column, name: str, width: int = WIDTH, inclusive: bool = False) -> DataFrame:
    """``df`` with the greatest ``value`` (a number or a struct) of the rows before each, or up to it."""
    binned = df.withColumn("__bin", F.floor(F.col(order[0]) / width)).withColumn("__value", value)
    inner = Window.partitionBy(*keys, "__bin").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    tops = binned.groupBy(*keys, "__bin").agg(F.max("__value").alias("__top"))
    bins = Window.partitionBy(*keys).orderBy("__bin").rowsBetween(Window.unboundedPreceding, -1)
    carried = tops.select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)], F.col("__bin").alias("__b"), F.max("__top").over(bins).alias("__carried"))
    same = F.col("__bin") == F.col("__b")
    for i, k in enumerate(keys):
        same = same & (F.col(k) == F.col(f"__k{i}"))
    out = binned.withColumn("__inner", F.max("__value").over(inner)).join(carried, same, "left")
    return out.withColumn(name, F.greatest("__inner", "__carried")).drop("__bin", "__value", "__inner", "__b", "__carried", *[f"__k{i}" for i in range(len(keys))])


def islands(df: DataFrame, keys: list[str], order: list[str], new: Column, name: str = "island", width: int = WIDTH) -> DataFrame:
    """``df`` with the order columns of the row that begins each row's island, as a struct; ``new`` is true where one begins."""
    return running_max(df, keys, order, F.when(new, F.struct(*order)), name, width, inclusive=True)


def runs(df: DataFrame, keys: list[str], order: list[str], columns: list[str], same: Callable[[Column], Column], name: str = "island", width: int = WIDTH) -> DataFrame:
    """``df`` with the order columns of the row that begins each row's run, as a struct; the order must be unique.

    ``same`` tells whether a row goes on from the one before, given a struct of that one's ``order`` and
    ``columns``; of the row itself it may name these columns.  Runs are found in bins; then each bin's first run is
    joined to the last one of the bin before where that goes on.
    """
    held = [*order, *[c for c in columns if c not in order]]
    by_bin = Window.partitionBy(*keys, "__bin").orderBy(*order)
    binned = df.withColumn("__bin", F.floor(F.col(order[0]) / width)).withColumn("__row", F.struct(*held))
    goes_on = F.coalesce(same(F.lag("__row").over(by_bin)), F.lit(False))
    binned = binned.withColumn("__new", F.when(~goes_on, F.struct(*order))).withColumn("__run", F.max("__new").over(by_bin.rowsBetween(Window.unboundedPreceding, 0)))
    ends = binned.groupBy(*keys, "__bin").agg(F.min("__row").alias("__first"), F.max("__row").alias("__last"), F.min("__run").alias("__begun"), F.max("__run").alias("__final"))
    bins = Window.partitionBy(*keys).orderBy("__bin")
    joined = ends.withColumn("__before", F.lag("__last").over(bins)).select("*", "__first.*")
    joined = joined.withColumn("__joins", F.coalesce(same(F.col("__before")), F.lit(False)))
    # where a bin's last run begins: in the bin itself, unless all of it goes on from before
    own = F.when((F.col("__begun") != F.col("__final")) | ~F.col("__joins"), F.col("__final"))
    joined = joined.withColumn("__root", F.last(own, ignorenulls=True).over(bins.rowsBetween(Window.unboundedPreceding, 0)))
    root = F.when(F.col("__joins"), F.lag("__root").over(bins)).otherwise(F.col("__begun"))
    small = joined.select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)], F.col("__bin").alias("__b"), F.col("__begun"), root.alias("__root"))
    match = F.col("__bin") == F.col("__b")
    for i, k in enumerate(keys):
        match = match & (F.col(k) == F.col(f"__k{i}"))
    out = binned.join(small, match, "left").withColumn(name, F.when(F.col("__run") == F.col("__begun"), F.col("__root")).otherwise(F.col("__run")))
    return out.drop("__bin", "__row", "__new", "__run", "__b", "__begun", "__root", *[f"__k{i}" for i in range(len(keys))])
