"""Interval operators: coalescing, overlap joins by bins, tiling, islands, running deletions.

Intervals are 1-based and closed, ``[start, end]``, unless a function says otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import binned

BIN = 16_384


def padded(df: DataFrame, by: int, length: str | None = None, start: str = "start", end: str = "end") -> DataFrame:
    """Intervals grown on both sides, held inside [1, length]."""
    grown = F.col(end) + by
    return df.withColumns({start: F.greatest(F.lit(1), F.col(start) - by), end: F.least(grown, F.col(length)) if length else grown})


def overlaps(a_start: Column, a_end: Column, b_start: Column, b_end: Column) -> Column:
    return (a_start <= b_end) & (b_start <= a_end)


def contains(a_start: Column, a_end: Column, b_start: Column, b_end: Column) -> Column:
    return (a_start <= b_start) & (a_end >= b_end)


def within_distance(a_start: Column, a_end: Column, b_start: Column, b_end: Column, by: int) -> Column:
    return overlaps(a_start - by, a_end + by, b_start, b_end)


def intersected(a_start: Column, a_end: Column, b_start: Column, b_end: Column) -> Column:
    """The shared part as a struct, null where there is none."""
    return F.when(overlaps(a_start, a_end, b_start, b_end), F.struct(F.greatest(a_start, b_start).alias("start"), F.least(a_end, b_end).alias("end")))


def coalesced(df: DataFrame, keys: list[str], start: str = "start", end: str = "end", width: int = binned.WIDTH) -> DataFrame:
    """Merged half-open intervals: one is absorbed or joined where it starts strictly before the furthest end so far.  Equal empty ones are one."""
    seen = binned.running_max(df, keys, [start, end], F.col(end), "__far", width)
    new = F.col("__far").isNull() | (F.col(start) >= F.col("__far"))
    found = binned.islands(seen, keys, [start, end], new, "__island", width)
    return found.groupBy(*keys, "__island").agg(F.min(start).alias(start), F.max(end).alias(end), F.count("*").alias("n_merged")).drop("__island")


def _bins(start: Column, end: Column, width: int) -> Column:
    return F.explode(F.sequence(F.floor(start / width), F.floor(end / width)))


def overlap_join(left: DataFrame, right: DataFrame, keys: list[str], left_span: tuple[str, str], right_span: tuple[str, str], how: str = "inner", width: int = BIN) -> DataFrame:
    """Rows of both sides that share the keys and overlap, each pair once; ``how`` is inner or left_semi.

    Spans are cut into bins and joined on (keys, bin), so that an equi-join with a residual test runs
    in place of a nested loop.  A pair is kept in the bin where its overlap begins, which needs no
    later deduplication.  Right columns that clash with left ones must be renamed before.
    """
    (ls, le), (rs, re_) = left_span, right_span
    a = left.withColumn("__bin", _bins(F.col(ls), F.col(le), width))
    names = {k: f"__r_{k}" for k in keys}
    b = right.select(*[F.col(k).alias(names[k]) if k in names else F.col(k) for k in right.columns]).withColumn("__rbin", _bins(F.col(rs), F.col(re_), width))
    same = F.col("__bin") == F.col("__rbin")
    for k in keys:
        same = same & (F.col(k) == F.col(names[k]))
    meets = overlaps(F.col(ls), F.col(le), F.col(rs), F.col(re_))
    if how == "left_semi":
        if ls == le:  # a position has one bin
            return a.join(b, same & meets, "left_semi").drop("__bin")
        # More than one of a left row's bins can meet: rows are numbered, so that repeated rows stay apart.
        numbered = left.withColumn("__row", F.monotonically_increasing_id()).withColumn("__bin", _bins(F.col(ls), F.col(le), width))
        return numbered.join(b, same & meets, "left_semi").dropDuplicates(["__row"]).drop("__bin", "__row")
    first = F.floor(F.greatest(F.col(ls), F.col(rs)) / width) == F.col("__bin")
    return a.join(b, same & meets & first).drop("__bin", "__rbin", *names.values())


def tiled(df: DataFrame, width: int, start: str = "start", end: str = "end") -> DataFrame:
    """Intervals cut into tiles of at most ``width`` positions."""
    tile = F.explode(F.sequence(F.col(start), F.col(end), F.lit(width)))
    return df.withColumn("__tile", tile).withColumn(end, F.least(F.col("__tile") + width - 1, F.col(end))).withColumn(start, F.col("__tile")).drop("__tile")


def gaps(df: DataFrame, keys: list[str], start: str = "start", end: str = "end", width: int = binned.WIDTH) -> DataFrame:
    """The uncovered stretches between a key's intervals."""
    seen = binned.running_max(df.select(*keys, start, end), keys, [start, end], F.col(end), "__far", width)
    return seen.select(*keys, (F.col("__far") + 1).alias("gap_start"), (F.col(start) - 1).alias("gap_end")).filter("gap_start <= gap_end")


def flanks(df: DataFrame, keep: list[str], start: str, end: str, inner_start: str, inner_end: str) -> DataFrame:
    """What of each interval lies left and right of an inner one: ``keep``, side, start, end; empty sides are left out."""
    left = F.struct(F.lit("left").alias("side"), F.col(start).alias("start"), (F.col(inner_start) - 1).alias("end"))
    right = F.struct(F.lit("right").alias("side"), (F.col(inner_end) + 1).alias("start"), F.col(end).alias("end"))
    return df.select(*keep, F.inline(F.array(left, right))).filter("start <= end")


def upstream_end(df: DataFrame, keys: list[str], order: list[str], end: Column, name: str = "reach", width: int = binned.WIDTH) -> DataFrame:
    """``df`` with the furthest ``end`` of the rows before each."""
    return binned.running_max(df, keys, order, end, name, width)


def repaired(df: DataFrame, keys: list[str], start: str, end: str, is_deletion: Column, order: list[str], width: int = binned.WIDTH) -> DataFrame:
    """Blocks behind a deletion: dropped where it covers them, else cut to begin right after it.

    Deletions themselves stay as they are.  ``moved`` tells by how many positions a start moved; the
    caller looks the new reference base up.
    """
    out = upstream_end(df, keys, order, F.when(is_deletion, F.col(end)), "__far", width).withColumn("__reach", F.coalesce("__far", F.col(start) - 1))
    kept = out.filter(is_deletion | (F.col(end) > F.col("__reach")))
    begin = F.when(is_deletion, F.col(start)).otherwise(F.greatest(F.col(start), F.col("__reach") + 1))
    return kept.withColumn("moved", begin - F.col(start)).withColumn(start, begin).drop("__reach", "__far")
