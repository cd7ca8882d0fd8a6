"""Mixing sources to target weights by Pareto order sampling.

Each source gets a target number of words.  Inside a source a document has expected copies
``e = min(max_copies, c * w)`` where ``w`` is its preference (longer documents are preferred
mildly) and ``c`` makes the expected words meet the target.  ``floor(e)`` copies are certain;
the fraction ``p`` is an inclusion probability.  Documents are ranked by
``q = (u / (1 - u)) / (p / (1 - p))`` with a uniform hash ``u`` and taken in that order until
the words that are left of the target are filled: a fixed-size, unequal-probability sample.  The
document on the cut is taken whole or left out, whichever comes nearer to the target.  Only where that would miss it
by more than ``MISS`` of the target is the document taken in part: its first words, as they stand in the text.

The cut is found without sorting a source: sums over 256 buckets of ``q / (1 + q)``, then over
256 buckets inside the bucket that holds the cut, then a window over that last bucket alone.

Defined results: a null text has size 0 and is taken 0 times; a null source is a source of its
own, after all others; no rows give no rows; ties in ``q`` (rows with an equal id) are ordered by
id and size and are interchangeable when all of these agree; other columns of the input are never
looked at, whatever their names are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._common import stage

WORD = r"[^\x20\x09-\x0D]+"
BUCKETS = 256
#: The share of a source's target by which whole documents may miss it.
MISS = 0.01


def word_count(text: Column) -> Column:
    """Words are runs of characters other than ASCII white space; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def uniform(key: Column, seed: int) -> Column:
    """A number in (0, 1) from the first 52 bits of a hash of the seed and the key."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit("")))
    return (F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") + 0.5) / float(2**52)


def targets(per_source: DataFrame, cycle: tuple[int, ...] = (1, 2, 3), max_copies: int = 3) -> DataFrame:
    """(source, source_size) -> (source, source_size, target).

    Weights repeat ``cycle`` over the sources by code point, null last.  They share the sum of
    all sizes; a target stops at ``max_copies`` times its source's size and the excess is shared
    again by weight.  One row per source: the only windows here without a partition.
    """
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in cycle]), (place % len(cycle) + 1).cast("int"))
    order = Window.orderBy("cap_by_weight", F.col("source").asc_nulls_last())
    before, after = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    every = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    shared = (
        per_source.withColumn("weight", weight)
        .withColumn("cap", (F.col("source_size") * max_copies).cast("double"))
        .withColumn("cap_by_weight", F.col("cap") / F.col("weight"))
        .withColumn("total", F.sum("source_size").over(every).cast("double"))
        .withColumn("level", (F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(after))
        .withColumn("free", F.max(F.when(F.col("level") * F.col("weight") <= F.col("cap"), 1).otherwise(0)).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    )
    first = F.first(F.when(F.col("free") == 1, F.col("level")), ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0))
    return shared.withColumn("target", F.when(F.col("free") == 1, first * F.col("weight")).otherwise(F.col("cap"))).select("source", "source_size", "target")


def plan_classes(rows: DataFrame, cycle: tuple[int, ...], max_copies: int) -> DataFrame:
    """Per (source, class): certain copies, inclusion probability; per source: target and words left for the sample."""
    classes = rows.groupBy("source", "cls").agg(F.sum("size").alias("cls_size"))
    per_source = classes.groupBy("source").agg(F.sum("cls_size").alias("source_size"))
    aim = targets(per_source, cycle, max_copies).withColumnRenamed("source", "aim_source")
    w = (F.col("cls") + 1).cast("double")
    order = Window.partitionBy("source").orderBy(F.col("cls").desc())
    before, after = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    whole_source = Window.partitionBy("source")
    solved = (
        classes.join(aim, F.col("source").eqNullSafe(F.col("aim_source")))
        .withColumn("c", F.try_divide(F.col("target") - max_copies * F.coalesce(F.sum("cls_size").over(before), F.lit(0)), F.sum(w * F.col("cls_size")).over(after)))
        .withColumn("c_here", F.when((F.col("c") * w <= max_copies), F.col("c")))
        .withColumn("c_free", F.first("c_here", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0)))
        .withColumn("copies", F.when(F.col("c_free").isNull(), F.lit(float(max_copies))).otherwise(F.least(F.lit(float(max_copies)), F.greatest(F.lit(0.0), F.col("c_free") * w))))
        .withColumn("whole", F.floor("copies").cast("long"))
        .withColumn("p", F.col("copies") - F.col("whole"))
    )
    left = F.greatest(F.lit(0.0), F.col("target") - F.sum(F.col("whole") * F.col("cls_size")).over(whole_source))
    return solved.withColumn("left", F.round(left).cast("long")).select(F.col("source").alias("p_source"), F.col("cls").alias("p_cls"), "source_size", "target", "whole", "p", "left")


def _cut(sums: DataFrame, bucket: str, limit: str) -> DataFrame:
    """Per source: the bucket in which the running sum of words passes ``limit``, and the words left there."""
    order = Window.partitionBy("source").orderBy(bucket).rowsBetween(Window.unboundedPreceding, 0)
    return (
        sums.withColumn("upto", F.sum("words").over(order))
        .withColumn("rest", F.col(limit) - (F.col("upto") - F.col("words")))
        .filter((F.col("rest") > 0) & (F.col("upto") >= F.col(limit)))
    )


def pareto_mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", cycle: tuple[int, ...] = (1, 2, 3), max_copies: int = 3, seed: int = 17, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per document: id, ``size``, ``source_size``, ``target``, ``whole`` certain copies, ``taken`` words.

    ``keep`` names further input columns to carry; they come back with the prefix ``in_``.
    """
    base = docs.select(F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("source"), word_count(F.col(text_col)).alias("size"), *[F.col(k).alias(f"in_{k}") for k in keep])
    base = base.withColumn("cls", F.floor(F.log2(F.col("size") + 1)).cast("int"))
    rows = stage(base.withColumn("u", uniform(F.col("id"), seed)), "mix")
    plan = stage(plan_classes(rows, cycle, max_copies), "mix-plan")
    odds_in, odds_out = F.col("u") * (1 - F.col("p")), F.col("p") * (1 - F.col("u"))
    z = F.when(F.col("p") > 0, odds_in / (odds_in + odds_out))
    ranked = (
        rows.join(plan, F.col("source").eqNullSafe(F.col("p_source")) & (F.col("cls") == F.col("p_cls")))
        .withColumn("z", z)
        .withColumn("b1", F.floor(F.col("z") * BUCKETS).cast("int"))
        .withColumn("b2", F.floor((F.col("z") * BUCKETS - F.col("b1")) * BUCKETS).cast("int"))
    )
    sums1 = ranked.filter("z is not null").groupBy("source", "left", "b1").agg(F.sum("size").alias("words"))
    cut1 = stage(_cut(sums1, "b1", "left").select(F.col("source").alias("c1_source"), F.col("b1").alias("c1"), F.col("rest").alias("rest1")), "mix-cut")
    in_cut1 = ranked.join(cut1, F.col("source").eqNullSafe(F.col("c1_source")) & (F.col("b1") == F.col("c1")))
    sums2 = in_cut1.groupBy("source", "c1", "rest1", "b2").agg(F.sum("size").alias("words"))
    cut2 = stage(_cut(sums2, "b2", "rest1").select(F.col("source").alias("c_source"), "c1", F.col("b2").alias("c2"), F.col("rest").alias("rest2")), "mix-cut")
    placed = ranked.join(cut2, F.col("source").eqNullSafe(F.col("c_source")), "left")
    at_cut = (F.col("b1") == F.col("c1")) & (F.col("b2") == F.col("c2"))
    below = (F.col("b1") < F.col("c1")) | ((F.col("b1") == F.col("c1")) & (F.col("b2") < F.col("c2")))
    clear = placed.filter(~F.coalesce(at_cut, F.lit(False))).withColumn("extra", F.when(below, F.col("size")).otherwise(0))
    # Only the documents of one bucket in 65536 of a source reach this window.
    order = Window.partitionBy("source").orderBy("z", "id", "size").rowsBetween(Window.unboundedPreceding, -1)
    tied = placed.filter(F.coalesce(at_cut, F.lit(False))).withColumn("extra", F.greatest(F.lit(0), F.least(F.col("size"), F.col("rest2") - F.coalesce(F.sum("size").over(order), F.lit(0)))))
    part, other = F.col("extra"), F.col("size") - F.col("extra")
    whole = (part > 0) & (other > 0) & (F.least(part, other) <= MISS * F.col("target"))
    tied = tied.withColumn("extra", F.when(whole, F.when(part >= other, F.col("size")).otherwise(0)).otherwise(part))
    out = clear.unionByName(tied)
    return out.select(F.col("id").alias(id_col), F.col("source").alias(source_col), "size", "source_size", "target", "whole", F.col("extra").cast("long").alias("extra"), (F.col("whole") * F.col("size") + F.col("extra")).cast("long").alias("taken"), *[f"in_{k}" for k in keep])


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: the documents' columns, a row for each copy taken; a copy that is taken in part holds its first words and what stands between them."""
    mix = pareto_mix(docs, keep=("text", "lang"), **options)
    part = (F.col("extra") > 0) & (F.col("extra") < F.col("size"))
    n = F.greatest(F.col("extra"), F.lit(1)).cast("int")
    words, gaps = F.regexp_extract_all("in_text", F.lit(WORD), F.lit(0)), F.split("in_text", WORD, -1)
    first = F.array_join(F.zip_with(F.slice(gaps, F.lit(1), n), F.slice(words, F.lit(1), n), lambda g, w: F.concat(g, w)), "")
    copies = F.concat(F.array_repeat(F.col("in_text"), F.col("whole").cast("int")), F.when(part, F.array(first)).when(F.col("extra") > 0, F.array("in_text")).otherwise(F.array().cast("array<string>")))
    out = mix.filter((F.col("taken") > 0) & F.col("in_text").isNotNull()).withColumn("copy", F.explode(copies))
    return out.select("doc_id", F.col("copy").alias("text"), F.col("in_lang").alias("lang"), "source", F.length("copy").cast("long").alias("n_chars"))


def op1_query(spark, sf_dir: str) -> DataFrame:
    from ._common import documents

    return pareto_mix(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken", "source", "whole")


#: The same mix in SQL: a source is ordered as a whole, where the operator finds the cut by buckets.
OP1_SQL = r"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents),
r AS (SELECT *, floor(log2(size + 1))::INT AS cls, (('0x' || substr(md5('17:' || coalesce(doc_id::VARCHAR, '')), 1, 13))::BIGINT + 0.5) / 4503599627370496.0 AS u FROM d),
k AS (SELECT source, cls, sum(size)::BIGINT AS cls_size FROM r GROUP BY 1, 2),
s AS (SELECT source, sum(cls_size)::BIGINT AS source_size FROM k GROUP BY 1),
w AS (SELECT *, (1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3)::DOUBLE AS weight, (source_size * 3)::DOUBLE AS cap, (sum(source_size) OVER ())::DOUBLE AS total FROM s),
l AS (SELECT *, (total - coalesce(sum(cap) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0))
    / sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w),
f AS (SELECT *, first_value(CASE WHEN level * weight <= cap THEN level END IGNORE NULLS) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS first FROM l),
t AS (SELECT source, source_size, CASE WHEN first IS NOT NULL THEN first * weight ELSE cap END AS target FROM f),
c AS (SELECT k.source, k.cls, k.cls_size, t.source_size, t.target, (k.cls + 1)::DOUBLE AS cw,
    (t.target - 3 * coalesce(sum(k.cls_size) OVER (PARTITION BY k.source ORDER BY k.cls DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / nullif(sum((k.cls + 1)::DOUBLE * k.cls_size) OVER (PARTITION BY k.source ORDER BY k.cls DESC ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 0) AS c
    FROM k JOIN t ON k.source IS NOT DISTINCT FROM t.source),
g AS (SELECT *, first_value(CASE WHEN c * cw <= 3 THEN c END IGNORE NULLS) OVER (PARTITION BY source ORDER BY cls DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cf FROM c),
h AS (SELECT *, CASE WHEN cf IS NULL THEN 3.0 ELSE least(3.0, greatest(0.0, cf * cw)) END AS copies FROM g),
p AS (SELECT *, floor(copies)::BIGINT AS whole, copies - floor(copies) AS p FROM h),
q AS (SELECT *, round(greatest(0.0, target - sum(whole * cls_size) OVER (PARTITION BY source)))::BIGINT AS rest FROM p),
z AS (SELECT r.doc_id, r.source, r.size, q.source_size, q.target, q.whole, q.rest, CASE WHEN q.p > 0 THEN r.u * (1 - q.p) / (r.u * (1 - q.p) + q.p * (1 - r.u)) END AS z
    FROM r JOIN q ON r.source IS NOT DISTINCT FROM q.source AND r.cls = q.cls),
x AS (SELECT *, CASE WHEN z IS NULL THEN 0 ELSE greatest(0, least(size, rest - coalesce(sum(CASE WHEN z IS NULL THEN 0 ELSE size END) OVER (PARTITION BY source ORDER BY z NULLS LAST, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))) END AS part FROM z),
y AS (SELECT *, CASE WHEN part > 0 AND part < size AND least(part, size - part) <= 0.01 * target THEN CASE WHEN part >= size - part THEN size ELSE 0 END ELSE part END AS extra FROM x)
SELECT doc_id, size, source_size, target, (whole * size + extra)::BIGINT AS taken, source, whole FROM y"""
