"""Steps on reads, sites and genotypes as columns, for tables of any meaning."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import phred, special
from . import relational as rel

#: The quality up to which read ends are cut, and the floor and replacement of qualities in the pair-HMM.
POOR_END, QUALITY_FLOOR, LOW_QUALITY = 9, 18, 6
#: Gap penalties of the PCR model, and the cap of qualities where mates overlap.
GAP_OPEN, REPEAT_PENALTY, LEAST_PENALTY, MATE_CAP = 45, 40.0, 10, 20
#: Pseudocounts of the reference and the alternate, when the iteration stops, samples that the coefficient needs.
REF_COUNT, ALT_COUNT, SETTLED, LEAST_SAMPLES = 10.0, 0.01, 0.1, 10
MOST_ROUNDS = 50


# -- reads ---------------------------------------------------------------------------------------------------


def good_span(quals: Column, least: int = POOR_END) -> Column:
    """(first, last) index from 0 of the qualities over ``least``; nulls if none is."""
    places = F.transform(quals, lambda q, i: F.when(q > least, i))
    return F.struct(F.array_min(places).alias("first"), F.array_max(places).alias("last"))


def reverse_complement(bases: Column) -> Column:
    return F.reverse(F.translate(bases, "ACGT", "TGCA"))


def masked(bases: Column) -> Column:
    """Anything but ACGT as N."""
    return F.regexp_replace(F.translate(bases, "acgt", "ACGT"), "[^ACGT]", "N")


def model_quality(quality: Column, mapq: Column, floor: int = QUALITY_FLOOR) -> Column:
    """A base's quality in the pair-HMM: at most the read's mapping quality, the lowest if under the floor."""
    q = F.least(quality, mapq)
    return F.when(q < floor, LOW_QUALITY).otherwise(q)


def pcr_penalty(repeats: Column, rate: float = 3.0) -> Column:
    """Gap-open penalty of a base in a tandem repeat of so many units."""
    return F.least(F.lit(GAP_OPEN), F.greatest(F.lit(LEAST_PENALTY), F.round(REPEAT_PENALTY - F.exp(repeats / (rate * math.pi)) + 1.0).cast("int")))


def mates_capped(first: Column, second: Column, q1: Column, q2: Column, cap: int = MATE_CAP) -> tuple[Column, Column]:
    """Qualities where mates overlap: capped where their bases agree, 0 where they differ."""
    same = first == second
    return tuple(F.when(same, F.least(q, F.lit(cap).cast("long"))).otherwise(F.lit(0).cast("long")) for q in (q1, q2))


def neighbours(df: DataFrame, keys: list[str], order: list[str], value: str, none: str = "N") -> DataFrame:
    """``df`` with the value before and after each row's."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumns({"before": F.coalesce(F.lag(value).over(w), F.lit(none)), "after": F.coalesce(F.lead(value).over(w), F.lit(none))})


def ordered_reads(df: DataFrame, keys: list[str], order: list[str], name: str = "place") -> DataFrame:
    """``df`` with each read's place in its region."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))


# -- regions and sites -----------------------------------------------------------------------------------------


def trim_spans(df: DataFrame, keys: list[str], start: str, stop: str, pad: Column) -> DataFrame:
    """Per region the span of its events with the greatest padding, and their number."""
    return df.groupBy(*keys).agg(F.count("*").alias("n"), (F.min(start) - F.max(pad)).alias("trim_start"), (F.max(stop) + F.max(pad)).alias("trim_end"))


def clip_extension(df: DataFrame, keys: list[str], clips: str, over: float = 6, most: int = 100) -> DataFrame:
    """Mean of high-quality clips per site and how far they extend its activity."""
    mean = df.groupBy(*keys).agg(F.avg(clips).alias("mean"))
    return mean.withColumn("extend", F.when(F.col("mean") > over, F.least(F.lit(most), F.floor("mean"))).otherwise(0).cast("int"))


def site_annotations(df: DataFrame, keys: list[str], mapq: str, quality: Column, dose: Column) -> DataFrame:
    """Depth, RMS mapping quality, quality by depth and chromosome counts of diploid genotypes."""
    out = df.groupBy(*keys).agg(F.count("*").alias("dp"), rel.rms(F.col(mapq)).alias("mq"), F.sum(quality).alias("__q"), F.sum(dose).alias("ac"))
    an = 2 * F.col("dp")
    return out.withColumns({"qd": rel.quality_by_depth(F.col("__q"), F.col("dp")), "an": an, "af": F.col("ac") / an.cast("double")}).drop("__q")


def allele_depths(best: DataFrame, keys: list[str], alleles: int) -> DataFrame:
    """Per site the informative reads of each allele; ``best`` has a row for each read with ``best`` and ``informative``."""
    return best.groupBy(*keys).agg(*[F.count_if((F.col("best") == a) & (F.col("informative") == 1)).alias(f"ad{a}") for a in range(alleles)])


def depth_with_filtered(passing: DataFrame, filtered: DataFrame, keys: list[str]) -> DataFrame:
    """Depth of each site: passing reads, and all with those that don't count for likelihoods."""
    rows = passing.select(*keys, F.lit(1).alias("__p")).unionByName(filtered.select(*keys, F.lit(0).alias("__p")))
    return rows.groupBy(*keys).agg(F.sum("__p").alias("dp_passing"), F.count("*").alias("dp"))


def marginalised_by_map(df: DataFrame, alleles: DataFrame, keys: list[str], haplotype: str, allele: str, likelihood: str) -> DataFrame:
    """Likelihoods of alleles from those of haplotypes, by a table of each haplotype's allele."""
    return rel.marginalised(df.join(alleles, haplotype), keys, allele, likelihood)


def uncalled(sites: DataFrame, calls: DataFrame, keys: list[str]) -> DataFrame:
    """Sites without a call."""
    return sites.join(calls.select(*keys), keys, "left_anti")


def emitted(df: DataFrame, quality: Column, alts: Column, least: float = 30.0) -> DataFrame:
    """Calls of enough quality with an alternate that is more than a spanning deletion."""
    return df.filter((quality >= least) & F.exists(alts, lambda a: a != "*"))


# -- genotypes --------------------------------------------------------------------------------------------------


def subset_pls(pl: Column, kept: Column) -> Column:
    """PLs of the genotypes over the kept alleles (rising, the reference first), the least being 0 again."""
    picked = F.flatten(F.transform(kept, lambda b, j: F.transform(F.slice(kept, F.lit(1), j + 1), lambda a: F.get(pl, phred.genotype_index(a, b)))))
    return F.transform(picked, lambda x: x - F.array_min(picked))


def log_factorial(n: Column) -> Column:
    """ln n! by Stirling's formula and its error."""
    n = n.cast("double")
    return F.when(n <= 0, 0.0).otherwise(special.stirling_error(n) + (n + 0.5) * F.log(F.greatest(n, F.lit(1.0))) - n + special.LN_2PI / 2)


def excess_het(hom_ref: Column, het: Column, hom_alt: Column) -> Column:
    """Phred-scaled mid-p of at least so many heterozygotes under Hardy-Weinberg equilibrium; 160 stands for an underflow."""
    n = hom_ref + het + hom_alt
    rare = 2 * F.least(hom_ref, hom_alt) + het
    counts = F.sequence((rare % 2).cast("int"), F.least(rare, 2 * n - rare).cast("int"), F.lit(2))

    def log_p(h: Column) -> Column:
        return h * math.log(2) - log_factorial(h) - log_factorial((rare - h) / 2) - log_factorial((2 * n - rare - h) / 2)

    def total(rows: Column) -> Column:
        return F.aggregate(rows, F.lit(0.0), lambda acc, x: acc + x["w"])

    logs = F.transform(counts, lambda h: F.struct(h.alias("h"), F.exp(log_p(h) - log_p(het)).alias("w")))
    p = (total(F.filter(logs, lambda x: x["h"] > het)) + 0.5) / total(logs)
    return F.when((n == 0) | (rare == 0), 0.0).when(p < 10e-60, 160.0).otherwise(F.greatest(F.lit(0.0), -10.0 * F.log10(p)))


def inbreeding(hom_ref: Column, het: Column, hom_alt: Column, least: int = LEAST_SAMPLES) -> Column:
    """1 less heterozygotes seen over those expected; null of fewer samples, or where one allele alone is seen."""
    n = (hom_ref + het + hom_alt).cast("double")
    p = (2 * hom_ref + het) / (2 * n)
    return F.when((n >= least) & (p > 0) & (p < 1), 1.0 - het / (2.0 * p * (1.0 - p) * n))


def allele_frequency(weights: Column, ref_count: float = REF_COUNT, alt_count: float = ALT_COUNT, rounds: int = MOST_ROUNDS) -> Column:
    """Expectation-maximisation of a biallelic site's alternate count from its samples' likelihoods.

    ``weights`` is an array of (r, h, a): likelihoods of hom-ref, het and hom-alt.  Gives a struct of ``count``, the
    expected alternate alleles, and ``log10_none``, the log10 probability that no sample has one.
    """
    n = F.size(weights).cast("double")
    start = F.struct(F.lit(0.5).alias("f"), F.lit(0.0).alias("count"), F.lit(0.0).alias("ref"), F.lit(0.0).alias("log10_none"), F.lit(False).alias("done"))

    def step(acc: Column, _: Column) -> Column:
        f = acc["f"]

        def sample(sums: Column, w: Column) -> Column:
            r, h, a = (1.0 - f) * (1.0 - f) * w["r"], 2.0 * f * (1.0 - f) * w["h"], f * f * w["a"]
            return F.struct((sums["c"] + (h + 2.0 * a) / (r + h + a)).alias("c"), (sums["z"] + F.log10(r / (r + h + a))).alias("z"))

        def moved(s: Column) -> Column:
            ref = 2.0 * n - s["c"]
            settled = F.greatest(F.abs(s["c"] - acc["count"]), F.abs(ref - acc["ref"])) <= SETTLED
            return F.struct(((alt_count + s["c"]) / (ref_count + alt_count + 2.0 * n)).alias("f"), s["c"].alias("count"), ref.alias("ref"), s["z"].alias("log10_none"), settled.alias("done"))

        return F.when(acc["done"], acc).otherwise(F.aggregate(weights, F.struct(F.lit(0.0).alias("c"), F.lit(0.0).alias("z")), sample, moved))

    return F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), start, step, lambda acc: F.struct(acc["count"].alias("count"), acc["log10_none"].alias("log10_none")))
