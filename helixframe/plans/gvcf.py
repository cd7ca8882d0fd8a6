"""Reference confidence: hom-ref likelihoods of each site, bands of them, and their stitching with calls."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import phred
from ..kernels import cigar as cg
from ..kernels.reads import rules_out_indels
from ..kernels.stats import INDEL_READS, indel_pls
from ..operators import binned
from ..operators import reads as rd
from ..operators import relational as rel
from ..operators.intervals import overlap_join
from ..staging import stage
from . import caller

INDEL_LONGEST = 10


def _quality(pl: Column) -> Column:
    return phred.genotype_quality(pl)


def site_confidence(sums: DataFrame, informative: DataFrame | None = None) -> DataFrame:
    """(tid, pos, dp, ad, pl, gq): the worse of the substitution model and the indel model at each site.

    ``sums`` as from ``operators.reads.locus_sums``; ``informative`` (tid, pos, n) counts reads that rule an indel out
    (without it every reference base counts).  Likelihoods of other genotypes never exceed hom-ref's.
    """
    sites = sums.filter("ref + other > 0")
    if informative is not None:
        sites = sites.join(informative.select("tid", "pos", F.col("n").alias("__n")), ["tid", "pos"], "left")
    n = F.least(F.coalesce(F.col("__n"), F.lit(0)) if informative is not None else F.col("ref"), F.lit(INDEL_READS)).cast("int")
    table = F.array(*[F.array(*[F.lit(x) for x in indel_pls(k)]) for k in range(INDEL_READS + 1)])
    snp = phred.pl_of(F.array("c0", F.least("c1", "c0"), F.least("c2", "c0")))
    both = sites.withColumn("snp", snp).withColumn("indel", F.element_at(table, n + 1))
    pl = F.when(_quality(F.col("snp")) <= _quality(F.col("indel")), F.col("snp")).otherwise(F.col("indel"))
    out = both.withColumn("pl", pl)
    return out.select("tid", "pos", (F.col("ref") + F.col("other")).alias("dp"), F.array("ref", "other").alias("ad"), "pl", F.least(F.lit(99), _quality(F.col("pl"))).alias("gq"))


def informative_reads(reads: DataFrame, reference: DataFrame) -> DataFrame:
    """(tid, pos, n): how many reads lie over a site such that no indel of up to ten bases fits them as well."""
    spans = reads.select(F.col("read_id").alias("region_id"), "tid", "start", F.col("end"))
    under = caller.windows(spans, reference, left=0, right=INDEL_LONGEST).select(F.col("region_id").alias("__id"), "w_start", "w_bases")
    met = reads.select("read_id", "tid", "start", "cigar", "seq", "qual").join(under, F.col("read_id") == F.col("__id")).filter(F.col("w_start") == F.col("start"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            tids, places = [], []
            for row in b.itertuples(index=False):
                cigar = [(x["op"], x["len"]) for x in row.cigar]
                bases, at = cg.against_reference(row.seq, cigar)
                quals = [int(row.qual[k]) if k >= 0 else 0 for k in at]
                good = rules_out_indels(bases, quals, row.w_bases) & (np.array(at) >= 0)
                places.append(row.start + np.flatnonzero(good)), tids.append(np.full(len(places[-1]), row.tid))
            if places:
                found = pd.DataFrame({"tid": np.concatenate(tids), "pos": np.concatenate(places)})
                yield found.groupby(["tid", "pos"]).size().reset_index(name="n")

    return met.mapInPandas(run, "tid int, pos int, n long").groupBy("tid", "pos").agg(F.sum("n").alias("n"))


def covered(calls: DataFrame) -> DataFrame:
    """(tid, pos): the positions that calls span."""
    return calls.select("tid", F.explode(F.sequence(F.col("start"), F.col("stop"))).alias("pos")).distinct()


def bare(marks: DataFrame, targets: DataFrame, width: int = binned.WIDTH) -> DataFrame:
    """(tid, s, e): the stretches of the targets (tid, start, end) without a position in ``marks``."""
    edges = targets.select("tid", F.explode(F.array((F.col("start") - 1).cast("int"), (F.col("end") + 1).cast("int"))).alias("pos"))
    ordered = binned.running_max(marks.select("tid", "pos").unionByName(edges).distinct(), ["tid"], ["pos"], F.col("pos"), "__before", width)
    gaps = ordered.select("tid", (F.col("__before") + 1).alias("g_start"), (F.col("pos") - 1).alias("g_end")).filter("g_start <= g_end")
    spans = targets.select("tid", F.col("start").alias("t_start"), F.col("end").alias("t_end"))
    met = overlap_join(gaps, spans, ["tid"], ("g_start", "g_end"), ("t_start", "t_end"), width=1 << 20)
    return met.select("tid", F.greatest("g_start", "t_start").cast("int").alias("s"), F.least("g_end", "t_end").cast("int").alias("e"))


def blocks(sites: DataFrame, calls: DataFrame | None = None, bounds: tuple[int, ...] = rel.BANDS, targets: DataFrame | None = None, width: int = binned.WIDTH) -> DataFrame:
    """Hom-ref blocks (tid, start, end, gq, dp, min_dp, pl) of sites that no call spans.

    With ``targets`` (tid, start, end; they must not overlap) sites without reads are blocks as well, of
    quality and depth 0: then blocks and calls together hold each position of the targets.  A block that runs into
    a called deletion ends before it, and what the deletion spans is in no block.
    """
    rows = sites.select("tid", F.col("pos").alias("s"), F.col("pos").alias("e"), "gq", "dp", *[F.col("pl")[i].alias(f"pl{i}") for i in range(3)])
    taken = covered(calls) if calls is not None else None
    marks = sites.select("tid", "pos")
    if taken is not None:
        rows = rows.join(taken.select("tid", F.col("pos").alias("s")), ["tid", "s"], "left_anti")
        marks = marks.unionByName(taken)
    if targets is not None:
        none = bare(marks, targets, width).select("tid", "s", "e", F.lit(0).alias("gq"), F.lit(0).cast("long").alias("dp"), *[F.lit(0).alias(f"pl{i}") for i in range(3)])
        rows = rows.select("tid", "s", "e", "gq", "dp", "pl0", "pl1", "pl2").unionByName(none)
    found = rel.banded(stage(rows, "sites"), ["tid"], "s", "e", "gq", "dp", ["pl0", "pl1", "pl2"], bounds=bounds, width=width)
    pl = F.array("pl0", "pl1", "pl2")
    return found.select("tid", "start", "end", phred.genotype_quality(pl).alias("gq"), F.col("median_dp").alias("dp"), "min_dp", pl.alias("pl"))


def block_lines(found: DataFrame, contigs: DataFrame, reference: DataFrame) -> DataFrame:
    """(tid, start, line): hom-ref blocks as text records, the reference base looked up in chunks."""
    chunks = reference.select(F.col("tid").alias("__t"), F.col("start").alias("__s"), "bases", F.lit(0).alias("__bin"))
    width = F.col("__s") + F.length("bases") - 1
    spread = chunks.withColumn("__k", F.explode(F.sequence(F.floor(F.col("__s") / 4096), F.floor(width / 4096))))
    joined = found.withColumn("__key", F.floor(F.col("start") / 4096)).join(spread, (F.col("tid") == F.col("__t")) & (F.col("__key") == F.col("__k")) & F.col("start").between(F.col("__s"), width))
    base = F.substring("bases", (F.col("start") - F.col("__s") + 1).cast("int"), F.lit(1))
    names = contigs.select(F.col("tid").alias("__c"), "name")
    text = F.concat_ws(":", F.lit("0/0"), F.col("dp").cast("string"), F.least(F.lit(99), F.col("gq")).cast("string"), F.col("min_dp").cast("string"), F.array_join(F.transform("pl", lambda x: x.cast("string")), ","))
    line = F.concat_ws("\t", "name", F.col("start").cast("string"), F.lit("."), base, F.lit("<NON_REF>"), F.lit("."), F.lit("."), F.concat(F.lit("END="), F.col("end").cast("string")), F.lit("GT:DP:GQ:MIN_DP:PL"), text)
    return joined.join(names, F.col("tid") == F.col("__c")).select("tid", "start", line.alias("line"))


def write(spark, reads: DataFrame, reference: DataFrame, contigs: DataFrame, path: str, sample: str = "sample", bounds: tuple[int, ...] = rel.BANDS, intervals: DataFrame | None = None, style: dict | None = None, **options) -> None:
    """Calls and hom-ref blocks in genome order as a GVCF that holds each position of the contigs, or of the intervals, once."""
    prepare = {k: options.pop(k) for k in ("depth", "seed", "recal", "inspect") if k in options}
    used, sums = caller.prepared(reads, reference, intervals, **prepare)
    calls = stage(caller.call_sites(used, sums, reference, mode="GVCF", **options), "calls")
    targets = intervals if intervals is not None else contigs.select("tid", F.lit(1).alias("start"), F.col("length").cast("int").alias("end"))
    sites = site_confidence(sums, informative_reads(rd.split_by_passing(used)[0], reference))
    free = blocks(sites, calls, bounds, targets)
    lines = caller.vcf_lines(calls, contigs, gvcf=True).unionByName(block_lines(free, contigs, reference))
    caller.write_lines(spark, lines, caller.header_lines(contigs, sample, bounds), path, style)
