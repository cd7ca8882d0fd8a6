"""Read predicates and the activity pipeline: reads -> pileup evidence -> active regions."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..kernels import recalibration, regioncut
from ..sources.text import cigar_read_length, cigar_ref_length
from ..staging import stage
from . import binned, pileup
from . import relational as rel
from .intervals import overlap_join

REVERSE, PAIRED, UNMAPPED, MATE_UNMAPPED, MATE_REVERSE = 0x10, 0x1, 0x4, 0x8, 0x20
#: Qualities from which a base counts for activity and for reference confidence.
ACTIVE, LEAST_QUALITY, CONFIDENCE_QUALITY = 0.002, 11, 7
CLIP_MEAN, CLIP_MOST = 6, 100
PAD, LEAST_LENGTH = 100, 10
#: A quality is below this; so many read groups at most have their steps broadcast (about a megabyte each).
QUALITIES, MOST_BROADCAST_GROUPS = 94, 64
#: Bases whose qualities are worked out at once.
SLICE = 1 << 20


def filtered(reads: DataFrame) -> DataFrame:
    """Mapped, primary, unique, passing reads of enough mapping quality; supplementary ones stay."""
    return reads.filter(rel.usable_flag(F.col("flag")) & rel.usable_quality(F.col("mapq")))


def well_formed(contigs: DataFrame):
    """A filter for ``--inspect-reads``: placed, with a read group, and as many bases as the CIGAR needs."""

    def apply(reads: DataFrame) -> DataFrame:
        known = contigs.select(F.col("tid").alias("__tid"), F.col("length").alias("__len"))
        ok = (F.col("start") >= 1) & (F.col("end") >= F.col("start")) & F.col("rg").isNotNull() & (F.length("seq") > 0) & (F.length("seq") == cigar_read_length(F.col("cigar"))) & (F.size("qual") == F.length("seq")) & (F.col("start") <= F.col("__len"))
        return reads.join(known, F.col("tid") == F.col("__tid")).filter(ok).drop("__tid", "__len")

    return apply


def good_cigar(cigar: Column) -> Column:
    """No deletion at an end (but for a clip), no neighbouring indels, no skipped reference, some reference used."""
    core = F.filter(cigar, lambda c: ~c["op"].isin("S", "H"))
    pairs = F.zip_with(F.slice(cigar, 1, F.greatest(F.size(cigar) - 1, F.lit(0))), F.slice(cigar, 2, F.greatest(F.size(cigar) - 1, F.lit(0))), lambda a, b: a["op"].isin("I", "D") & b["op"].isin("I", "D"))
    edge = (F.element_at(core, 1)["op"] == "D") | (F.element_at(core, -1)["op"] == "D")
    return (F.size(core) > 0) & (cigar_ref_length(cigar) > 0) & ~F.coalesce(F.when(F.size(core) > 0, edge), F.lit(True)) & ~F.exists(cigar, lambda c: c["op"] == "N") & ~F.exists(pairs, lambda x: x)


def somatic(reads: DataFrame) -> DataFrame:
    """The filter of tumour samples: as ``filtered``, but a quality of 255 passes."""
    return reads.filter(rel.usable_flag(F.col("flag")) & (F.col("mapq") >= rel.LEAST_MAPQ))


def passing(length: Column, mapq: Column, tid: Column, mtid: Column, mate_placed: Column) -> Column:
    """Whether a read counts for likelihoods: long enough, well mapped, its mate not on another contig.

    Reads that don't pass still count in a site's depth.
    """
    return (length >= LEAST_LENGTH) & (mapq >= rel.LEAST_MAPQ) & (~mate_placed | (tid == mtid))


def split_by_passing(reads: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(passing, filtered) reads; for reference confidence only the passing ones count."""
    placed = (F.col("flag").bitwiseAND(PAIRED) != 0) & (F.col("flag").bitwiseAND(MATE_UNMAPPED) == 0) & (F.col("mtid") >= 0)
    ok = passing(F.length("seq"), F.col("mapq"), F.col("tid"), F.col("mtid"), placed)
    return reads.filter(ok), reads.filter(~ok)


def downsampled(reads: DataFrame, k: int = 50, seed: int = 0) -> DataFrame:
    """At most ``k`` reads that start at a position; 0 keeps all."""
    return rel.reservoir(reads, ["tid", "start"], ["qname", "flag", "read_id"], k, seed)


def adaptor_boundary(flag: Column, start: Column, mstart: Column, isize: Column) -> Column:
    """First position of adaptor sequence (last one, for a reverse read); null where the fragment isn't well defined."""
    reverse, mate_reverse = flag.bitwiseAND(REVERSE) != 0, flag.bitwiseAND(MATE_REVERSE) != 0
    defined = (isize != 0) & (flag.bitwiseAND(PAIRED) != 0) & (flag.bitwiseAND(UNMAPPED | MATE_UNMAPPED) == 0) & (reverse != mate_reverse)
    return F.when(defined & (F.abs(isize) <= 100), F.when(reverse, mstart - 1).otherwise(start + F.abs(isize)))


def evidence(reads: DataFrame, reference: DataFrame) -> DataFrame:
    """(tid, bin, pos, cls, qual, hq_clips): one row per aligned or deleted base, cls 0 for variant evidence.

    ``reference`` is (tid, start, bases) in chunks.  See ``operators.pileup``.
    """
    return pileup.evidence(reads, reference, adaptor_boundary(F.col("flag"), F.col("start"), F.col("mstart"), F.col("isize")))


def locus_sums(found: DataFrame) -> DataFrame:
    """Per-site sums of evidence for activity and for reference confidence, in one aggregation."""
    return pileup.site_sums(found, LEAST_QUALITY, CONFIDENCE_QUALITY)


def locus_activity(sums: DataFrame) -> DataFrame:
    """(tid, pos, value, extend) from ``locus_sums``: probability of a variant, and how far high-quality clips extend it."""
    extend = F.when(F.col("clips") > CLIP_MEAN, F.least(F.lit(CLIP_MOST), F.floor("clips"))).otherwise(0).cast("int")
    return sums.filter("depth > 0").select("tid", "pos", rel.activity(F.col("l0"), F.col("l1"), F.col("l2")).alias("value"), extend.alias("extend"))


def active_regions(activity: DataFrame, threshold: float = ACTIVE, width: int = binned.WIDTH) -> DataFrame:
    """(region_id, tid, start, end, active): smoothed activity in runs over the threshold, long runs cut at minima.

    Runs are independent of one another, so each is cut in its own group; only active runs reach Python.
    """
    weight = F.when(F.col("extend") > 0, 2 * F.col("extend") + 1).otherwise(1)
    profile = stage(rel.smoothed(activity, ["tid"], "pos", F.col("value") * weight).filter(F.col("profile") > threshold), "profile")
    numbered = binned.runs(profile, ["tid"], ["pos"], [], lambda before: before["pos"] == F.col("pos") - 1, width=width)

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("pos")
        found = regioncut.cut(frame["pos"].tolist(), frame["profile"].tolist(), threshold)
        return pd.DataFrame([(frame["tid"].iloc[0], a, b, active) for a, b, active in found], columns=["tid", "start", "end", "active"])

    cut = numbered.select("tid", "pos", "profile", F.col("island.pos").alias("run")).groupBy("tid", "run").applyInPandas(run, "tid int, start int, end int, active boolean")
    return cut.withColumn("region_id", F.col("tid").cast("long") * (1 << 32) + F.col("start")).select("region_id", "tid", "start", "end", "active")


def region_reads(regions: DataFrame, reads: DataFrame, pad: int = PAD) -> DataFrame:
    """Each region with the reads that overlap it within ``pad``: a join by bins."""
    spans = regions.select("region_id", F.col("tid").alias("tid"), F.col("start").alias("r_start"), F.col("end").alias("r_end"), (F.col("start") - pad).alias("p_start"), (F.col("end") + pad).alias("p_end"))
    return overlap_join(reads, spans, ["tid"], ("start", "end"), ("p_start", "p_end"), width=4096)


def step_arrays(tables: dict[str, DataFrame], size: int = 2) -> DataFrame:
    """(rg, base, context, cycle, reach): a read group's steps as arrays that a base's covariates index.

    ``base`` by quality; ``context`` by quality and the context's code; ``cycle`` by quality and cycle, ``reach``
    being the greatest cycle.  A read group's entries are bounded by a report's columns.
    """
    one = F.lit(None).cast("int")
    code = F.conv(F.translate("key", "ACGT", "0123"), 4, 10).cast("int")
    rows = tables["base"].select("rg", F.lit(0).alias("kind"), F.col("q").cast("int").alias("q"), one.alias("k"), F.col("value").cast("double").alias("value"))
    rows = rows.unionByName(tables["context"].filter(F.col("key").rlike(r"^[ACGT]+\z") & (F.length("key") == size)).select("rg", F.lit(1).alias("kind"), F.col("q").cast("int").alias("q"), code.alias("k"), F.col("value").cast("double").alias("value")))
    rows = rows.unionByName(tables["cycle"].select("rg", F.lit(2).alias("kind"), F.col("q").cast("int").alias("q"), F.col("key").cast("int").alias("k"), F.col("value").cast("double").alias("value")))

    def laid(frame: pd.DataFrame) -> pd.DataFrame:
        base, context = np.full(QUALITIES, np.nan), np.zeros((QUALITIES, 4**size))
        part = frame[frame["kind"] == 2]
        reach = int(part["k"].abs().max()) if len(part) else 0
        cycle = np.zeros((QUALITIES, 2 * reach + 1))
        cycle[part["q"].to_numpy(int), part["k"].to_numpy(int) + reach] = part["value"]
        part = frame[frame["kind"] == 1]
        context[part["q"].to_numpy(int), part["k"].to_numpy(int)] = part["value"]
        part = frame[frame["kind"] == 0]
        base[part["q"].to_numpy(int)] = part["value"]
        return pd.DataFrame({"rg": [frame["rg"].iloc[0]], "base": [base], "context": [context.ravel()], "cycle": [cycle.ravel()], "reach": [reach]})

    return rows.groupBy("rg").applyInPandas(laid, "rg string, base array<double>, context array<double>, cycle array<double>, reach int")


def _by_slice(steps: DataFrame, size: int):
    """A function of (rg, flag, seq, qual) that gives new qualities, with the steps of all read groups."""
    rows = steps.toArrow().to_pydict()
    held = recalibration.Steps(rows["rg"], rows["base"], rows["context"], rows["cycle"], rows["reach"], QUALITIES)

    @F.arrow_udf("array<int>")
    def new(rg: pa.Array, flag: pa.Array, seq: pa.Array, qual: pa.Array) -> pa.Array:
        lengths = pc.fill_null(pc.list_value_length(qual), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        flat = qual.flatten()
        missing = pc.is_null(flat).to_numpy(zero_copy_only=False)
        quals = pc.fill_null(flat, QUALITIES).to_numpy(zero_copy_only=False).astype(np.int64)
        groups, flags = rg.to_pylist(), pc.fill_null(flag, 0).to_numpy(zero_copy_only=False).astype(np.int64)
        texts = [s or "" for s in seq.to_pylist()]
        stops = np.cumsum(lengths)
        parts, begin = [np.empty(0, np.int32)], 0
        while begin < len(texts):
            low = int(stops[begin] - lengths[begin])
            end = max(begin + 1, int(np.searchsorted(stops, low + SLICE, "right")))
            parts.append(recalibration.recalibrated(held, groups[begin:end], flags[begin:end], texts[begin:end], lengths[begin:end], quals[low : stops[end - 1]], size))
            begin = end
        found = np.concatenate(parts)
        found[missing] = 1  # the least quality, as a null takes none of the steps
        offsets = np.concatenate([[0], stops]).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array(found), mask=pc.is_null(qual))

    return new


def recalibrated(reads: DataFrame, tables: dict[str, DataFrame], size: int = 2) -> DataFrame:
    """Qualities replaced by report quality plus the steps of read group, quality, context and cycle.

    ``tables`` hold precomputed steps, as every datum has one possible prior: ``base`` (rg, q, value),
    ``context`` (rg, q, key, value) and ``cycle`` (rg, q, key, value).  Qualities under 6 stay; results lie in 1..93.
    A read meets its read group's steps once and its bases look them up in place: no base is shuffled.  The steps
    of few read groups go to all workers, which look up a slice of reads at a time; those of more are joined.
    """
    steps = stage(step_arrays(tables, size), "steps")
    if steps.count() <= MOST_BROADCAST_GROUPS:
        return reads.withColumn("qual", _by_slice(steps, size)("rg", "flag", "seq", "qual")).select(*reads.columns)
    names = [F.col("rg").alias("__rg"), F.col("base").alias("__base"), F.col("context").alias("__context"), F.col("cycle").alias("__cycle"), F.col("reach").alias("__reach")]
    steps = steps.select(*names)
    met = reads.join(steps, F.col("rg") == F.col("__rg"), "left")
    reverse, second = F.col("flag").bitwiseAND(REVERSE) != 0, F.col("flag").bitwiseAND(0x80) != 0
    strand = F.when(reverse, F.reverse(F.translate("seq", "ACGT", "TGCA"))).otherwise(F.col("seq"))
    early = F.array_repeat(F.lit(None).cast("string"), F.least(F.length("seq"), F.lit(size - 1)))
    parts = F.concat(early, rel.kmer_array(strand, size))
    codes = F.transform(parts, lambda k: F.when(k.rlike(r"^[ACGT]+\z"), F.conv(F.translate(k, "ACGT", "0123"), 4, 10).cast("int")))
    met = met.withColumns({"__q": F.when(reverse, F.reverse("qual")).otherwise(F.col("qual")), "__codes": codes, "__second": second})

    def new(x: Column, i: Column) -> Column:
        q = x["q"]
        cycle = F.when(F.col("__second"), -(i + 1)).otherwise(i + 1)
        seen = F.abs(cycle) <= F.col("__reach")
        by_cycle = F.when(seen, F.get("__cycle", q * (2 * F.col("__reach") + 1) + cycle + F.col("__reach")))
        by_context = F.when(x["c"].isNotNull(), F.get("__context", q * 4**size + x["c"]))
        value = F.coalesce(F.nanvl(F.get("__base", q), q.cast("double")), q.cast("double")) + F.coalesce(by_context, F.lit(0.0)) + F.coalesce(by_cycle, F.lit(0.0))
        return F.when(q < 6, q).otherwise(F.least(F.lit(93), F.greatest(F.lit(1), F.floor(value + 0.5)))).cast("int")

    changed = F.transform(F.arrays_zip(F.col("__q").alias("q"), F.slice("__codes", F.lit(1), F.size("__q")).alias("c")), new)
    return met.withColumn("qual", F.when(reverse, F.reverse(changed)).otherwise(changed)).select(*reads.columns)
