"""The caller: reads and reference to variant calls, as one chain of DataFrames.

Relational stages stay in Catalyst.  From a region's reads on (assembly, pair-HMM, genotyping) a
group is small by construction: regions span at most 300 positions and each position starts at most
``depth`` reads, so a grouped map over regions has bounded groups.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..kernels import assembly, cigar as cg, events as ev, pairhmm, stats
from ..kernels.align import READ, smith_waterman
from ..kernels.reads import mates_reconciled
from ..operators import reads as rd
from ..operators.intervals import overlap_join
from ..operators.relational import FISHER_LIMIT
from ..schemas import CALLS, HAPLOTYPES
from ..staging import stage

REFERENCE_PAD, LEAST_LENGTH, CONFIDENCE = 100, 10, 30.0
FLOOR, MOST_ALTS, MOST_ALLELES, NO_CALL = 4.5, 6, 50, -0.1
#: Padding around substitutions and around indels; how far beyond the intervals reads can matter for what is called inside.
SNP_PAD, INDEL_PAD, INTERVAL_REACH = 20, 75, 500


def _prepared(row, left: int, right: int) -> tuple[str, list[int], int, int] | None:
    """A read's bases, qualities, start and the bases cut from its left, clipped to a span with poor ends cut; None if little is left."""
    parts = [(x["op"], x["len"]) for x in row["cigar"]]
    seq, qual, start = row["seq"], list(row["qual"]), row["start"]
    core, start = cg.soft_clips_reverted(parts, start) if row["isize"] else (cg.soft_clips_hardened(parts), start)
    lead = sum(n for op, n in parts[:2] if op == "S") if not row["isize"] or core[:1] == [] else 0
    trail = sum(n for op, n in parts[-2:] if op == "S") if not row["isize"] and len(parts) > 1 else 0
    a, b = lead, len(seq) - trail
    while a < b and qual[a] <= 9:
        a += 1
    while b > a and qual[b - 1] <= 9:
        b -= 1
    shift = cg.start_shift(core, a - lead)
    at = start + shift
    a, b, at = _without_adaptor(row, a, b, at)
    if at < left:
        a += min(b - a, left - at)
        at = left
    over = at + (b - a) - 1 - right
    if over > 0:
        b -= min(over, b - a)
    if b - a < LEAST_LENGTH:
        return None
    return seq[a:b], qual[a:b], at, a


def _without_adaptor(row, a: int, b: int, at: int) -> tuple[int, int, int]:
    """Ends without bases past the fragment's end, where mates are on opposite strands of a fragment shorter than a read."""
    flag, size = int(row["flag"]), int(row["isize"])
    paired = flag & rd.PAIRED and not flag & (rd.UNMAPPED | rd.MATE_UNMAPPED)
    if not size or not paired or bool(flag & rd.REVERSE) == bool(flag & rd.MATE_REVERSE) or abs(size) > b - a:
        return a, b, at
    if flag & rd.REVERSE:
        cut = max(0, int(row["mstart"]) - at)
        return min(b, a + cut), b, at + cut
    return a, min(b, a + max(0, int(row["start"]) + abs(size) - at)), at


def _log10_fisher(table: list[int]) -> float:
    import math

    total = sum(table)
    if total > FISHER_LIMIT:
        table = [int(x * 200 / total) for x in table]
    a, b, c, d = table
    r1, r2, c1, n = a + b, c + d, a + c, a + b + c + d
    lf = lambda x: math.lgamma(x + 1.0)

    def p(x: int) -> float:
        return lf(r1) + lf(r2) + lf(c1) + lf(n - c1) - lf(n) - lf(x) - lf(r1 - x) - lf(c1 - x) - lf(r2 - c1 + x)

    seen = p(a)
    tail = sum(math.exp(p(x)) for x in range(max(0, c1 - r2), min(r1, c1) + 1) if p(x) <= seen + 1e-7)
    return max(0.0, -10 * math.log10(max(min(1.0, tail), 1e-320)))


def _odds(table: list[int]) -> float:
    import math

    a, b, c, d = (x + 1.0 for x in table)
    r = a * d / (b * c)
    return math.log(r + 1 / r) + math.log(min(a, b) / max(a, b)) - math.log(min(c, d) / max(c, d))


def variant_span(events: list[ev.Event], first: int, last: int, window: str, window_start: int) -> tuple[int, int] | None:
    """The span of the events over first..last with its padding, inside the window: more around indels, and over the repeats they stand in."""
    here = [e for e in events if e[0] <= last and e[1] >= first]
    if not here:
        return None
    pad = SNP_PAD
    for start, _, was, now in here:
        if len(was) != len(now):
            moved = was[len(now) :] or now[len(was) :]
            unit = ev.repeat_unit(moved)
            times = ev.repetitions(unit, window[start + 1 - window_start :])
            pad = max(pad, INDEL_PAD + (len(unit) * times if times > 1 else 0))
    return max(window_start, min(e[0] for e in here) - pad), min(window_start + len(window) - 1, max(e[1] for e in here) + pad)


def trimmed_haplotypes(haps: list[assembly.Haplotype], a: int, b: int) -> list[assembly.Haplotype]:
    """Haplotypes cut to offsets a..b of the reference window, the reference first, each sequence once; without those that have no base at an end."""
    out: dict[str, assembly.Haplotype] = {}
    for h in sorted(haps, key=lambda h: not h.is_ref):
        bases = cg.bases_covering(h.bases, h.cigar, a, b)
        cigar = cg.trimmed(h.cigar, a, b, True)[0] if bases else []
        if bases and cg.read_length(cigar) == len(bases) and bases not in out:
            out[bases] = assembly.Haplotype(bases, cigar, h.score, h.k, h.is_ref)
    return list(out.values())


def realigned(seq: str, at: int, hap: assembly.Haplotype, window: str, window_start: int) -> tuple[int, cg.Cigar]:
    """A read's start and CIGAR on the reference by way of the haplotype that it fits best, indels left-aligned."""
    plain = at, [("M", len(seq))]
    offset, found = smith_waterman(hap.bases, seq, READ)
    core = [x for x in found if x[0] != "S"]
    if not any(op in cg.ALIGNED for op, _ in core):
        return plain
    lead, trail = (n if op == "S" else 0 for op, n in (found[0], found[-1]))
    r = q = 0
    for op, n in hap.cigar:
        if op in cg.ON_READ and q + n > offset:
            r += offset - q if op in cg.ON_REF else 0
            break
        q, r = q + (n if op in cg.ON_READ else 0), r + (n if op in cg.ON_REF else 0)
    try:
        part, skipped, _ = cg.trimmed(hap.cigar, offset, offset + cg.ref_length(core) - 1, False)
        out, cut, _ = cg.built(cg.composed(core, part))
    except ValueError:
        return plain
    start = window_start + r + skipped + cut
    out = cg.left_aligned(window, seq[lead : len(seq) - trail], out, start - window_start)
    return start, cg.merged([("S", lead), *out, ("S", trail)])


def _passes(row) -> bool:
    """Whether a read counts for likelihoods; others count in depth only."""
    placed = row["flag"] & rd.PAIRED and not row["flag"] & rd.MATE_UNMAPPED and row["mtid"] >= 0
    return not placed or row["mtid"] == row["tid"]


def call_region(frame: pd.DataFrame, window: str, window_start: int, confidence: float = CONFIDENCE, gvcf: bool = False, model: str = "conservative", floor: int = pairhmm.QUALITY_FLOOR) -> list[dict]:
    """Calls of one region from its reads and its padded reference window."""
    frame = frame.sort_values(["start", "qname", "flag", "read_id"])
    first, last = int(frame["r_start"].iloc[0]), int(frame["r_end"].iloc[0])
    records = frame.to_dict("records")
    aside = [row for row in records if not _passes(row)]

    def within(left: int, right: int) -> list[tuple]:
        usable = [(row, *got) for row in records if _passes(row) and (got := _prepared(row, left, right)) is not None]
        fixed = mates_reconciled([(row["qname"], seq, qual, at) for row, seq, qual, at, _ in usable])
        return [(row, seq, qual, at, skip) for (row, seq, _, at, skip), qual in zip(usable, fixed, strict=True)]

    usable = within(window_start, window_start + len(window) - 1)
    haps = assembly.assemble(window, [(seq, qual) for _, seq, qual, _, _ in usable])
    # region, haplotypes and reads are trimmed to the variation and its padding
    span = variant_span([e for h in haps for e in ev.haplotype_events(h.bases, h.cigar, window, window_start)], first, last, window, window_start)
    if len(haps) < 2 or not usable or span is None:
        return []
    a, b = span
    haps = trimmed_haplotypes(haps, a - window_start, b - window_start)
    window, window_start = window[a - window_start : b - window_start + 1], a
    usable = within(a, b)
    if len(haps) < 2 or not usable:
        return []
    events = [ev.haplotype_events(h.bases, h.cigar, window, window_start) for h in haps]
    # likelihoods: floored near the best, reads that fit nothing dropped; each read is then laid along its best haplotype
    kept, matrix = [], []
    for row, seq, qual, at, skip in usable:
        q = pairhmm.model_qualities(np.array(qual), int(row["mapq"]), floor)
        lk = pairhmm.likelihoods(seq, q, [h.bases for h in haps], pairhmm.gap_penalties(seq, model))
        if lk.max() < -4.0 * min(2.0, np.ceil(0.02 * len(seq))):
            continue
        start, cigar = realigned(seq, at, haps[int(lk.argmax())], window, window_start)
        kept.append((row, qual, start, cigar, start + cg.ref_length(cigar) - 1, skip))
        matrix.append(np.maximum(lk, lk.max() - FLOOR))
    if not kept:
        return []
    matrix = np.array(matrix)
    calls: list[dict] = []
    reach = 0
    phase_of: list[tuple[str, frozenset[int]]] = []
    for locus in sorted({e[0] for x in events for e in x if first <= e[0] <= last}):
        over = [ev.overlapping(x, locus) for x in events]
        alleles = ev.merged_alleles(sorted({e for x in over for e in x}), locus)
        ref = alleles[0]

        def allele_of(hap: int) -> int:
            here = [e for e in over[hap] if e[0] == locus]  # noqa: B023
            if here:
                return alleles.index(here[0][3] + ref[len(here[0][2]) :])  # noqa: B023
            return alleles.index("*") if any(e[0] < locus for e in over[hap]) and "*" in alleles else 0  # noqa: B023

        owner = np.array([allele_of(h) for h in range(len(haps))])
        stop = locus + len(ref) - 1
        near = [i for i, (_, _, start, _, end, _) in enumerate(kept) if start <= stop + 2 and end >= locus - 2]
        if not near or len(alleles) > MOST_ALLELES:
            continue
        lk = np.stack([matrix[near][:, owner == a].max(axis=1) if (owner == a).any() else np.full(len(near), -1e3) for a in range(len(alleles))], axis=1)
        if len(alleles) > MOST_ALTS + 1:
            gain = (lk[:, 1:] - lk[:, :1]).clip(0).sum(axis=0)
            best = sorted(np.argsort(-gain, kind="stable")[:MOST_ALTS].tolist())
            keep = [0, *[b + 1 for b in best]]
            alleles, lk = [alleles[i] for i in keep], lk[:, keep]
            owner = np.array([keep.index(o) if o in keep else 0 for o in owner])
        if gvcf:
            rest = np.where(lk < lk.max(axis=1, keepdims=True), lk, np.nan)
            with np.errstate(all="ignore"):
                other = np.nanmedian(rest, axis=1)
            lk = np.column_stack((lk, np.where(np.isnan(other), lk.min(axis=1), other)))
            alleles = [*alleles, "<NON_REF>"]
        pairs = stats.genotypes(len(alleles))
        gl = [float(sum(lk[r, i] if i == j else stats.jacobian_sum(lk[r, i], lk[r, j]) - np.log10(2) for r in range(len(near)))) for i, j in pairs]
        result = stats.frequency_result([gl], alleles)
        qual = stats.phred(result["log10_none"])
        alts = [i for i in range(1, len(alleles)) if result["log10_absent"][i - 1] + 1e-10 < -confidence / 10 or alleles[i] == "<NON_REF>"]
        alts = [i for i in alts if alleles[i] != "*" or reach >= locus]
        real = [i for i in alts if alleles[i] not in ("*", "<NON_REF>")]
        if not real or qual < (0 if gvcf else confidence):
            continue
        keep = [0, *alts]
        lk, names = lk[:, keep], [alleles[i] for i in keep]
        place = {old: new for new, old in enumerate(keep)}
        gl = [g for g, (i, j) in zip(gl, pairs, strict=True) if i in place and j in place]
        pairs = stats.genotypes(len(names))
        top = max(gl)
        pl = [int(np.floor(-10 * (g - top) + 0.5)) for g in gl]
        spread = sum(g - top for g in gl)
        gt = list(pairs[int(np.argmax(gl))]) if spread < NO_CALL else [-1, -1]
        order = sorted(pl)
        # informative reads, the reference preferred within the gap
        picks = []
        for r in range(len(near)):
            ranked = np.argsort(-lk[r], kind="stable")
            pick = 0 if lk[r, ranked[0]] - lk[r, 0] < 0.2 else int(ranked[0])
            gap = lk[r, pick] - max(lk[r, k] for k in range(len(names)) if k != pick)
            picks.append(pick if abs(gap) > 0.2 else -1)
        ad = [picks.count(k) for k in range(len(names))]
        rows = [kept[i] for i in near]
        strand = [0, 0, 0, 0]
        base_q, map_q, ends = ([], []), ([], []), ([], [])
        for pick, (row, quals, start, cigar, _, skip) in zip(picks, rows, strict=True):
            if pick < 0:
                continue
            side = 1 if pick else 0
            strand[2 * side + (1 if row["flag"] & rd.REVERSE else 0)] += 1
            place = cg.read_index(cigar, start, locus)
            if place is not None and place[0] < len(quals):
                base_q[side].append(float(quals[place[0]]))
                ends[side].append(float(min(skip + place[0], len(row["seq"]) - 1 - skip - place[0])))
            map_q[side].append(float(row["mapq"]))
        lead, short = ev.trimmed_alleles(names)
        depth = sum(ad)
        ac = [gt.count(i) for i in range(1, len(names))]
        an = sum(g >= 0 for g in gt)
        name = f"{locus}_{short[0]}_{short[1]}"
        carriers = frozenset(np.flatnonzero(owner == (keep[1] if len(keep) > 1 else -1)).tolist())
        if len([n for n in names if n != "<NON_REF>"]) == 2:
            phase_of.append((name, carriers))
        mle = [result["mleac"][k][0] if isinstance(result["mleac"][k], list) else result["mleac"][k] for k in [i - 1 for i in alts]]
        het = (1, 0, 0) if gt == [0, 0] else (0, 0, 1) if gt[0] == gt[1] else (0, 1, 0)
        z = [stats.rank_sum_z(x[1], x[0]) for x in (base_q, map_q, ends)]
        mapqs = [r[0]["mapq"] for r in rows if r[0]["mapq"] != 255]
        calls.append({
            "region_id": int(frame["region_id"].iloc[0]), "tid": int(frame["tid"].iloc[0]), "start": locus + lead, "stop": locus + lead + len(short[0]) - 1, "alleles": short, "qual": float(qual),
            "ac": ac, "af": [a / an if an else 0.0 for a in ac], "an": an, "dp": len(rows) + sum(r["start"] <= stop and r["end"] >= locus for r in aside), "fs": _log10_fisher(strand), "sor": _odds(strand), "mq": float(np.sqrt(np.mean(np.square(mapqs)))) if mapqs else None,
            "qd": min(35.0, float(qual) / depth) if depth else None, "mleac": mle, "mleaf": [min(1.0, m / an) if an else 0.0 for m in mle], "baseq_ranksum": z[0], "mq_ranksum": z[1], "readpos_ranksum": z[2],
            "excess_het": stats.excess_het(*het) if an else None, "gt": gt, "ad": ad, "gq": min(99, order[1] - order[0]), "pl": pl, "sb": strand, "pid": None, "pgt": None, "ps": None, "__name": name,
        })
        for i in real:
            if len(alleles[i]) < len(ref):
                reach = max(reach, stop)
    if gvcf:
        # of the assembled haplotypes only those that carry a called variant were called
        groups = ev.phase_groups(phase_of, len(frozenset().union(*[x for _, x in phase_of])))
        for c in calls:
            if c["__name"] in groups:
                group, phase = groups[c["__name"]]
                c["pid"], c["pgt"], c["ps"] = group, phase, int(group.split("_")[0])
                if sorted(c["gt"]) == [0, 1]:
                    c["gt"] = [int(x) for x in phase.split("|")]
    for c in calls:
        del c["__name"]
    return calls


def windows(regions: DataFrame, reference: DataFrame, left: int = REFERENCE_PAD, right: int = REFERENCE_PAD) -> DataFrame:
    """(region_id, w_start, w_bases): each region's padded reference, from chunks by a join on bins."""
    spans = regions.select("region_id", "tid", F.greatest(F.lit(1), F.col("start") - left).alias("w_start"), (F.col("end") + right).alias("w_end"))
    chunks = reference.select(F.col("tid"), F.col("start").alias("c_start"), (F.col("start") + F.length("bases") - 1).alias("c_end"), "bases")
    met = overlap_join(spans, chunks, ["tid"], ("w_start", "w_end"), ("c_start", "c_end"), width=4096)
    begin = F.greatest(F.col("w_start"), F.col("c_start"))
    part = F.substring("bases", (begin - F.col("c_start") + 1).cast("int"), (F.least(F.col("w_end"), F.col("c_end")) - begin + 1).cast("int"))
    pieces = met.select("region_id", "w_start", F.struct(begin.alias("at"), part.alias("b")).alias("piece"))
    return pieces.groupBy("region_id", "w_start").agg(F.array_join(F.transform(F.array_sort(F.collect_list("piece")), lambda p: p["b"]), "").alias("w_bases"))


def selected(reads: DataFrame, depth: int, seed: int, recal: dict[str, DataFrame] | None, inspect: DataFrame | None) -> DataFrame:
    """Filtered, then sampled, then recalibrated reads: in that order, so that fewer bases are looked up."""
    used = rd.filtered(reads)
    if inspect is not None:
        used = rd.well_formed(inspect)(used).filter(rd.good_cigar(F.col("cigar")))
    used = rd.downsampled(used, depth, seed)
    return used if recal is None else rd.recalibrated(used, recal)


def haplotypes(reads: DataFrame, reference: DataFrame, depth: int = 50, seed: int = 0) -> DataFrame:
    """The assembled haplotypes of each active region in the schema of ``schemas.HAPLOTYPES``, with each graph as DOT, for inspection."""
    used, sums = prepared(reads, reference, depth=depth, seed=seed)
    regions = rd.active_regions(rd.locus_activity(sums)).filter("active")
    joined = rd.region_reads(regions, used).join(windows(regions, reference), "region_id")

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        window, start = frame["w_bases"].iloc[0], int(frame["w_start"].iloc[0])
        frame = frame.sort_values(["start", "qname", "flag", "read_id"])
        parts = [p for row in frame.to_dict("records") if (p := _prepared(row, start, start + len(window) - 1)) is not None]
        graphs: dict[int, str] = {}
        found = assembly.assemble(window, [(seq, qual) for seq, qual, _, _ in parts], graphs=graphs)
        rows = [(int(frame["region_id"].iloc[0]), i, h.is_ref, h.bases, [{"op": op, "len": n} for op, n in h.cigar], None if h.is_ref else h.score, h.k, start, graphs.get(h.k)) for i, h in enumerate(found)]
        return pd.DataFrame(rows, columns=[*"region_id hap_id is_ref bases cigar score kmer ref_start".split(), "graph"])

    return joined.groupBy("region_id").applyInPandas(run, HAPLOTYPES + ", graph string")


def near_intervals(reads: DataFrame, intervals: DataFrame, reach: int = INTERVAL_REACH) -> DataFrame:
    """The reads that can matter for what is called inside the intervals."""
    spans = intervals.select("tid", (F.col("start") - reach).alias("i_start"), (F.col("end") + reach).alias("i_end"))
    return overlap_join(reads, spans, ["tid"], ("start", "end"), ("i_start", "i_end"), how="left_semi")


def prepared(reads: DataFrame, reference: DataFrame, intervals: DataFrame | None = None, depth: int = 50, seed: int = 0, recal: dict[str, DataFrame] | None = None, inspect: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(reads that count, per-site sums of their evidence), both written once as each is used twice."""
    if intervals is not None:
        reads = near_intervals(reads, intervals)
    used = stage(selected(reads, depth, seed, recal, inspect), "reads")
    found = rd.evidence(used, reference)
    if intervals is not None:
        found = overlap_join(found, intervals.select("tid", F.col("start").alias("i_start"), F.col("end").alias("i_end")), ["tid"], ("pos", "pos"), ("i_start", "i_end"), how="left_semi")
    return used, stage(rd.locus_sums(found), "sums")


def call_sites(used: DataFrame, sums: DataFrame, reference: DataFrame, dbsnp: DataFrame | None = None, mode: str = "VCF", confidence: float | None = None, pcr_indel_model: str = "conservative", quality_floor: int = pairhmm.QUALITY_FLOOR) -> DataFrame:
    """Calls from what ``prepared`` returns."""
    gvcf = mode.upper() == "GVCF"
    limit = confidence if confidence is not None else (0.0 if gvcf else CONFIDENCE)
    regions = rd.active_regions(rd.locus_activity(sums)).filter("active")
    joined = rd.region_reads(regions, used).join(windows(regions, reference), "region_id")

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        columns = [c.split()[0] for c in CALLS.split(", ")]
        rows = call_region(frame, frame["w_bases"].iloc[0], int(frame["w_start"].iloc[0]), limit, gvcf, pcr_indel_model, quality_floor)
        return pd.DataFrame(rows, columns=columns)

    calls = joined.groupBy("region_id").applyInPandas(run, CALLS)
    return annotated(calls, dbsnp) if dbsnp is not None else calls


def call(reads: DataFrame, reference: DataFrame, intervals: DataFrame | None = None, dbsnp: DataFrame | None = None, mode: str = "VCF", depth: int = 50, confidence: float | None = None, pcr_indel_model: str = "conservative", seed: int = 0, recal: dict[str, DataFrame] | None = None, inspect: DataFrame | None = None, quality_floor: int = pairhmm.QUALITY_FLOOR) -> DataFrame:
    """Variant calls in the schema of ``schemas.CALLS`` (with ``ids`` if ``dbsnp`` is given).

    ``reads`` as in ``schemas.READS``; ``reference`` (tid, start, bases) in chunks; ``intervals`` (tid, start, end)
    restrict where regions are looked for; ``dbsnp`` (tid, start, id, ref, alts, filter); ``recal`` the steps of
    ``operators.recal.steps``; ``inspect`` contigs against which reads must be well-formed, with good CIGARs;
    base qualities under ``quality_floor`` count as the lowest.
    """
    used, sums = prepared(reads, reference, intervals, depth, seed, recal, inspect)
    return call_sites(used, sums, reference, dbsnp, mode, confidence, pcr_indel_model, quality_floor)


def _trimmed(df: DataFrame, start: str, ref: str, alt: str) -> DataFrame:
    """With (k_start, k_ref, k_alt): the pair without common last, then common first bases; one base stays of each."""
    least = lambda a, b: f"greatest(0, least(length({a}), length({b})) - 1)"
    df = df.withColumn("__n", F.expr(f"array_max(filter(sequence(0, {least(ref, alt)}), k -> right({ref}, k) = right({alt}, k)))"))
    df = df.withColumn("k_ref", F.expr(f"left({ref}, length({ref}) - __n)")).withColumn("k_alt", F.expr(f"left({alt}, length({alt}) - __n)"))
    df = df.withColumn("__n", F.expr(f"array_max(filter(sequence(0, {least('k_ref', 'k_alt')}), k -> left(k_ref, k) = left(k_alt, k)))"))
    return df.withColumn("k_start", F.expr(f"{start} + __n")).withColumn("k_ref", F.expr("substring(k_ref, __n + 1)")).withColumn("k_alt", F.expr("substring(k_alt, __n + 1)")).drop("__n")


def annotated(calls: DataFrame, dbsnp: DataFrame) -> DataFrame:
    """Calls with the sorted ids of passing known records that share an alternate, whatever bases pad the two."""
    plain = lambda x: (x != "*") & ~x.startswith("<")
    keys = ["tid", "k_start", "k_ref", "k_alt"]
    known = dbsnp.filter(F.col("filter").isin("PASS", ".")).select("tid", "start", "ref", F.explode("alts").alias("alt"), "id").filter(plain(F.col("alt")))
    known = _trimmed(known, "start", "ref", "alt").groupBy(*keys).agg(F.collect_set("id").alias("__ids"))
    # calls are made once: their rows are numbered, not joined with themselves
    numbered = calls.select(F.monotonically_increasing_id().alias("row"), "tid", F.struct(*calls.columns).alias("call"))
    each = numbered.select("*", F.col("call.start").alias("start"), F.col("call.alleles")[0].alias("ref"), F.explode_outer(F.filter(F.slice("call.alleles", 2, F.greatest(F.lit(0), F.size("call.alleles") - 1)), plain)).alias("alt"))
    met = _trimmed(each, "start", "ref", "alt").join(known, keys, "left")
    found = met.groupBy("row").agg(F.first("call").alias("call"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("__ids")))).alias("__ids"))
    return found.select("call.*", F.when(F.size("__ids") > 0, F.array_join("__ids", ";")).alias("ids"))


def vcf_lines(calls: DataFrame, contigs: DataFrame, gvcf: bool = False) -> DataFrame:
    """(tid, start, line): text records; FORMAT GT:AD:DP:GQ:PL, with SB and phase in GVCF mode."""
    num = lambda c, d=3: F.regexp_replace(F.regexp_replace(F.format_string(f"%.{d}f", c), r"(\.\d*?)0+$", "$1"), r"\.$", "")
    joined = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",")
    pair = lambda name, value: F.when(value.isNotNull(), F.concat(F.lit(name + "="), value))
    common = [pair("BaseQRankSum", num("baseq_ranksum")), pair("DP", F.col("dp").cast("string")), pair("ExcessHet", num("excess_het", 4)), pair("MLEAC", joined("mleac")), pair("MLEAF", joined("mleaf")), pair("MQRankSum", num("mq_ranksum")), pair("ReadPosRankSum", num("readpos_ranksum"))]
    only_vcf = [pair("AC", joined("ac")), pair("AF", joined("af")), pair("AN", F.col("an").cast("string")), pair("FS", num("fs")), pair("MQ", num("mq", 2)), pair("QD", num("qd", 2)), pair("SOR", num("sor"))]
    raw = F.concat_ws(",", F.floor(F.col("mq") * F.col("mq") * F.col("dp") + 0.5).cast("string"), F.col("dp").cast("string"))
    only_gvcf = [pair("RAW_MQandDP", F.when(F.col("mq").isNotNull(), raw))]
    info = F.array_join(F.array_sort(F.filter(F.array(*common, *(only_gvcf if gvcf else only_vcf)), lambda x: x.isNotNull())), ";")
    sep = F.when(F.col("pgt").isNotNull(), "|").otherwise("/")
    allele = lambda i: F.when(F.col("gt")[i] < 0, ".").otherwise(F.col("gt")[i].cast("string"))
    gt = F.concat(allele(0), sep, allele(1))
    fields = [gt, joined("ad"), F.aggregate("ad", F.lit(0), lambda a, x: a + x).cast("string"), F.col("gq").cast("string")]
    phased = F.col("pid").isNotNull() if gvcf else F.lit(False)
    names = F.when(phased, "GT:AD:DP:GQ:PGT:PID:PL:PS:SB").otherwise("GT:AD:DP:GQ:PL:SB" if gvcf else "GT:AD:DP:GQ:PL")
    plain = F.concat_ws(":", *fields, joined("pl"), *([joined("sb")] if gvcf else []))
    full = F.concat_ws(":", *fields, "pgt", "pid", joined("pl"), F.col("ps").cast("string"), joined("sb"))
    ids = F.coalesce("ids", F.lit(".")) if "ids" in calls.columns else F.lit(".")
    known = contigs.select(F.col("tid").alias("__t"), "name")
    line = F.concat_ws("\t", "name", F.col("start").cast("string"), ids, F.col("alleles")[0], F.array_join(F.slice("alleles", 2, F.size("alleles")), ","), num("qual", 2), F.lit("."), info, names, F.when(phased, full).otherwise(plain))
    return calls.join(known, F.col("tid") == F.col("__t")).select("tid", "start", line.alias("line"))


HEADER = """##fileformat=VCFv4.2
##ALT=<ID=NON_REF,Description="Any allele other than those called">
##FILTER=<ID=LowQual,Description="Low quality">
##FORMAT=<ID=AD,Number=R,Type=Integer,Description="Allelic depths">
##FORMAT=<ID=DP,Number=1,Type=Integer,Description="Read depth">
##FORMAT=<ID=GQ,Number=1,Type=Integer,Description="Genotype quality">
##FORMAT=<ID=GT,Number=1,Type=String,Description="Genotype">
##FORMAT=<ID=MIN_DP,Number=1,Type=Integer,Description="Least depth in a block">
##FORMAT=<ID=PGT,Number=1,Type=String,Description="Phased genotype">
##FORMAT=<ID=PID,Number=1,Type=String,Description="Phase group">
##FORMAT=<ID=PL,Number=G,Type=Integer,Description="Phred-scaled genotype likelihoods">
##FORMAT=<ID=PS,Number=1,Type=Integer,Description="Phase set">
##FORMAT=<ID=SB,Number=4,Type=Integer,Description="Reads by allele and strand">
##INFO=<ID=AC,Number=A,Type=Integer,Description="Alternate allele counts">
##INFO=<ID=AF,Number=A,Type=Float,Description="Alternate allele frequencies">
##INFO=<ID=AN,Number=1,Type=Integer,Description="Called alleles">
##INFO=<ID=BaseQRankSum,Number=1,Type=Float,Description="Rank sum z of base qualities, alternate against reference">
##INFO=<ID=DP,Number=1,Type=Integer,Description="Depth">
##INFO=<ID=END,Number=1,Type=Integer,Description="End of a block">
##INFO=<ID=ExcessHet,Number=1,Type=Float,Description="Phred-scaled p-value of excess heterozygosity">
##INFO=<ID=FS,Number=1,Type=Float,Description="Phred-scaled Fisher test of strands">
##INFO=<ID=MLEAC,Number=A,Type=Integer,Description="Most likely alternate counts">
##INFO=<ID=MLEAF,Number=A,Type=Float,Description="Most likely alternate frequencies">
##INFO=<ID=MQ,Number=1,Type=Float,Description="RMS mapping quality">
##INFO=<ID=MQRankSum,Number=1,Type=Float,Description="Rank sum z of mapping qualities">
##INFO=<ID=QD,Number=1,Type=Float,Description="Quality by depth">
##INFO=<ID=RAW_MQandDP,Number=2,Type=Integer,Description="Sum of squared mapping qualities and depth">
##INFO=<ID=ReadPosRankSum,Number=1,Type=Float,Description="Rank sum z of distances to read ends">
##INFO=<ID=SOR,Number=1,Type=Float,Description="Symmetric odds ratio of strands">"""


def header_lines(contigs: DataFrame, sample: str, bands: tuple[int, ...] = ()) -> list[str]:
    blocks = [f"##GVCFBlock{a}-{b}=minGQ={a}(inclusive),maxGQ={b}(exclusive)" for a, b in zip((0, *bands), bands, strict=False)]
    names = [f"##contig=<ID={r['name']},length={r['length']}>" for r in contigs.orderBy("tid").collect()]
    return [*HEADER.split("\n"), *blocks, *names, "#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\t" + sample]


def write_lines(spark, lines: DataFrame, header: list[str], path: str, style: dict | None = None) -> None:
    """Header and lines (tid, start, line) in genome order as a folder of text parts, whose reading by name gives the file.

    Lines are sorted by range partitioning, so no task holds the whole output.  ``.gz`` paths are compressed in blocks
    that tools can seek in where ``style`` asks for one ``whole`` file (with ``level``, ``index`` and ``md5`` as in ``sources.bgzf``).
    """
    head = spark.createDataFrame([(-1, i, x) for i, x in enumerate(header)], "tid int, start int, line string")
    body = head.unionByName(lines.select("tid", F.col("start").cast("int").alias("start"), "line"))
    ordered = body.orderBy("tid", "start", "line")
    style = dict(style or {})
    if not style.pop("whole", False):
        ordered.select("line").write.mode("overwrite").option("compression", "gzip" if path.endswith(".gz") else "none").text(path)
        return
    from ..sources import bgzf

    bgzf.write_whole(ordered.select("line"), path, **style)


def write_vcf(calls: DataFrame, contigs: DataFrame, path: str, sample: str = "sample", gvcf: bool = False, bands: tuple[int, ...] = (), style: dict | None = None) -> None:
    """Calls as a VCF in genome order."""
    write_lines(calls.sparkSession, vcf_lines(calls, contigs, gvcf), header_lines(contigs, sample, bands), path, style)
