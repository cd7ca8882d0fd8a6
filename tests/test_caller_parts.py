"""The caller's parts against plain versions: pile-up, bins, index, trimming, realignment, graphs, whole files."""

import gzip
import random
import struct

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from helixframe.functions import special
from helixframe.kernels import assembly, cigar as cg, events as ev, seqgraph
from helixframe.operators import binned, pileup
from helixframe.operators import reads as rd
from helixframe.plans import caller, gvcf
from helixframe.schemas import READS
from helixframe.sources import bai, bam, bgzf

from . import simulate
from .test_relational import bam_record, block


def plain_pileup(reads, ref):
    """Evidence by walking each read."""
    out = []
    for _, _, flag, _, start, _, _, cigar, _, mstart, isize, seq, qual, _ in reads:
        reverse, adaptor = flag & 0x10, None
        if isize and flag & 1 and not flag & 12 and bool(reverse) != bool(flag & 0x20) and abs(isize) <= 100:
            adaptor = mstart - 1 if reverse else start + abs(isize)
        r, q = start, 0
        for k, (op, n) in enumerate(cigar):
            prev, nxt = (cigar[k - 1][0] if k else ""), (cigar[k + 1][0] if k + 1 < len(cigar) else "")
            if op in "M=XD":
                for i in range(n):
                    pos = r + i
                    if adaptor is not None and (pos <= adaptor if reverse else pos >= adaptor):
                        continue
                    if not 1 <= pos <= len(ref):
                        continue
                    if op == "D":
                        out.append((pos, 0, 30, None))
                        continue
                    first, last = i == 0, i == n - 1
                    edge = (first and prev in "SID" and prev) or (last and nxt in "ID" and nxt) or (last and n > 1 and nxt == "S")
                    clip = None
                    if qual[q + i] > 10:
                        if first and prev == "S":
                            at = q - cigar[k - 1][1]
                            clip = sum(x > 28 for x in qual[at:q])
                        elif last and n > 1 and nxt == "S":
                            clip = sum(x > 28 for x in qual[q + n : q + n + cigar[k + 1][1]])
                    out.append((pos, 0 if seq[q + i] != ref[pos - 1] or edge else 1, qual[q + i], clip))
            r += n if op in "MDN=X" else 0
            q += n if op in "MIS=X" else 0
    return sorted(out, key=str)


def random_reads(ref, n, seed):
    r = random.Random(seed)
    out = []
    for i in range(n):
        cigar = [(r.choice("MM=X"), r.randint(1, 30))]
        for _ in range(r.randint(0, 4)):
            op = r.choice([x for x in "MIDNX" if x != cigar[-1][0]])
            cigar.append((op, r.randint(1, 8)))
        if cigar[-1][0] not in "MX=":
            cigar.append(("M", r.randint(1, 20)))
        if r.random() < 0.5:
            cigar.insert(0, ("S", r.randint(1, 12)))
        if r.random() < 0.5:
            cigar.append(("S", r.randint(1, 12)))
        size = cg.read_length(cigar)
        flag = r.choice([0, 0x10, 0x1 | 0x20, 0x1 | 0x10])
        start = r.randint(1, len(ref) - 60)
        out.append((i, f"q{i}", flag, 0, start, start + cg.ref_length(cigar) - 1, 60, cigar, 0, r.randint(1, len(ref)), r.choice([0, 40, -60, 90, 300]), "".join(r.choice("ACGTN") for _ in range(size)), [r.randint(2, 40) for _ in range(size)], "g"))
    return out


@pytest.mark.parametrize("width", [16, 1024])
def test_pileup(spark, width):
    ref = simulate.genome(400, 3)
    reads = random_reads(ref, 120, 4)
    df = spark.createDataFrame(reads, READS)
    reference = spark.createDataFrame(simulate.chunks(ref, 37), "tid int, start int, bases string")
    boundary = rd.adaptor_boundary(F.col("flag"), F.col("start"), F.col("mstart"), F.col("isize"))
    found = pileup.evidence(df, reference, boundary, width)
    got = sorted(((r["pos"], r["cls"], r["qual"], r["hq_clips"]) for r in found.collect()), key=str)
    assert got == plain_pileup(reads, ref)
    plan = pileup.site_sums(found, 11, 7)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") <= 3 and plan.count("Join") == 1  # reads, chunks, no exchange of bases
    sums = {r["pos"]: r for r in rd.locus_sums(found).collect()}
    for pos, r in sums.items():
        assert r["ref"] + r["other"] == sum(x[0] == pos and x[2] >= 7 for x in got) and r["depth"] == sum(x[0] == pos and x[2] >= 11 for x in got)


@pytest.mark.parametrize("width", [3, 10, 1 << 20])
def test_bins_equal_windows(spark, width):
    r = random.Random(width)
    rows = [(k, p, r.randint(0, 2), r.randint(0, 500)) for k in range(3) for p in sorted(r.sample(range(120), 70))]
    df = spark.createDataFrame(rows, "k int, p int, s int, v int").repartition(5)
    w = Window.partitionBy("k").orderBy("p")
    for inclusive in (False, True):
        want = df.withColumn("m", F.max("v").over(w.rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)))
        assert sorted(binned.running_max(df, ["k"], ["p"], F.col("v"), "m", width, inclusive).collect()) == sorted(want.collect())
    found = binned.runs(df, ["k"], ["p"], ["s"], lambda x: (x["s"] == F.col("s")) & (x["p"] == F.col("p") - 1), width=width)
    got = {(x["k"], x["p"]): x["island"]["p"] for x in found.collect()}
    for k in range(3):
        begin, before = None, None
        for _, p, s, _ in sorted(x for x in rows if x[0] == k):
            if before is None or before != (p - 1, s):
                begin = p
            assert got[k, p] == begin
            before = (p, s)


def test_indexed_region_reads_its_blocks_only(spark, tmp_path):
    head = b"BAM\1" + struct.pack("<i", 0) + struct.pack("<i", 2) + struct.pack("<i", 5) + b"chr1\0" + struct.pack("<i", 10**6) + struct.pack("<i", 5) + b"chr2\0" + struct.pack("<i", 10**6)
    stream = b"".join(bam_record(f"read{t}_{i}", t, 100 * i, 20 + 2 * (i % 40)) for t in range(2) for i in range(5000))
    path = tmp_path / "a.bam"
    path.write_bytes(block(head) + b"".join(block(stream[k : k + 7000]) for k in range(0, len(stream), 7000)) + block(b""))
    bam.make_index(str(path))
    spark.dataSource.register(bam.BamSource)
    spans = {("chr1", 250_000, 252_000), ("chr2", 90, 130), ("chr2", 100, 105)}
    df = spark.read.format("bam").option("regions", ";".join(f"{n}:{a}-{b}" for n, a, b in spans)).load(str(path))
    got = sorted(r["qname"] for r in df.collect())
    want = sorted(f"read{t}_{i}" for t in range(2) for i in range(5000) if any(int(n[3]) - 1 == t and 100 * i + 1 <= b and 100 * i + 20 + 2 * (i % 40) >= a for n, a, b in spans))
    assert got == want and len(set(got)) == len(got)
    reader = bam.BamReader([str(path)], 64 << 20, [("chr1", 250_000, 252_000)])
    parts = reader.partitions()
    assert sum((p.end - p.start) for p in parts) < path.stat().st_size / 20
    with pytest.raises(FileNotFoundError):
        bam.BamReader([str(tmp_path / "none.bam")], 1).partitions()
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    pushed = spark.read.format("bam").option("pushdown", "true").load(str(path)).filter("tid = 1 and start <= 400 and start >= 200")
    assert sorted(r["qname"] for r in pushed.collect()) == ["read1_2", "read1_3"]
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "false")


def test_index_search():
    index = bai.parse(bai.made(1, [(0, 100 * i, 100 * i + 150, i << 16, (i << 16) + 9) for i in range(5000)]))
    for a, b in ((0, 1), (99_000, 99_500), (499_000, 600_000)):
        chunks = bai.search(index, [(0, a, b)])
        held = {i for i in range(5000) if any(x <= i << 16 < y for x, y in chunks)}
        assert held >= {i for i in range(5000) if 100 * i < b and 100 * i + 150 > a}
    assert bai.search(index, [(3, 0, 10)]) == []


def test_whole_files(spark, tmp_path):
    lines = [(i, f"c{i // 2000}\t{1 + 10 * (i % 2000)}\t.\tACGT\tA\t.\t.\tDP={i}") for i in range(6000)]
    df = spark.createDataFrame([(-1, "##head"), *lines], "i int, line string").repartition(3).orderBy("i").select("line")
    path = tmp_path / "a.vcf.gz"
    bgzf.write_whole(df, str(path), level=3, md5=True)
    text = gzip.decompress(path.read_bytes()).decode().split("\n")
    assert text == ["##head", *[x for _, x in lines], ""]
    raw = gzip.decompress((tmp_path / "a.vcf.gz.tbi").read_bytes())
    assert raw[:4] == b"TBI\1" and struct.unpack("<i", raw[4:8])[0] == 3 and b"c0\0c1\0c2\0" in raw
    import hashlib

    assert (tmp_path / "a.vcf.gz.md5").read_text().split()[0] == hashlib.md5(path.read_bytes()).hexdigest()
    bgzf.write_whole(df, str(tmp_path / "a.vcf"))
    assert (tmp_path / "a.vcf").read_text().split("\n") == text


def test_sequence_graph_keeps_paths():
    r = random.Random(1)
    for _ in range(150):
        s = seqgraph.SequenceGraph()
        n = r.randint(4, 10)
        vs = [s.vertex("".join(r.choice("AC") for _ in range(r.randint(1, 4)))) for _ in range(n)]
        for i in range(n - 1):
            for j in r.sample(range(i + 1, n), min(n - i - 1, r.randint(1, 3))):
                s.edge(vs[i], vs[j], r.randint(1, 9))
        s.source, s.sink = vs[0], vs[-1]
        while loose := [v for v in s.bases if (v != s.source and not s.into[v]) or (v != s.sink and not s.out[v])]:
            s.drop(loose[0])
        before, size = {b for _, b in seqgraph.best_paths(s, 10**5, 10**5)}, s.sizes()[0]
        seqgraph.simplified(s)
        assert {b for _, b in seqgraph.best_paths(s, 10**5, 10**5)} == before and s.sizes()[0] <= 2 * size
    assert seqgraph.dot(s).startswith("digraph")


def test_dangling_head_is_joined():
    r = random.Random(5)
    ref = "".join(r.choice("ACGT") for _ in range(200))
    alt = ref[:60] + ("A" if ref[60] != "A" else "C") + ref[61:]
    reads = [(alt[54:154], [30] * 100)] * 6 + [(ref[20:150], [30] * 130)] * 6  # no read holds a whole k-mer before the variant
    assert alt in [h.bases for h in assembly.assemble(ref, reads, kmers=(25,))]


def test_realigned_reads():
    r = random.Random(6)
    window = "".join(r.choice("ACGT") for _ in range(300))
    alt = window[:100] + window[106:200] + "GATTACA" + window[200:]
    hap = assembly.Haplotype(alt, [("M", 100), ("D", 6), ("M", 94), ("I", 7), ("M", 100)], 0.0, 25)
    for at in range(40, 120, 7):
        seq = alt[at : at + 120]
        start, cigar = caller.realigned(seq, 0, hap, window, 1001)
        assert start == 1001 + (at if at < 100 else at + 6) and cg.read_length(cigar) == 120
        aligned, places = cg.against_reference(seq, cigar)
        assert all(x in ("-", window[start - 1001 + i]) for i, x in enumerate(aligned))
        assert len(places) == cg.ref_length(cigar)


def test_trimmed_haplotypes_and_span():
    ref = simulate.genome(300, 8)
    alt = ref[:150] + ref[153:]
    haps = [assembly.Haplotype(ref, [("M", 300)], 0.0, 0, True), assembly.Haplotype(alt, [("M", 150), ("D", 3), ("M", 147)], 0.0, 25), assembly.Haplotype("T" + ref[1:], [("M", 300)], 0.0, 25)]
    events = ev.haplotype_events(alt, haps[1].cigar, ref, 1)
    a, b = caller.variant_span(events, 1, 300, ref, 1)
    assert a == 150 - caller.INDEL_PAD and b >= 153 + caller.INDEL_PAD
    cut = caller.trimmed_haplotypes(haps, a - 1, b - 1)
    assert [h.bases for h in cut] == [ref[a - 1 : b], ref[a - 1 : 150] + ref[153:b]] and cut[0].is_ref
    assert caller.variant_span(events, 200, 300, ref, 1) is None


def planted(seed, variants, size=1200, depth=40):
    ref = simulate.genome(size, seed)
    return ref, simulate.reads(ref, variants(ref), depth=depth, seed=seed + 1)


def test_opposite_phase_and_ranks(spark):
    def substitution(ref, at):
        return (at, ref[at - 1], "A" if ref[at - 1] != "A" else "C", 1)

    ref = simulate.genome(900, 12)
    first, second = substitution(ref, 430), substitution(ref, 460)
    one, two = simulate.reads(ref, [first], depth=50, seed=1), simulate.reads(ref, [second], depth=50, seed=2)
    # one haplotype carries the first variant and the other one the second
    mixed = [x for x in one if x[0] % 2 == 0] + [(x[0] + 10**5, f"z{x[1]}", *x[2:]) for x in two if x[0] % 2]
    both = []
    for x in mixed:
        both.append(x)
    frame = spark.createDataFrame(both, READS)
    reference = spark.createDataFrame(simulate.chunks(ref), "tid int, start int, bases string")
    calls = {c["start"]: c for c in caller.call(frame, reference, mode="GVCF").collect() if any(a not in ("<NON_REF>",) for a in c["alleles"][1:])}
    assert {430, 460} <= set(calls)
    assert calls[430]["pgt"] is None or {calls[430]["pgt"], calls[460]["pgt"]} == {"0|1", "1|0"} or calls[430]["pid"] != calls[460]["pid"]


def test_annotations_behind_an_insertion(spark):
    # the bases at a substitution behind an insertion are read through the alignment, not by a fixed offset
    ref = simulate.genome(900, 21)
    truth = [(400, ref[399], ref[399] + "GATTACAGA", 2), (440, ref[439], "A" if ref[439] != "A" else "C", 1)]
    reads = simulate.reads(ref, truth, depth=50, seed=9)
    low = []
    for x in reads:  # the substituted base has quality 12 in every read that holds it
        cigar, seq, qual = [tuple(c) for c in x[7]], x[11], list(x[12])
        place = cg.read_index(cigar, x[4], 440)
        if place is not None and place[1] == "M" and seq[place[0]] == truth[1][2]:
            qual[place[0]] = 20
        low.append((*x[:12], qual, x[13]))
    calls = {c["start"]: c for c in caller.call(spark.createDataFrame(low, READS), spark.createDataFrame(simulate.chunks(ref), "tid int, start int, bases string")).collect()}
    assert 440 in calls and calls[440]["baseq_ranksum"] < -2


def test_gvcf_holds_each_position_once(spark, tmp_path):
    ref = simulate.genome(1500, 31)
    truth = simulate.plant(ref, 8)
    reads = [x for x in simulate.reads(ref, truth) if not (x[5] >= 900 and x[4] <= 1000)]  # a stretch without reads
    contigs = spark.createDataFrame([(0, "c1", 1500)], "tid int, name string, length long")
    reference = spark.createDataFrame(simulate.chunks(ref), "tid int, start int, bases string")
    gvcf.write(spark, spark.createDataFrame(reads, READS), reference, contigs, str(tmp_path / "out"))
    body = [r["value"].split("\t") for r in spark.read.text(str(tmp_path / "out")).collect() if not r["value"].startswith("#")]
    held = [0] * 1501
    for x in body:
        end = int(x[7].removeprefix("END=")) if x[7].startswith("END=") else int(x[1]) + len(x[3]) - 1
        if x[7].startswith("END="):
            assert x[3] == ref[int(x[1]) - 1]
        for p in range(int(x[1]), end + 1):
            held[p] += 1
    assert held[1:] == [1] * 1500
    assert any(int(x[9].split(":")[1]) == 0 and int(x[1]) <= 950 <= int(x[7].removeprefix("END=")) for x in body if x[7].startswith("END="))
    assert sum(not x[7].startswith("END=") for x in body) >= 1


def test_passing_split(spark):
    rows = [(1, 0, 60, 0, -1, "A" * 20), (2, 0, 60, 0, -1, "A" * 9), (3, 0, 10, 0, -1, "A" * 20), (4, 1, 60, 0, 1, "A" * 20), (5, 1 | 8, 60, 0, 1, "A" * 20), (6, 1, 60, 0, 0, "A" * 20)]
    good, rest = rd.split_by_passing(spark.createDataFrame(rows, "read_id int, flag int, mapq int, tid int, mtid int, seq string"))
    assert sorted(r["read_id"] for r in good.collect()) == [1, 5, 6] and sorted(r["read_id"] for r in rest.collect()) == [2, 3, 4]


def test_special_functions(spark):
    import math
    from statistics import NormalDist

    x = [0.1, 0.5, 1.0, 2.5, 7.0, 40.0]
    df = spark.createDataFrame([(v,) for v in x], "x double")
    for (v,), row in zip([(v,) for v in x], df.select("x", special.digamma(F.col("x")).alias("d"), special.erf(F.col("x")).alias("e"), special.erf_inverse(F.col("x") / 41).alias("i")).collect(), strict=True):
        h = 1e-5
        assert row["d"] == pytest.approx((math.lgamma(v + h) - math.lgamma(v - h)) / (2 * h), abs=1e-5)
        assert row["e"] == pytest.approx(math.erf(v), abs=1e-13)
        assert row["i"] == pytest.approx(NormalDist().inv_cdf((v / 41 + 1) / 2) / math.sqrt(2), abs=1e-9)
    logs = spark.range(0, 31).select("id", special.binomial_log_pmf(F.col("id"), F.lit(30), F.lit(0.3)).alias("b"), special.hypergeometric_log_pmf(F.col("id"), F.lit(40), F.lit(30), F.lit(100)).alias("h")).collect()
    for r in logs:
        k = r["id"]
        assert r["b"] == pytest.approx(math.log(math.comb(30, k)) + k * math.log(0.3) + (30 - k) * math.log(0.7), abs=1e-9)
        assert r["h"] == pytest.approx(math.log(math.comb(40, k) * math.comb(60, 30 - k) / math.comb(100, 30)), abs=1e-8)
