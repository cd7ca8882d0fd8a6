"""Kernels against the numbers that their formulas give, and against plain versions."""

import itertools
import math
import random

import numpy as np
import pytest

from helixframe.kernels import align, assembly, cigar as cg, events as ev, pairhmm, regioncut, stats


@pytest.mark.parametrize(("text", "ok"), [("10M", True), ("15M", True), ("10S", False), ("1D10M", False), ("5S2D5M", False), ("10M1D", False), ("5M1D5S", False), ("3S3M3D3I1S", False), ("3S3M3I3D1S", False), ("5M5N5S", False), ("5S5S", False)])
def test_good_cigar(text, ok):
    assert cg.good(cg.parse(text)) is ok


@pytest.mark.parametrize(("parts", "want", "edges"), [("2M3I4D5M", "2M4D3I5M", (0, 0)), ("3D10M2D", "10M", (3, 2)), ("2S3D10M", "2S10M", (3, 0)), ("5M5M", "10M", (0, 0)), ("1H2S4M2I3M", "1H2S4M2I3M", (0, 0))])
def test_builder(parts, want, edges):
    out, lead, trail = cg.built(cg.parse(parts))
    assert (cg.spelled(out), lead, trail) == (want, *edges)


def test_builder_refuses_inner_clips():
    with pytest.raises(ValueError):
        cg.built(cg.parse("3M2S3M"))


def test_clip_and_shift():
    assert cg.spelled(cg.clipped(cg.parse("10M"), 0, 3, "S")) == "3S7M"
    assert cg.spelled(cg.clipped(cg.parse("10M"), 7, 10, "H")) == "7M3H"
    assert cg.spelled(cg.clipped(cg.parse("3M2D7M"), 0, 3, "H")) == "3H7M"
    assert cg.start_shift(cg.parse("3M2D7M"), 3) == 5
    assert cg.start_shift(cg.parse("2S8M"), 2) == 0
    assert cg.start_shift(cg.parse("2I8M"), 3) == 1


def test_compose():
    assert cg.spelled(cg.composed(cg.parse("10M"), cg.parse("4M2D6M"))) == "4M2D6M"
    assert cg.spelled(cg.composed(cg.parse("4M2I4M"), cg.parse("8M"))) == "4M2I4M"
    assert cg.spelled(cg.composed(cg.parse("8M"), cg.parse("3M2I3M"))) == "3M2I3M"
    assert cg.spelled(cg.composed(cg.parse("3M2D3M"), cg.parse("3M2I3M"))) == "6M"


def test_left_align():
    ref = "ACGTTTTTGCA"
    assert cg.spelled(cg.left_aligned(ref, "ACGTTTTGCA", cg.parse("7M1D3M"))) == "3M1D7M"
    assert cg.spelled(cg.left_aligned(ref, "ACGTTTTTTGCA", cg.parse("8M1I3M"))) == "3M1I8M"


def test_read_index_and_bases():
    c = cg.parse("3M2D4M")
    assert cg.read_index(c, 10, 12) == (2, "M") and cg.read_index(c, 10, 13) == (3, "D") and cg.read_index(c, 10, 15) == (3, "M")
    assert cg.read_index(c, 10, 19) is None
    assert cg.bases_covering("ACGTACG", c, 2, 5) == "GT" and cg.bases_covering("ACGTACG", c, 2, 4) is None
    assert cg.against_reference("ACGTACG", c) == ("ACG--TACG", [0, 1, 2, -1, -1, 3, 4, 5, 6])


def plain_alignment(ref, alt, s):
    """Best global affine score by three tables."""
    n, m, low = len(ref), len(alt), -(10**9)
    h = [[low] * (m + 1) for _ in range(n + 1)]
    d = [[low] * (m + 1) for _ in range(n + 1)]
    e = [[low] * (m + 1) for _ in range(n + 1)]
    h[0][0] = 0
    for i, j in itertools.product(range(n + 1), range(m + 1)):
        if i:
            d[i][j] = max(h[i - 1][j] + s.gap_open, d[i - 1][j] + s.gap_extend)
        if j:
            e[i][j] = max(h[i][j - 1] + s.gap_open, e[i][j - 1] + s.gap_extend)
        if i and j:
            h[i][j] = h[i - 1][j - 1] + (s.match if ref[i - 1] == alt[j - 1] else s.mismatch)
        h[i][j] = max(h[i][j], d[i][j], e[i][j])
    return h[n][m]


def score_of(ref, alt, cigar, s):
    r = q = total = 0
    for op, n in cigar:
        if op == "M":
            total += sum(s.match if ref[r + k] == alt[q + k] else s.mismatch for k in range(n))
            r, q = r + n, q + n
        else:
            total += s.gap_open + s.gap_extend * (n - 1)
            r, q = (r + n, q) if op == "D" else (r, q + n)
    assert (r, q) == (len(ref), len(alt))
    return total


def test_alignment_is_optimal():
    r = random.Random(1)
    for _ in range(60):
        ref = "".join(r.choice("ACGT") for _ in range(r.randint(1, 25)))
        alt = list(ref)
        for _ in range(r.randint(0, 4)):
            k = r.randrange(len(alt) + 1)
            alt[k : k + r.randint(0, 3)] = r.choice(["", "A", "CG", "T"])
        alt = "".join(alt) or "A"
        _, c = align.smith_waterman(ref, alt, align.HAPLOTYPE, "indel")
        assert score_of(ref, alt, c, align.HAPLOTYPE) == plain_alignment(ref, alt, align.HAPLOTYPE), (ref, alt, c)


def plain_hmm(read, quals, hap):
    n, m = len(read), len(hap)
    go, gc = 10**-4.5, 10**-1.0
    M, X, Y = (np.zeros((n + 1, m + 1)) for _ in range(3))
    Y[0] = 1 / m
    for i, j in itertools.product(range(1, n + 1), range(0, m + 1)):
        e = 10 ** (-quals[i - 1] / 10)
        if j:
            p = 1 - e if read[i - 1] == hap[j - 1] or "N" in (read[i - 1], hap[j - 1]) else e / 3
            M[i, j] = p * (M[i - 1, j - 1] * (1 - 2 * go) + (X[i - 1, j - 1] + Y[i - 1, j - 1]) * (1 - gc))
            X[i, j] = M[i - 1, j] * go + X[i - 1, j] * gc
            Y[i, j] = M[i, j - 1] * go + Y[i, j - 1] * gc
    return math.log10((M[n, 1:] + X[n, 1:]).sum())


def test_pair_hmm():
    r = random.Random(2)
    for _ in range(12):
        hap = "".join(r.choice("ACGTN") for _ in range(r.randint(150, 200)))
        at = r.randrange(0, 40)
        read = hap[at : at + r.randint(20, 60)].replace("N", "A")
        other = read[:10] + r.choice("ACGT") + read[12:]
        quals = np.array([r.randint(6, 40) for _ in range(len(other))])
        haps = [hap, hap[:80] + hap[83:], hap[: at + 60]]
        got = pairhmm.likelihoods(other, quals, haps)
        for g, h in zip(got, haps, strict=True):
            assert g == pytest.approx(plain_hmm(other, quals, h), abs=1e-9)


def test_gap_penalties():
    assert pairhmm.gap_penalties("ACGTACTG", "none").tolist() == [45] * 8
    assert [pairhmm.gap_penalties("C" + "A" * n + "G", "hostile")[1] for n in range(1, 12)] == [40, 39, 38, 37, 36, 34, 32, 28, 23, 17, 10]
    assert pairhmm.gap_penalties("ACGTACTG").tolist() == [40] * 8
    assert pairhmm.repeat_length("ACACACACG", 3) == 4


def test_region_cut():
    assert regioncut.cut(list(range(10, 20)), [0.1] * 10) == [(10, 19, True)]
    assert regioncut.cut([1, 2, 3, 7, 8], [0.1, 0.1, 0, 0.1, 0.1]) == [(1, 2, True), (3, 3, False), (7, 8, True)]
    p = [0.5] * 400
    p[120] = 0.1
    assert regioncut.cut(list(range(400)), p)[0] == (0, 120, True)
    found = regioncut.cut(list(range(1000)), [0.5] * 1000)
    assert [b - a + 1 for a, b, _ in found] == [300, 300, 300, 100]


def test_rank_sum_exact_and_normal():
    # exact branch by full enumeration
    a, b = [1.0, 5.0, 2.0], [2.0, 3.0, 7.0, 7.0]
    values = sorted(a + b)
    rank = {v: np.mean([i + 1 for i, x in enumerate(values) if x == v]) for v in values}
    ranks = [rank[v] for v in a + b]
    seen = sum(ranks[:3])
    sums = [sum(c) for c in itertools.combinations(ranks, 3)]
    p = (sum(s < seen for s in sums) + sum(s == seen for s in sums) / 2) / len(sums)
    from statistics import NormalDist

    assert stats.rank_sum_z(a, b) == pytest.approx(NormalDist().inv_cdf(p))
    assert stats.rank_sum_z([], b) is None
    assert stats.rank_sum_z([1.0] * 12, [1.0] * 12) is None
    assert stats.rank_sum_z(list(range(12)), list(range(6, 18))) < 0


@pytest.mark.parametrize(("pls", "want"), [(["AA", "BB"], [2, 0]), (["AA", "AB"], [1, 0]), (["AB", "AB"], [2, 0]), (["AA", "AA", "BB"], [2, 0]), (["AA", "AB", "AB"], [2, 0]), (["AA", "AB", "AC"], [1, 1])])
def test_allele_frequencies(pls, want):
    order = [tuple("ABC"[x] for x in g) for g in stats.genotypes(3)]
    gls = [[0.0 if "".join(sorted(g)) == p else -20.0 for g in order] for p in pls]
    counts, _ = stats.allele_frequencies(gls, [1.0, 1.0, 1.0])
    assert [math.floor(c + 0.5) for c in counts] == want


def test_excess_het_and_indel_pls():
    assert stats.excess_het(100, 0, 0) == 0.0
    assert stats.excess_het(0, 50, 0) > stats.excess_het(20, 10, 20)
    assert stats.indel_pls(0) == [0, 0, 0] and stats.indel_pls(40) == stats.indel_pls(400) and stats.indel_pls(10)[0] == 0


def test_events_and_alleles():
    ref = "ACGTACGTAC"
    assert ev.haplotype_events("ACGAACGTAC", cg.parse("10M"), ref, 100) == [(103, 103, "T", "A")]
    assert ev.haplotype_events("ACGTACAC", cg.parse("6M2D2M"), ref, 100) == [(105, 107, "CGT", "C")]
    assert ev.haplotype_events("ACGTACGGGTAC", cg.parse("6M2I4M"), ref, 100) == [(105, 105, "C", "CGG")]
    events = [(10, 12, "ACG", "A"), (12, 12, "G", "T")]
    assert ev.merged_alleles(events, 12) == ["G", "T", "*"]
    assert ev.merged_alleles([(10, 10, "A", "T"), (10, 12, "ACG", "A")], 10) == ["ACG", "TCG", "A"]
    assert ev.overlapping([(10, 12, "ACG", "A"), (12, 12, "G", "GT")], 12) == [(12, 12, "G", "GT")]
    assert ev.trimmed_alleles(["ACG", "TCG"]) == (0, ["A", "T"]) and ev.trimmed_alleles(["CCA", "CA", "*"]) == (0, ["CC", "C", "*"])
    assert ev.repeat_unit("ATATAT") == "AT" and ev.repetitions("AT", "ATATG") == 2
    assert ev.phase_groups([("a", frozenset({1})), ("b", frozenset({1})), ("c", frozenset({0}))], 2) == {"a": ("a", "0|1"), "b": ("a", "0|1"), "c": ("a", "1|0")}


def test_assembly_finds_planted_haplotype():
    r = random.Random(3)
    ref = "".join(r.choice("ACGT") for _ in range(300))
    alt = ref[:150] + "GATTACA" + ref[150:220] + ref[226:]
    reads = []
    for h in (ref, alt):
        for _ in range(40):
            k = r.randrange(0, len(h) - 100)
            reads.append((h[k : k + 100], [30] * 100))
    found = assembly.assemble(ref, reads)
    assert found[0].is_ref and found[0].bases == ref and alt in [h.bases for h in found]
    assert assembly.thread("AC", [], 10) is None and assembly.thread("ACGTACGTACGTACGTACGT", [], 10) is None
