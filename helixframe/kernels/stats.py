"""Exact statistics and small iterations that columns can't express."""

from __future__ import annotations

import math
from statistics import NormalDist

import numpy as np

LN10 = math.log(10.0)


def log10_sum(values) -> float:
    values = [v for v in values if v > -math.inf]
    if not values:
        return -math.inf
    top = max(values)
    return top + math.log10(sum(10 ** (v - top) for v in values))


def jacobian_sum(a: float, b: float) -> float:
    d = abs(a - b)
    return max(a, b) + (math.log10(1 + 10 ** -(math.floor(d / 1e-4 + 0.5) * 1e-4)) if d < 8 else 0.0)


def rank_sum_z(first: list[float], second: list[float]) -> float | None:
    """Mann-Whitney z: the normal approximation from 10 values in a series on, else the exact permutation distribution.

    In the exact case the observed sum counts by half, and the probability is turned into a normal quantile.
    """
    n1, n2 = len(first), len(second)
    if not n1 or not n2:
        return None
    values = np.array([*first, *second], float)
    order = np.argsort(values, kind="stable")
    ranks = np.empty(len(values))
    ties = 0.0
    k = 0
    while k < len(values):
        e = k
        while e + 1 < len(values) and values[order[e + 1]] == values[order[k]]:
            e += 1
        ranks[order[k : e + 1]] = (k + e) / 2 + 1
        t = e - k + 1
        ties += t**3 - t
        k = e + 1
    r1 = ranks[:n1].sum()
    u1 = r1 - n1 * (n1 + 1) / 2
    n = n1 + n2
    if n1 >= 10 or n2 >= 10:
        variance = n1 * n2 / 12 * ((n + 1) - ties / (n * (n - 1)))
        return None if variance <= 0 else float((u1 - n1 * n2 / 2 + (0.5 if ties else 0.0)) / math.sqrt(variance))
    # ways to choose n1 of the ranks by their doubled sum, which is an integer
    ways: list[dict[int, int]] = [{0: 1}] + [{} for _ in range(n1)]
    for r in (round(2 * x) for x in ranks):
        for size in range(n1, 0, -1):
            for s, c in ways[size - 1].items():
                ways[size][s + r] = ways[size].get(s + r, 0) + c
    total = math.comb(n, n1)
    seen = round(2 * r1)
    below = sum(c for s, c in ways[n1].items() if s < seen) + ways[n1][seen] / 2
    return NormalDist().inv_cdf(min(max(below / total, 1e-12), 1 - 1e-12))


def excess_het(hom_ref: int, het: int, hom_alt: int) -> float:
    """Phred-scaled mid-p of at least so many heterozygotes under Hardy-Weinberg equilibrium; 160 stands for an underflow."""
    n = hom_ref + het + hom_alt
    rare = 2 * min(hom_ref, hom_alt) + het
    if not n or not rare:
        return 0.0

    def log_p(h: int) -> float:  # up to a constant
        a, b = (rare - h) // 2, (2 * n - rare - h) // 2
        return h * math.log(2) - math.lgamma(h + 1) - math.lgamma(a + 1) - math.lgamma(b + 1)

    logs = {h: log_p(h) for h in range(rare % 2, min(rare, 2 * n - rare) + 1, 2)}
    top = max(logs.values())
    whole = sum(math.exp(v - top) for v in logs.values())
    p = (sum(math.exp(v - top) for h, v in logs.items() if h > het) + math.exp(logs[het] - top) / 2) / whole
    return 160.0 if p < 10e-60 else max(0.0, -10 * math.log10(p))


def genotypes(alleles: int) -> list[tuple[int, int]]:
    """Diploid genotypes in the order of their likelihoods."""
    return [(j, k) for k in range(alleles) for j in range(k + 1)]


#: Pseudocounts of the reference, a substitution and an indel; when the iteration stops.
REF_COUNT, SNP_COUNT, INDEL_COUNT, SETTLED = 10.0, 0.01, 0.00125, 0.1


def allele_frequencies(gls: list[list[float]], priors: list[float]) -> tuple[list[float], list[list[float]]]:
    """Expectation-maximisation of allele frequencies: (effective alternate counts, log10 genotype posteriors per sample)."""
    k = len(priors)
    pairs = genotypes(k)
    freq = [1.0 / k] * k
    counts = [0.0] * k
    while True:
        posts = []
        now = [0.0] * k
        for gl in gls:
            raw = [g + (0 if j == i else math.log10(2)) + math.log10(freq[i]) + math.log10(freq[j]) for g, (i, j) in zip(gl, pairs, strict=True)]
            whole = log10_sum(raw)
            post = [x - whole for x in raw]
            posts.append(post)
            for p, (i, j) in zip(post, pairs, strict=True):
                now[i] += 10**p
                now[j] += 10**p
        moved = max(abs(a - b) for a, b in zip(now, counts, strict=True))
        counts = now
        summed = [p + c for p, c in zip(priors, counts, strict=True)]
        freq = [s / sum(summed) for s in summed]
        if moved <= SETTLED:
            return counts[1:], posts


def frequency_result(gls: list[list[float]], alleles: list[str]) -> dict:
    """Most likely alternate counts, log10 P(no variant) and each alternate's log10 P(absent)."""
    ref = alleles[0]
    priors = [REF_COUNT] + [SNP_COUNT if len(a) == len(ref) else INDEL_COUNT for a in alleles[1:]]
    counts, posts = allele_frequencies(gls, priors)
    pairs = genotypes(len(alleles))
    spanned = {0} | {i for i, a in enumerate(alleles) if a == "*"}
    none = sum(log10_sum(p for p, g in zip(post, pairs, strict=True) if set(g) <= spanned) for post in posts)
    absent = [sum(log10_sum(p for p, g in zip(post, pairs, strict=True) if i not in g) for post in posts) for i in range(1, len(alleles))]
    present = sum(log10_sum(p for p, g in zip(post, pairs, strict=True) if not set(g) <= spanned) for post in posts)
    return {"mleac": [math.floor(c + 0.5) for c in counts], "log10_none": none, "log10_some": present, "log10_absent": absent}


def phred(log10_p: float) -> float:
    return abs(-10.0 * log10_p)


#: Error of the indel model and the most reads that it counts.
INDEL_ERROR, INDEL_READS = -4.5, 40


def indel_pls(reads: int) -> list[int]:
    """PLs of the reference-confidence indel model from the number of informative reads."""
    n = min(reads, INDEL_READS)
    none, some = math.log10(1 - 10**INDEL_ERROR), INDEL_ERROR
    logs = [n * none, n * (jacobian_sum(none, some) - math.log10(2)), n * some]
    top = max(logs)
    return [math.floor(-10 * (x - top) + 0.5) for x in logs]
