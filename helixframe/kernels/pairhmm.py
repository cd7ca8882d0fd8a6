"""Pair hidden Markov model: likelihoods of reads given haplotypes, in double precision.

All haplotypes of a region are worked on together: a row of the table is an array of
(haplotype, base).  Probabilities are scaled by the row's greatest, so that nothing underflows.
"""

from __future__ import annotations

import numpy as np

#: Gap open and gap continuation penalties, the least quality kept and what replaces lower ones.
GAP_OPEN, GAP_CONTINUATION, QUALITY_FLOOR, LOW_QUALITY = 45, 10, 18, 6
#: Most repeats and longest unit looked at, the penalties from and to which repeats lower it, and each model's rate.
MOST_REPEATS, MOST_UNIT, REPEAT_PENALTY, LEAST_PENALTY = 20, 8, 40, 10
PCR_RATES = {"none": None, "hostile": 1.0, "aggressive": 2.0, "conservative": 3.0}


def model_qualities(quals: np.ndarray, mapq: int, floor: int = QUALITY_FLOOR) -> np.ndarray:
    q = np.minimum(quals, mapq)
    return np.where(q < floor, LOW_QUALITY, q)


def repeat_length(bases: str, at: int) -> int:
    """Units of the longest tandem repeat, of a unit of at most 8 bases, around the base at ``at``."""
    best = 1
    for unit in range(1, min(MOST_UNIT, len(bases)) + 1):
        end = at + 1
        if end - unit < 0:
            continue
        word = bases[end - unit : end]
        n, k = 1, end - 2 * unit
        while k >= 0 and bases[k : k + unit] == word:
            n, k = n + 1, k - unit
        k = end
        while bases[k : k + unit] == word:
            n, k = n + 1, k + unit
        best = max(best, n)
    return min(best, MOST_REPEATS)


def gap_penalties(bases: str, model: str = "conservative") -> np.ndarray:
    """Gap-open penalties, lower where a base stands in a tandem repeat, by the model's rate."""
    rate = PCR_RATES[model]
    out = np.full(len(bases), GAP_OPEN)
    if rate is None:
        return out
    for i in range(len(bases)):
        n = repeat_length(bases, i)
        out[i] = min(GAP_OPEN, max(LEAST_PENALTY, round(REPEAT_PENALTY - np.exp(n / (rate * np.pi)) + 1.0)))
    return out


def likelihoods(read: str, quals: np.ndarray, haplotypes: list[str], gaps: np.ndarray | None = None, continuation: int = GAP_CONTINUATION) -> np.ndarray:
    """log10 P(read | haplotype) for each haplotype."""
    if not haplotypes:
        return np.zeros(0)
    if gaps is None:
        gaps = np.full(len(read), GAP_OPEN)
    sizes = np.array([len(h) for h in haplotypes])
    width = int(sizes.max())
    bases = np.zeros((len(haplotypes), width), np.uint8)
    for i, h in enumerate(haplotypes):
        bases[i, : len(h)] = np.frombuffer(h.encode(), np.uint8)
    inside = np.arange(width) < sizes[:, None]
    reads = np.frombuffer(read.encode(), np.uint8)
    error = 10.0 ** (-np.asarray(quals, float) / 10)
    opened = 10.0 ** (-np.asarray(gaps, float) / 10)
    stay = 10.0 ** (-continuation / 10)
    n = ord("N")
    shape = (len(haplotypes), width + 1)
    m, x, y = np.zeros(shape), np.zeros(shape), np.zeros(shape)
    y[:] = (1.0 / sizes)[:, None]
    log = np.zeros(len(haplotypes))
    powers = stay ** np.arange(width + 1)
    for i in range(len(read)):
        same = (bases == reads[i]) | (bases == n) | (reads[i] == n)
        emit = np.where(same, 1 - error[i], error[i] / 3)
        to_match, from_gap, to_gap = 1 - 2 * opened[i], 1 - stay, opened[i]
        new_m = np.zeros(shape)
        new_m[:, 1:] = emit * (m[:, :-1] * to_match + (x[:, :-1] + y[:, :-1]) * from_gap) * inside
        new_x = m * to_gap + x * stay
        new_x[:, 0] = 0
        # y runs along the row: y[j] = sum over k < j of m[k] * open * stay^(j - k - 1), by blocks that keep powers in range
        new_y = np.zeros(shape)
        source = new_m * to_gap
        carry = np.zeros(len(haplotypes))
        for a in range(0, width + 1, 128):
            part = source[:, a : a + 128]
            k = part.shape[1]
            p = powers[:k]
            sums = np.cumsum(part / p, axis=1) * p
            before = np.concatenate((np.zeros((len(part), 1)), sums[:, :-1] ), axis=1)
            new_y[:, a : a + k] = carry[:, None] * p + before
            carry = (carry * p[-1] + before[:, -1]) * stay + part[:, -1]
        m, x, y = new_m, new_x, new_y
        top = np.maximum(np.maximum(m, x).max(axis=1), y.max(axis=1))
        top[top <= 0] = 1.0
        m, x, y = m / top[:, None], x / top[:, None], y / top[:, None]
        log += np.log10(top)
    ends = np.concatenate((np.zeros((len(haplotypes), 1), bool), inside), axis=1)
    total = ((m + x) * ends).sum(axis=1)
    with np.errstate(divide="ignore"):
        return np.log10(total) + log
