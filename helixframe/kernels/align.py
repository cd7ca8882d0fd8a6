"""Affine-gap alignment, with rows of the table worked out by NumPy."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from .cigar import Cigar, merged


@dataclass(frozen=True)
class Scores:
    match: int
    mismatch: int
    gap_open: int
    gap_extend: int


#: Haplotype to reference, read to haplotype, dangling end to reference path.
HAPLOTYPE = Scores(200, -150, -260, -11)
READ = Scores(10, -15, -30, -5)
DANGLING = Scores(25, -50, -110, -6)


def smith_waterman(ref: str, alt: str, scores: Scores = HAPLOTYPE, overhang: str = "softclip") -> tuple[int, Cigar]:
    """(offset from 0 in ``ref``, CIGAR of ``alt``).

    ``overhang`` is what becomes of unaligned ends of ``alt``: ``softclip`` clips them, ``indel`` makes the
    alignment reach both ends of both sequences.  Of equal scores a match goes before a gap, and the end nearest
    to the diagonal is taken.
    """
    n, m = len(ref), len(alt)
    if not n or not m:
        return 0, merged([("S", m)] if overhang == "softclip" else [("I", m), ("D", n)])
    if alt in ref and overhang == "softclip":
        return ref.rfind(alt), [("M", m)]
    a, b = np.frombuffer(ref.encode(), np.uint8), np.frombuffer(alt.encode(), np.uint8)
    low = -(10**8)
    best = np.zeros((n + 1, m + 1), np.int64)
    came = np.zeros((n + 1, m + 1), np.int64)  # 0 diagonal; over 0 a deletion of so many; under 0 an insertion
    steps = np.arange(m + 1)
    if overhang == "indel":
        best[0, 1:] = scores.gap_open + scores.gap_extend * (steps[1:] - 1)
        best[1:, 0] = scores.gap_open + scores.gap_extend * np.arange(n)
    down = np.full(m + 1, low, np.int64)
    down_size = np.zeros(m + 1, np.int64)
    floor = 0 if overhang == "softclip" else low
    for i in range(1, n + 1):
        opened, longer = best[i - 1] + scores.gap_open, down + scores.gap_extend
        down_size = np.where(opened >= longer, 1, down_size + 1)
        down = np.maximum(opened, longer)
        diagonal = best[i - 1, :-1] + np.where(a[i - 1] == b, scores.match, scores.mismatch)
        cell = np.maximum(np.maximum(diagonal, down[1:]), floor)
        # an insertion from column k costs open + extend * (j - k - 1): a running maximum of what is left of the cost
        start = np.concatenate((best[i, :1], cell)) + scores.gap_open - scores.gap_extend * (steps + 1)
        run = np.maximum.accumulate(start[:-1])
        right = run + scores.gap_extend * steps[1:]
        source = np.maximum.accumulate(np.where(start[:-1] == run, steps[:-1], 0))
        value = np.maximum(cell, right)
        best[i, 1:] = value
        size = steps[1:] - source
        came[i, 1:] = np.where((diagonal >= down[1:]) & (diagonal >= right), 0, np.where(right >= down[1:], -size, down_size[1:]))
    if overhang == "softclip":
        last = best[:, m]
        i = int(np.flatnonzero(last == last.max())[np.argmin(np.abs(np.flatnonzero(last == last.max()) - m))])
        row = best[n]
        j = m
        if row.max() > last.max():
            i, j = n, int(np.argmax(row))
    else:
        i, j = n, m
    out: Cigar = [("S", m - j)] if j < m else []
    while i > 0 and j > 0:
        if overhang == "softclip" and best[i, j] <= 0:
            break
        step = int(came[i, j])
        if step == 0:
            out.append(("M", 1))
            i, j = i - 1, j - 1
        elif step > 0:
            out.append(("D", step))
            i -= step
        else:
            out.append(("I", -step))
            j += step
    if overhang == "softclip":
        out.append(("S", j))
        offset = i
    else:
        out += [("D", i), ("I", j)]
        offset = 0
    return offset, merged(out[::-1])


def haplotype_cigar(ref: str, hap: str) -> Cigar | None:
    """A haplotype's alignment to the whole reference window; None where it has none that spans it."""
    if len(ref) == len(hap) and sum(x != y for x, y in zip(ref, hap, strict=True)) <= 2:
        return [("M", len(hap))]
    pad = "N" * 10
    _, cigar = smith_waterman(pad + ref + pad, pad + hap + pad, HAPLOTYPE, "indel")
    if not cigar or cigar[0][0] != "M" or cigar[-1][0] != "M" or cigar[0][1] < 10 or cigar[-1][1] < 10:
        return None
    inner = list(cigar)
    inner[0] = ("M", inner[0][1] - 10)
    inner[-1] = ("M", inner[-1][1] - 10)
    return merged(inner)
