"""Recalibrated qualities of many reads at once, in NumPy."""

from __future__ import annotations

import numpy as np


class Steps:
    """Steps of read groups: ``base`` by quality, ``context`` by quality and code, ``cycle`` by quality and cycle within ``reach``."""

    def __init__(self, names: list, base: list, context: list, cycle: list, reach: list, qualities: int):
        self.number = {n: i for i, n in enumerate(names)}
        self.reach = np.array([*reach, 0], np.int64)
        self.most, self.qualities = int(self.reach.max()), qualities
        # a last group for reads of none
        self.base = np.array([*base, np.full(qualities, np.nan)], float)
        self.context = np.array([np.reshape(c, (qualities, -1)) for c in context] + [np.zeros((qualities, len(context[0]) // qualities if context else 1))], float)
        self.cycle = np.zeros((len(names) + 1, qualities, 2 * self.most + 1))
        for i, (c, r) in enumerate(zip(cycle, reach, strict=True)):
            self.cycle[i, :, self.most - r : self.most + r + 1] = np.reshape(c, (qualities, -1))


def recalibrated(steps: Steps, groups: list, flags: np.ndarray, sequences: list[str], lengths: np.ndarray, quals: np.ndarray, size: int, reverse_flag: int = 0x10, second_flag: int = 0x80) -> np.ndarray:
    """The qualities of reads, end to end in their stored order; a context ends at its base in machine order."""
    reverse = flags & reverse_flag != 0
    fitted = [s if len(s) == n else (s[max(0, len(s) - n) :].rjust(n, "N") if r else s[:n].ljust(n, "N")) for s, n, r in zip(sequences, lengths.tolist(), reverse.tolist(), strict=True)]
    points = np.frombuffer("".join(fitted).encode("utf-32-le"), dtype="<u4")
    digit = np.full(128, 4, np.int64)
    digit[[ord(c) for c in "ACGT"]] = range(4)
    d = digit[np.minimum(points, 127)]
    rev = np.repeat(reverse, lengths)
    place = np.arange(len(quals)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    i = np.where(rev, np.repeat(lengths, lengths) - 1 - place, place)
    step = np.where(rev, 1, -1)
    d = np.where(rev & (d < 4), 3 - d, d)
    code, known, at = np.zeros(len(d), np.int64), i >= size - 1, np.arange(len(d))
    for j in range(size):
        # what lies outside of the read is unknown by its place, so that any base may stand for it
        x = d[np.clip(at + j * step, 0, max(len(d) - 1, 0))]
        known &= x < 4
        code += x * 4**j
    number = np.array([steps.number.get(g, len(steps.number)) for g in groups], np.int64)
    g = np.repeat(number, lengths)
    cycle = np.where(np.repeat(flags & second_flag != 0, lengths), -(i + 1), i + 1)
    listed = (quals >= 0) & (quals < steps.qualities)
    q = np.where(listed, quals, 0)
    value = np.where(listed, steps.base[g, q], np.nan)
    value = np.where(np.isnan(value), quals, value)
    known &= listed
    value = value + np.where(known, steps.context[g, q, np.where(known, code, 0) % steps.context.shape[2]], 0.0)
    seen = listed & (np.abs(cycle) <= steps.reach[g])
    value = value + np.where(seen, steps.cycle[g, q, np.where(seen, cycle, 0) + steps.most], 0.0)
    new = np.clip(np.nan_to_num(np.floor(value + 0.5)), 1, 93)
    return np.where(quals < 6, quals, new).astype(np.int32)
