"""Procedural steps on single reads and pairs of mates."""

from __future__ import annotations

import numpy as np

MATE_CAP = 20


def mates_reconciled(reads: list[tuple[str, str, list[int], int]]) -> list[list[int]]:
    """Qualities after mates that overlap are compared: (name, bases, qualities, start) -> qualities.

    Where both bases agree both are capped, where they differ both become 0.  Reads of one name beyond the
    second are left alone.  Offsets are counted along the bases, as the reads of a region are already clipped.
    """
    out = [list(q) for _, _, q, _ in reads]
    by_name: dict[str, list[int]] = {}
    for i, (name, *_rest) in enumerate(reads):
        by_name.setdefault(name, []).append(i)
    for pair in by_name.values():
        if len(pair) != 2:
            continue
        a, b = sorted(pair, key=lambda i: reads[i][3])
        shift = reads[b][3] - reads[a][3]
        for k in range(min(len(reads[a][1]) - shift, len(reads[b][1]))):
            i, j = shift + k, k
            if reads[a][1][i] == reads[b][1][j]:
                out[a][i], out[b][j] = min(out[a][i], MATE_CAP), min(out[b][j], MATE_CAP)
            else:
                out[a][i] = out[b][j] = 0
    return out


def rules_out_indels(read: str, quals: list[int], ref: str, most: int = 10) -> np.ndarray:
    """For each position of a read that lies one to one on ``ref``: whether no indel of up to ``most`` bases after it fits as well.

    The fit is the sum of qualities at mismatches from the position on; ``ref`` begins where the read does.
    """
    n = min(len(read), len(ref))
    a = np.frombuffer(read[:n].encode(), np.uint8)
    r = np.frombuffer(ref.encode(), np.uint8)
    q = np.asarray(quals[:n], np.int64)

    def cost(shift_read: int, shift_ref: int) -> np.ndarray:
        """Suffix sums over read offsets of mismatch qualities with the given shifts; unseen ends cost nothing."""
        size = max(0, min(n - shift_read, len(r) - shift_ref))
        miss = np.zeros(n, np.int64)
        miss[:size] = np.where(a[shift_read : shift_read + size] != r[shift_ref : shift_ref + size], q[shift_read : shift_read + size], 0)
        return np.cumsum(miss[::-1])[::-1]

    plain = cost(0, 0)
    good = np.ones(n, bool)
    for k in range(1, most + 1):
        for moved in (cost(k, 0), cost(0, k)):
            good &= ~(moved <= plain)
    good[max(0, n - most) :] = False  # too near the end to tell
    return good
