"""Reads laid on the tiles of a reference, and their bases counted, in NumPy: many reads at once."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np

#: CIGAR operations by code; 0 is any other.
LETTERS = "MIDNSHP=X"
INSERTED, DELETED, CLIPPED = (LETTERS.index(x) + 1 for x in "IDS")
ON_REF, ON_READ, ALIGNED = (np.array([False] + [x in some for x in LETTERS]) for some in ("MDN=X", "MIS=X", "M=X"))
BLANK = ord(" ")
#: Stands for a quality that is null; and the bases that are counted at once, so few that sums of places are exact.
NONE, SLICE = np.iinfo(np.int64).min, 1 << 17


def starts(counts: np.ndarray) -> np.ndarray:
    return np.cumsum(counts) - counts


def spread(first: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """``counts`` numbers from each ``first`` on, end to end."""
    return np.repeat(first - starts(counts), counts) + np.arange(counts.sum())


def points(data) -> np.ndarray:
    """The characters of UTF-8, a byte each where all are ASCII."""
    found = np.frombuffer(data, np.uint8)
    return found if not len(found) or found.max() < 128 else np.frombuffer(bytes(data).decode().encode("utf-32-le"), "<u4")


def utf8(found: np.ndarray) -> bytes:
    return found.tobytes() if found.dtype == np.uint8 else found.astype("<u4").tobytes().decode("utf-32-le").encode()


def cut(first: np.ndarray, last: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, bin, first, last) of closed ranges cut at the edges of bins."""
    a = first // width
    n = np.where(last >= first, last // width - a + 1, 0)
    row, at = np.repeat(np.arange(len(first)), n), spread(a, n)
    return row, at, np.maximum(first[row], at * width), np.minimum(last[row], (at + 1) * width - 1)


def span(start: np.ndarray, counts: np.ndarray, ops: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """The last position that each read's CIGAR reaches."""
    total = np.concatenate([[0], np.cumsum(np.where(ON_REF[ops], lens, 0))])
    at = starts(counts)
    return start + total[at + counts] - total[at] - 1


def tiles(key: np.ndarray, at: np.ndarray, lengths: np.ndarray, chars: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(keys, tiles end to end, pieces that are seen) of pieces of tiles: a piece holds up to the next one's beginning.

    Of pieces that begin at one place the greatest is seen.
    """
    offset, order = starts(lengths), np.lexsort((at, key))
    same = np.zeros(len(order) + 1, bool)
    same[1:-1] = (key[order[1:]] == key[order[:-1]]) & (at[order[1:]] == at[order[:-1]])
    tied = same[1:] | same[:-1]
    if tied.any():
        order[tied] = sorted(order[tied].tolist(), key=lambda i: (key[i], at[i], chars[offset[i] : offset[i] + lengths[i]].tolist()))
    k, a, shown = key[order], at[order], lengths[order]
    shown[:-1] = np.where(k[1:] == k[:-1], np.minimum(shown[:-1], a[1:] - a[:-1]), shown[:-1])
    keys, number = np.unique(k, return_inverse=True)
    out = np.full(len(keys) * width, BLANK, chars.dtype)
    out[spread(number * width + a, shown)] = chars[spread(offset[order], shown)]
    return keys, out, np.sort(order[shown > 0])


@dataclass
class Reads:
    """Reads end to end.  Their positions count between ``low`` and ``high``, exclusive; ``n_seq`` and ``n_qual`` are -1 for null.

    A quality is its place in ``levels``.
    """

    group: np.ndarray
    start: np.ndarray
    low: np.ndarray
    high: np.ndarray
    n_seq: np.ndarray
    seq: np.ndarray
    n_qual: np.ndarray
    qual: np.ndarray
    n_cigar: np.ndarray
    ops: np.ndarray
    lens: np.ndarray

    def slices(self) -> Iterator[Reads]:
        """The reads in order, so many at a time that they hold about ``SLICE`` bases."""
        seq, qual, cigar = (np.concatenate([[0], np.cumsum(np.maximum(n, 0))]) for n in (self.n_seq, self.n_qual, self.n_cigar))
        i = 0
        while i < len(self.start):
            j = max(i + 1, int(np.searchsorted(seq, seq[i] + SLICE, "right")) - 1)
            flat = self.seq[seq[i] : seq[j]], self.n_qual[i:j], self.qual[qual[i] : qual[j]], self.n_cigar[i:j], self.ops[cigar[i] : cigar[j]], self.lens[cigar[i] : cigar[j]]
            yield Reads(self.group[i:j], self.start[i:j], self.low[i:j], self.high[i:j], self.n_seq[i:j], *flat)
            i = j


def counted(r: Reads, levels: np.ndarray, origin: np.ndarray, per: int, keys: np.ndarray, laid: np.ndarray, width: int, clip_quality: int, clip_least: int, deletion_quality: int) -> Iterator[tuple[np.ndarray, ...]]:
    """(group, cls, qual, n, places, hq, n_hq) of reads' bases over the tiles, a slice of bases at a time.

    ``levels``, in ascending order but for ``NONE`` in the end, are the qualities that there are, that of deletions included.
    A tile's key is its group times ``per`` and its bin from the group's ``origin``.
    """
    if not len(r.ops) or not len(keys):
        return
    read = np.repeat(np.arange(len(r.start)), r.n_cigar)
    some = r.n_cigar > 0
    begin = starts(r.n_cigar)[some]

    def before(x: np.ndarray) -> np.ndarray:
        total = np.cumsum(x) - x
        return total - np.repeat(total[begin], r.n_cigar[some])

    ref, q = r.start[read] + before(np.where(ON_REF[r.ops], r.lens, 0)), before(np.where(ON_READ[r.ops], r.lens, 0))
    prev, after = np.roll(r.ops, 1), np.roll(r.ops, -1)
    prev[begin], after[begin + r.n_cigar[some] - 1] = 0, 0
    n_seq, n_qual = np.maximum(r.n_seq, 0), np.maximum(r.n_qual, 0)
    seq_at, qual_at = starts(n_seq)[read], starts(n_qual)[read]
    n_seq, n_qual = n_seq[read], n_qual[read]
    good = np.concatenate([[0], np.cumsum((levels > clip_quality)[r.qual])])
    clips = good[qual_at + np.minimum(q + r.lens, n_qual)] - good[qual_at + np.minimum(q, n_qual)]
    # what a read lacks stands last
    chars, code = np.concatenate([r.seq, np.zeros(1, r.seq.dtype)]), np.concatenate([r.qual, [len(levels) - 1]])

    aligned = ALIGNED[r.ops] & (r.n_seq >= 0)[read] & (r.n_qual >= 0)[read]
    lowest, highest = origin[r.group] * width, (origin[r.group] + per) * width - 1
    a, b = np.maximum(ref, np.maximum(lowest, r.low + 1)[read]), np.minimum(ref + r.lens - 1, np.minimum(highest, r.high - 1)[read])
    for deleted in (False, True):
        chosen = np.flatnonzero(((r.ops == DELETED) if deleted else aligned) & (r.lens > 0) & (a <= b))
        row, at, s, t = cut(a[chosen], b[chosen], width)
        el = chosen[row]
        group = r.group[read[el]]
        key = group * per + at - origin[group]
        tile = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
        met = keys[tile] == key
        el, group, s, t, under = el[met], group[met], s[met], t[met], (tile * width + s - at * width)[met]
        stops, i = np.cumsum(t - s + 1), 0
        while i < len(el):
            j = max(i + 1, int(np.searchsorted(stops, (stops[i - 1] if i else 0) + SLICE, "right")))
            x, g, f, z, counts = el[i:j], group[i:j], s[i:j], t[i:j], (t - s + 1)[i:j]
            u = laid[spread(under[i:j], counts)]
            at_q = spread(q[x] + f - ref[x], counts)
            first, last = starts(counts), np.cumsum(counts) - 1
            edge_at, edge_hq = np.empty(0, np.int64), np.empty(0, np.int64)
            if deleted:
                variant, quality = np.ones(len(u), bool), np.full(len(u), np.searchsorted(levels[:-1], deletion_quality))
            else:
                # a base that the read lacks is not the reference's
                own = np.where(at_q < np.repeat(n_seq[x], counts), at_q + np.repeat(seq_at[x], counts), len(r.seq))
                known = np.where(at_q < np.repeat(n_qual[x], counts), at_q + np.repeat(qual_at[x], counts), len(r.qual))
                variant, quality = chars[own] != u, code[known]
                at_first, at_last = f == ref[x], z == ref[x] + r.lens[x] - 1
                by_clip = at_last & (r.lens[x] > 1) & (after[x] == CLIPPED)
                by_first = at_first & (prev[x] == CLIPPED)
                variant[first[at_first & np.isin(prev[x], (CLIPPED, INSERTED, DELETED))]] = True
                variant[last[by_clip | (at_last & np.isin(after[x], (INSERTED, DELETED)))]] = True
                edge_at = np.concatenate([first[by_first], last[by_clip]])
                edge_hq = np.concatenate([clips[x[by_first] - 1], clips[x[by_clip] + 1]])
                held = (u[edge_at] != BLANK) & (levels[quality[edge_at]] >= clip_least)
                edge_at, edge_hq = edge_at[held], edge_hq[held]
            size = 2 * len(levels)
            kind = (np.repeat(g - g[0], counts) * 2 + ~variant) * len(levels) + quality
            pos, seen, most = spread(f, counts), u != BLANK, (int(g.max()) - int(g[0]) + 1) * size
            hq, n_hq = np.bincount(kind[edge_at], edge_hq, most), np.bincount(kind[edge_at], None, most)
            if not seen.all():
                kind, pos = kind[seen], pos[seen]
            n = np.bincount(kind, None, most)
            found = np.flatnonzero(n)
            yield found // size + g[0], found % size // len(levels), levels[found % len(levels)], n[found], np.bincount(kind, pos, most)[found].astype(np.int64), hq[found].astype(np.int64), n_hq[found]
            i = j
