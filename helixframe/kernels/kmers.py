"""K-mers and covariates of many sequences at once, in NumPy: time grows with their length, sorting apart.

Sequences are laid end to end as code points.  A k-mer is a whole number whose digits are the ranks of its
letters; where the letters are too many for that, numbers are replaced by their ranks as the k-mers grow.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np

#: Code points of a slice of sequences (one sequence at least).
SLICE = 1 << 20
MOST_CODE = 1 << 62
POINTS = 0x110000


def slices(sequences: list[str], most: int = SLICE) -> Iterator[tuple[int, int]]:
    """Ranges of sequences that hold about ``most`` code points together."""
    begin = total = 0
    for i, s in enumerate(sequences):
        if total and total + len(s) > most:
            yield begin, i
            begin, total = i, 0
        total += len(s)
    if begin < len(sequences):
        yield begin, len(sequences)


def laid(sequences: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The code points of sequences end to end, and the lengths."""
    points = np.frombuffer("".join(sequences).encode("utf-32-le"), dtype="<u4")
    return points, np.fromiter((len(s) for s in sequences), np.int64, len(sequences))


def coded(points: np.ndarray, lengths: np.ndarray, k: int) -> tuple[np.ndarray, Callable[[np.ndarray], list[str]]]:
    """The k-mers of each sequence in order as numbers, and what turns numbers back to text."""
    n = len(points) - k + 1
    if n <= 0:
        return np.empty(0, np.int64), lambda found: []
    present = np.zeros(POINTS, bool)
    present[points] = True
    letters = np.flatnonzero(present)
    rank = np.zeros(POINTS, np.int32)
    rank[letters] = np.arange(len(letters), dtype=np.int32)
    ids, size = rank[points].astype(np.int64), len(letters)
    code, top, ranked = ids, size, False
    for j in range(1, k):
        if top > MOST_CODE // size:
            distinct, code = np.unique(code, return_inverse=True)
            top, ranked = len(distinct), True
        code = code[:-1] * size + ids[j:]
        top *= size
    # no k-mer goes on into the next sequence
    keep = np.ones(n, bool)
    late = (np.cumsum(lengths)[:-1, None] - np.arange(1, k)).ravel()
    keep[late[(late >= 0) & (late < n)]] = False
    code = code[keep]
    if ranked:
        distinct, first, code = np.unique(code, return_index=True, return_inverse=True)
        places = np.flatnonzero(keep)[first]

    def text(found: np.ndarray) -> list[str]:
        if ranked:
            whole = points[places[found][:, None] + np.arange(k)]
        else:
            whole = letters[found[:, None] // size ** np.arange(k - 1, -1, -1) % size]
        joined = whole.astype("<u4").tobytes().decode("utf-32-le")
        return [joined[i : i + k] for i in range(0, len(joined), k)]

    return code, text


def _runs(values: np.ndarray, begins: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Where runs of equal sorted values begin, and how long they are; ``begins`` are places where one begins in any case."""
    new = np.ones(len(values), bool)
    new[1:] = values[1:] != values[:-1]
    if begins is not None:
        new[begins[begins < len(values)]] = True
    at = np.flatnonzero(new)
    return at, np.diff(at, append=len(values))


def totals(sequences: list[str], k: int) -> tuple[list[str], np.ndarray]:
    """Each distinct k-mer with how often the sequences hold it."""
    code, text = coded(*laid(sequences), k)
    code = np.sort(code)
    at, count = _runs(code)
    return text(code[at]), count


def by_sequence(sequences: list[str], k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, Callable]:
    """(sequence, k-mer as a number, count) of each distinct k-mer of each sequence, and what turns numbers to text."""
    points, lengths = laid(sequences)
    code, text = coded(points, lengths, k)
    stops = np.cumsum(np.maximum(lengths - (k - 1), 0))
    begins = np.concatenate([[0], stops[:-1]]).astype(np.int64)
    for a, b in zip(begins.tolist(), stops.tolist(), strict=True):
        code[a:b].sort()
    at, count = _runs(code, begins)
    return np.searchsorted(stops, at, "right"), code[at], count, text


def repeated(sequences: list[str], k: int) -> tuple[list[str], np.ndarray, np.ndarray]:
    """K-mers that a single sequence holds more than once: in how many sequences, and the most in one."""
    _, code, count, text = by_sequence(sequences, k)
    code, count = code[count > 1], count[count > 1]
    order = np.argsort(code)
    code, count = code[order], count[order]
    at, n = _runs(code)
    return text(code[at]), n, np.maximum.reduceat(count, at) if len(at) else count


def covariates(sequences: list[str], groups: np.ndarray, reverse: np.ndarray, second: np.ndarray, size: int) -> tuple[np.ndarray, list, np.ndarray, np.ndarray, np.ndarray]:
    """(group, context, bases, least cycle, greatest cycle) of each group and context.

    A base's context is the ``size`` bases that end there, None at the start and around anything but ACGT; its
    cycle goes from 1 at the start of sequencing, negative in the second of a pair.
    """
    points, lengths = laid(sequences)
    digit = np.full(POINTS, 4, np.int8)
    digit[[ord(c) for c in "ACGT"]] = range(4)
    d = digit[points].astype(np.int64)
    none = 4**size
    i = np.arange(len(points)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    code, bad = np.zeros(len(points), np.int64), i < size - 1
    for j in range(size):
        shifted = np.concatenate([np.full(min(j, len(d)), 4), d[: len(d) - j]]) if j else d
        bad |= shifted > 3
        code += shifted * 4**j
    code[bad] = none
    place = np.where(np.repeat(reverse, lengths), np.repeat(lengths, lengths) - i, i + 1)
    cycle = np.where(np.repeat(second, lengths), -place, place)
    key = np.repeat(groups, lengths) * (none + 1) + code
    whole = (int(groups.max()) + 1 if len(groups) else 0) * (none + 1)
    count = np.bincount(key, minlength=whole)
    least, most = np.full(whole, np.iinfo(np.int64).max), np.full(whole, np.iinfo(np.int64).min)
    np.minimum.at(least, key, cycle)
    np.maximum.at(most, key, cycle)
    seen = np.flatnonzero(count)
    names = [None if c == none else "".join("ACGT"[c // 4**j % 4] for j in range(size - 1, -1, -1)) for c in (seen % (none + 1)).tolist()]
    return seen // (none + 1), names, count[seen], least[seen], most[seen]
