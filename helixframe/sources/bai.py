"""The binning index of BAM files: reading, searching and making it.

Places are virtual: the offset of a compressed block shifted by 16, with the offset inside its content.
Spans here are 0-based and half-open, as in the index itself.
"""

from __future__ import annotations

import struct
from collections import defaultdict

#: Fixed values of the format: the first bin of each level, and the shift of its width.
LEVELS = ((0, 29), (1, 26), (9, 23), (73, 20), (585, 17), (4681, 14))
LINEAR = 14
STATISTICS = 37450


def bin_of(start: int, end: int) -> int:
    """The smallest bin that holds a span."""
    for first, shift in reversed(LEVELS):
        if start >> shift == (end - 1) >> shift:
            return first + (start >> shift)
    return 0


def bins_over(start: int, end: int) -> list[int]:
    """All bins whose span meets this one."""
    return [b for first, shift in LEVELS for b in range(first + (start >> shift), first + ((end - 1) >> shift) + 1)]


def parse(data: bytes) -> list[tuple[dict[int, list[tuple[int, int]]], list[int]]]:
    """For each contig its bins' chunks of virtual places, and the linear index."""
    if data[:4] != b"BAI\x01":
        raise ValueError("not a BAM index")
    at, out = 8, []
    for _ in range(struct.unpack("<i", data[4:8])[0]):
        (count,), at = struct.unpack("<i", data[at : at + 4]), at + 4
        bins = {}
        for _ in range(count):
            number, chunks = struct.unpack("<Ii", data[at : at + 8])
            flat = struct.unpack(f"<{2 * chunks}Q", data[at + 8 : at + 8 + 16 * chunks])
            at += 8 + 16 * chunks
            if number != STATISTICS:
                bins[number] = list(zip(flat[::2], flat[1::2], strict=True))
        (count,), at = struct.unpack("<i", data[at : at + 4]), at + 4
        out.append((bins, list(struct.unpack(f"<{count}Q", data[at : at + 8 * count]))))
        at += 8 * count
    return out


def merged(chunks: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Chunks in order, those that meet or lie in one block joined."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(chunks):
        if out and a >> 16 <= out[-1][1] >> 16:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def search(index: list, spans: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """The chunks that can hold records over any of the spans (tid, start, end)."""
    found = []
    for tid, start, end in spans:
        if not 0 <= tid < len(index) or end <= start:
            continue
        bins, linear = index[tid]
        window = start >> LINEAR
        least = linear[window] if window < len(linear) else linear[-1] if linear else 0
        found += [(max(a, least), b) for number in bins_over(start, end) for a, b in bins.get(number, []) if b > least]
    return merged(found)


def made(contigs: int, records) -> bytes:
    """The index of records (tid, start, end, virtual begin, virtual end) in the file's order."""
    bins: list[dict[int, list[list[int]]]] = [defaultdict(list) for _ in range(contigs)]
    linear: list[dict[int, int]] = [{} for _ in range(contigs)]
    for tid, start, end, begin, stop in records:
        if not 0 <= tid < contigs:
            continue
        chunks = bins[tid][bin_of(start, end)]
        if chunks and chunks[-1][1] >> 16 == begin >> 16:
            chunks[-1][1] = stop
        else:
            chunks.append([begin, stop])
        for window in range(start >> LINEAR, ((end - 1) >> LINEAR) + 1):
            linear[tid].setdefault(window, begin)
    out = [b"BAI\x01", struct.pack("<i", contigs)]
    for own, windows in zip(bins, linear, strict=True):
        out.append(struct.pack("<i", len(own)))
        for number in sorted(own):
            out.append(struct.pack("<Ii", number, len(own[number])))
            out += [struct.pack("<QQ", a, b) for a, b in own[number]]
        size, known, places = max(windows, default=-1) + 1, 0, []
        for window in range(size):  # a window without records takes the place of the one before
            known = windows.get(window, known)
            places.append(known)
        out.append(struct.pack(f"<i{size}Q", size, *places))
    return b"".join(out)
