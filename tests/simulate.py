"""A seeded synthetic genome: reference, planted variants and paired reads with true alignments."""

from __future__ import annotations

import random


def genome(length: int = 4000, seed: int = 5) -> str:
    r = random.Random(seed)
    return "".join(r.choice("ACGT") for _ in range(length))


def plant(ref: str, seed: int = 6, every: int = 450) -> list[tuple[int, str, str, int]]:
    """(start, ref, alt, copies 1 or 2), 1-based: substitutions, insertions and deletions in turn."""
    r = random.Random(seed)
    out = []
    for i, at in enumerate(range(400, len(ref) - 400, every)):
        base = ref[at - 1]
        if i % 3 == 0:
            out.append((at, base, r.choice([b for b in "ACGT" if b != base]), 1 + i % 2))
        elif i % 3 == 1:
            out.append((at, base, base + "".join(r.choice([b for b in "ACGT" if b != ref[at]]) for _ in range(3)), 2 - i % 2))
        else:
            out.append((at, ref[at - 1 : at + 4], base, 1 + i % 2))
    return out


def reads(ref: str, truth: list, depth: int = 30, size: int = 150, seed: int = 7, tid: int = 0) -> list[tuple]:
    """Rows in the order of ``schemas.READS`` from two haplotypes, with sequencing errors."""
    r = random.Random(seed)
    out = []
    haps = []
    for copy in range(2):
        bases, map_ = [], []  # haplotype bases; for each the reference position, or the one before and an insertion mark
        p = 1
        events = {t[0]: t for t in truth if t[3] == 2 or copy == 0}
        while p <= len(ref):
            if p in events:
                _, was, now, _ = events[p]
                bases.append(now[0]), map_.append((p, False))
                for b in now[1:] if len(now) > len(was) else "":
                    bases.append(b), map_.append((p, True))
                p += len(was)
            else:
                bases.append(ref[p - 1]), map_.append((p, False))
                p += 1
        haps.append(("".join(bases), map_))
    n = len(ref) * depth // size
    for i in range(n):
        hap, where = haps[r.randrange(2)]
        at = r.randrange(0, len(hap) - size)
        seq, quals = [], []
        for b in hap[at : at + size]:
            q = r.randint(25, 40)
            if r.random() < 10 ** (-q / 10):
                b = r.choice([x for x in "ACGT" if x != b])
            seq.append(b), quals.append(q)
        places = where[at : at + size]
        while places[0][1]:  # begin on an aligned base
            places, seq, quals = places[1:], seq[1:], quals[1:]
        cigar: list[tuple[str, int]] = []

        def add(op, k):
            if cigar and cigar[-1][0] == op:  # noqa: B023
                cigar[-1] = (op, cigar[-1][1] + k)  # noqa: B023
            else:
                cigar.append((op, k))  # noqa: B023

        prev = None
        for p, ins in places:
            if ins:
                add("I", 1)
                continue
            if prev is not None and p > prev + 1:
                add("D", p - prev - 1)
            add("M", 1)
            prev = p
        flag = 0x10 if r.random() < 0.5 else 0
        out.append((tid * 10**6 + i, f"r{tid}_{i}", flag, tid, places[0][0], prev, 60, [tuple(c) for c in cigar], -1, 0, 0, "".join(seq), quals, "rg1"))
    return out


def chunks(ref: str, width: int = 500, tid: int = 0) -> list[tuple]:
    return [(tid, i + 1, ref[i : i + width]) for i in range(0, len(ref), width)]
