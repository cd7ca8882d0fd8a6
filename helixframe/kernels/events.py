"""Events of haplotypes, allele merging and trimming, tandem repeats, phasing."""

from __future__ import annotations

from .cigar import ALIGNED, Cigar

Event = tuple[int, int, str, str]  # start, stop, ref, alt; 1-based, closed


def haplotype_events(hap: str, cigar: Cigar, ref: str, ref_start: int) -> list[Event]:
    """Differences of a haplotype from the reference window that begins at ``ref_start``; two at one start become one."""
    found: dict[int, Event] = {}

    def add(start: int, was: str, now: str) -> None:
        if start in found:
            _, stop, ref0, alt0 = found[start]
            long_ref, _short = (was, ref0) if len(was) > len(ref0) else (ref0, was)
            # a substitution (or insertion) and a deletion at one start: the bases of both
            now = (alt0 if len(alt0) > len(now) else now) if len(alt0) != len(now) else alt0
            if len(ref0) == 1 and len(alt0) == 1:
                now = alt0 + (now[1:] if len(was) <= len(ref0) or len(now) > 1 else "")
            found[start] = (start, start + len(long_ref) - 1, long_ref, now)
        else:
            found[start] = (start, start + len(was) - 1, was, now)

    r = h = 0
    for i, (op, n) in enumerate(cigar):
        if op in ALIGNED:
            for k in range(n):
                a, b = ref[r + k], hap[h + k]
                if a != b and a != "N" and b != "N":
                    add(ref_start + r + k, a, b)
            r, h = r + n, h + n
        elif op == "I":
            if r > 0 and 0 < i < len(cigar) - 1:
                bases = hap[h : h + n]
                if set(bases) <= set("ACGT") and ref[r - 1] in "ACGT":
                    add(ref_start + r - 1, ref[r - 1], ref[r - 1] + bases)
            h += n
        elif op == "D":
            if r > 0:
                add(ref_start + r - 1, ref[r - 1 : r + n], ref[r - 1])
            r += n
        elif op == "S":
            h += n
    return [found[k] for k in sorted(found)]


def overlapping(events: list[Event], at: int) -> list[Event]:
    """Events over a position; a deletion that ends there is left out if an insertion begins there."""
    here = [e for e in events if e[0] <= at <= e[1]]
    inserts = any(e[0] == at and len(e[3]) > len(e[2]) for e in here)
    return [e for e in here if not (inserts and e[0] < at and len(e[2]) > len(e[3]) and e[1] == at)]


def merged_alleles(events: list[Event], at: int) -> list[str]:
    """Reference first: the longest of those that begin here; the others' alternates padded; '*' for earlier deletions."""
    here = [e for e in events if e[0] == at]
    ref = max((e[2] for e in here), key=len, default="")
    out = [ref]
    for e in here:
        alt = e[3] + ref[len(e[2]) :]
        if alt not in out:
            out.append(alt)
    if any(e[0] < at <= e[1] for e in events):
        out.append("*")
    return out


def trimmed_alleles(alleles: list[str]) -> tuple[int, list[str]]:
    """(bases cut from the left, alleles) without shared ends; symbolic ones and '*' are left alone."""
    plain = [a for a in alleles if a != "*" and not a.startswith("<")]
    cut = 0
    while len(plain) > 1 and min(map(len, plain)) - cut > 1 and len({a[len(a) - 1 - cut] for a in plain}) == 1:
        cut += 1
    right = {a: a[: len(a) - cut] for a in plain}
    lead = 0
    while len(plain) > 1 and min(map(len, right.values())) - lead > 1 and len({x[lead] for x in right.values()}) == 1:
        lead += 1
    return lead, [right[a][lead:] if a in right else a for a in alleles]


def repeat_unit(bases: str) -> str:
    """The shortest unit whose repetition makes the bases."""
    for n in range(1, len(bases) + 1):
        if len(bases) % n == 0 and bases[:n] * (len(bases) // n) == bases:
            return bases[:n]
    return bases


def repetitions(unit: str, bases: str, from_left: bool = True) -> int:
    n = 0
    while unit and (bases.startswith(unit) if from_left else bases.endswith(unit)):
        n += 1
        bases = bases[len(unit) :] if from_left else bases[: -len(unit)]
    return n


def phase_groups(calls: list[tuple[str, frozenset[int]]], called: int) -> dict[str, tuple[str, str]]:
    """Phase of biallelic calls from the haplotypes that carry each: call id -> (group id, '0|1' or '1|0').

    ``calls`` are (id such as pos_ref_alt, haplotypes with the alternate) in order, ``called`` is how many
    haplotypes were called.  Nothing is phased if a call would be in two phases.
    """
    out: dict[str, tuple[str, str]] = {}
    for i, (a, with_a) in enumerate(calls):
        for b, with_b in calls[i + 1 :]:
            if not with_a or not with_b:
                continue
            every = len(with_a) == called or len(with_b) == called
            if with_a == with_b or every:
                turn = False
            elif not (with_a & with_b) and len(with_a) + len(with_b) == called:
                turn = True
            else:
                continue
            group, phase = out.setdefault(a, (a, "0|1"))
            other = phase if not turn else ("1|0" if phase == "0|1" else "0|1")
            if b in out and out[b] != (group, other):
                return {}
            out[b] = (group, other)
    return out
