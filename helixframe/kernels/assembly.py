"""Local assembly: a k-mer graph of a region's reads and reference, and its best paths as haplotypes.

A vertex is the k-mer that ends at it.  K-mers that occur twice within one sequence are never
merged; any other k-mer has one vertex.  Results don't depend on the order of dictionaries: reads are
taken in the order given, and ties between paths are broken by their bases.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from . import seqgraph
from .align import DANGLING, haplotype_cigar, smith_waterman
from .cigar import Cigar

KMERS, STEP, MORE_TIMES, LAST_K = (10, 25), 10, 6, 85
LEAST_QUALITY, LEAST_WEIGHT, LEAST_BRANCH = 10, 2, 4
MOST_PATHS, MOST_EXPANSIONS = 128, 128
#: The share of vertices whose k-mers are not unique from which a graph counts as too repetitive.
LOW_COMPLEXITY = 4
LEAST_SPAN = 30


@dataclass
class Haplotype:
    bases: str
    cigar: Cigar
    score: float
    k: int
    is_ref: bool = False


@dataclass
class Graph:
    k: int
    kmer: list[str] = field(default_factory=list)
    out: list[dict[int, int]] = field(default_factory=list)
    into: list[dict[int, int]] = field(default_factory=list)
    ref: set[tuple[int, int]] = field(default_factory=set)
    unique: dict[str, int] = field(default_factory=dict)
    source: int = -1
    sink: int = -1

    def vertex(self, kmer: str) -> int:
        self.kmer.append(kmer)
        self.out.append({}), self.into.append({})
        return len(self.kmer) - 1

    def edge(self, a: int, b: int, weight: int, is_ref: bool = False) -> None:
        self.out[a][b] = self.out[a].get(b, 0) + weight
        self.into[b][a] = self.out[a][b]
        if is_ref:
            self.ref.add((a, b))

    def cut(self, a: int, b: int) -> None:
        del self.out[a][b], self.into[b][a]
        self.ref.discard((a, b))


def usable_runs(bases: str, quals, k: int) -> list[str]:
    """Stretches of at least k plain bases of enough quality."""
    runs, start = [], 0
    for i in range(len(bases) + 1):
        if i == len(bases) or bases[i] not in "ACGT" or quals[i] < LEAST_QUALITY:
            if i - start >= k:
                runs.append(bases[start:i])
            start = i + 1
    return runs


def repeated(sequence: str, k: int) -> set[str]:
    seen, twice = set(), set()
    for i in range(len(sequence) - k + 1):
        (twice if sequence[i : i + k] in seen else seen).add(sequence[i : i + k])
    return twice


def thread(ref: str, runs: list[str], k: int) -> Graph | None:
    """The graph of the reference and all runs; None if the reference is too short or repeats a k-mer."""
    if len(ref) < k or (repeated(ref, k) and k < LAST_K):
        return None
    several = set().union(repeated(ref, k), *(repeated(r, k) for r in runs))
    g = Graph(k)

    def place(kmer: str) -> int:
        if kmer in several:
            return g.vertex(kmer)
        if kmer not in g.unique:
            g.unique[kmer] = g.vertex(kmer)
        return g.unique[kmer]

    for sequence, is_ref in [(ref, True), *((r, False) for r in runs)]:
        starts = range(len(sequence) - k + 1)
        first = 0 if is_ref else next((i for i in starts if sequence[i : i + k] not in several), None)
        if first is None:
            continue
        v = place(sequence[first : first + k])
        if is_ref:
            g.source = v
        else:  # bases before the start count for edges that are there
            back, i = v, first
            while i > 0 and len(g.into[back]) == 1:
                (before,) = g.into[back]
                if g.kmer[before] != sequence[i - 1 : i - 1 + k]:
                    break
                g.edge(before, back, 1)
                back, i = before, i - 1
        for i in range(first + 1, len(sequence) - k + 1):
            kmer = sequence[i : i + k]
            to = next((w for w in g.out[v] if g.kmer[w] == kmer), None)
            if to is None:
                to = place(kmer)
                if to == g.source and not is_ref:
                    to = g.vertex(kmer)
            g.edge(v, to, 1, is_ref)
            v = to
        if is_ref:
            g.sink = v
    if sum(x in several for x in g.kmer) * LOW_COMPLEXITY > len(g.kmer):
        return None
    return g


def prune(g: Graph, least: int = LEAST_WEIGHT) -> None:
    """Removes linear chains without a reference edge whose edges all have little weight."""
    for v in range(len(g.kmer)):
        if len(g.into[v]) == 1 and len(g.out[v]) == 1:
            continue
        for w in list(g.out[v]):
            chain, b = [(v, w)], w
            while len(g.into[b]) == 1 and len(g.out[b]) == 1 and b not in (v, g.source, g.sink):
                (c,) = g.out[b]
                chain.append((b, c))
                b = c
            if all(e not in g.ref and g.out[e[0]].get(e[1], 0) < least for e in chain):
                for a, c in chain:
                    if c in g.out[a]:
                        g.cut(a, c)


def reference_path(g: Graph) -> list[int]:
    path, v = [g.source], g.source
    while v != g.sink:
        nxt = [w for w in g.out[v] if (v, w) in g.ref]
        if not nxt:
            return []
        v = nxt[0]
        path.append(v)
    return path


def recover_tails(g: Graph) -> None:
    """Joins branches that end without reaching the sink to the reference where they line up with it."""
    path = reference_path(g)
    on = {v: i for i, v in enumerate(path)}
    for end in [v for v in range(len(g.kmer)) if not g.out[v] and g.into[v] and v != g.sink and v not in on]:
        chain, v = [], end
        while v not in on and len(g.into[v]) == 1:
            chain.append(v)
            (v,) = g.into[v]
        if v not in on or len(chain) < LEAST_BRANCH:
            continue
        branch = "".join(g.kmer[x][-1] for x in reversed(chain))
        start = on[v] + 1
        along = "".join(g.kmer[x][-1] for x in path[start:])
        offset, cigar = smith_waterman(along, branch, DANGLING)
        if offset or not cigar or len(cigar) > 3 or cigar[0][0] != "M" or cigar[-1][0] != "M":
            continue
        reach = sum(n for op, n in cigar if op in "MD")
        length = cigar[-1][1]
        wrong = sum(a != b for a, b in zip(along[reach - length : reach], branch[-length:], strict=True))
        if wrong > max(1, length // g.k):
            continue
        same = 0
        while same < length and along[reach - 1 - same] == branch[-1 - same]:
            same += 1
        if same and start + reach - same < len(path) and same < len(chain):
            g.edge(chain[same], path[start + reach - same], 1)


def recover_heads(g: Graph) -> None:
    """Joins branches that begin elsewhere than at the source to the reference where they line up with it.

    A head's first vertex spells a whole k-mer.  Read backwards from where the branch meets the reference it is
    aligned as a tail is; where its far end agrees with the reference, new vertices lead from there to the branch.
    """
    path = reference_path(g)
    on = {v: i for i, v in enumerate(path)}
    spelt = g.kmer[path[0]] + "".join(g.kmer[v][-1] for v in path[1:])
    for head in [v for v in range(len(g.kmer)) if not g.into[v] and g.out[v] and v != g.source and v not in on]:
        chain, v = [], head
        while v not in on and len(g.out[v]) == 1 and v not in chain:
            chain.append(v)
            (v,) = g.out[v]
        if v not in on or on[v] == 0:
            continue
        branch = g.kmer[head] + "".join(g.kmer[x][-1] for x in chain[1:])
        along = spelt[: on[v] + g.k - 1]  # the reference up to the base before the one that they share
        offset, cigar = smith_waterman(along[::-1], branch[::-1], DANGLING)
        if offset or not cigar or len(cigar) > 3 or cigar[0][0] != "M" or cigar[-1][0] != "M" or len(branch) < LEAST_BRANCH:
            continue
        reach = sum(n for op, n in cigar if op in "MD")
        begin, length = len(along) - reach, cigar[-1][1]
        wrong = sum(a != b for a, b in zip(along[begin : begin + length], branch[:length], strict=True))
        if wrong > max(1, length // g.k):
            continue
        same = 0
        while same < min(length, len(branch) - 1) and along[begin + same] == branch[same]:
            same += 1
        # the reference vertex whose last base is the last that agrees
        at = begin + same - 1 - (g.k - 1)
        if not same or at < 0:
            continue
        left, first = path[at], max(0, same - (g.k - 1))
        for i in range(same, g.k - 1):  # bases of the first k-mer that have no vertex
            new = g.vertex((g.kmer[left] + branch[i])[-g.k :])
            g.edge(left, new, 1)
            left = new
        if chain[first] not in g.out[left]:
            g.edge(left, chain[first], 1)


def _reach(start: int, step: list[dict[int, int]]) -> set[int]:
    seen, todo = {start}, [start]
    while todo:
        for w in step[todo.pop()]:
            if w not in seen:
                seen.add(w)
                todo.append(w)
    return seen


def has_cycle(g: Graph) -> bool:
    left = [len(x) for x in g.into]
    todo = [v for v, n in enumerate(left) if not n]
    done = 0
    while todo:
        v = todo.pop()
        done += 1
        for w in g.out[v]:
            left[w] -= 1
            if not left[w]:
                todo.append(w)
    return done < len(g.kmer)


def assemble(ref: str, reads: list[tuple[str, list[int]]], kmers: tuple[int, ...] = KMERS, graphs: dict[int, str] | None = None) -> list[Haplotype]:
    """Haplotypes of a region, the reference first; ``reads`` are (bases, qualities).  ``graphs`` takes each k's graph as DOT."""
    found: dict[str, Haplotype] = {ref: Haplotype(ref, [("M", len(ref))], math.inf, 0, True)}

    def attempt(k: int) -> bool:
        g = thread(ref, [r for bases, quals in reads for r in usable_runs(bases, quals, k)], k)
        if g is None:
            return False
        prune(g)
        if has_cycle(g) or not reference_path(g):
            return False
        recover_tails(g)
        recover_heads(g)
        keep = _reach(g.source, g.out) & _reach(g.sink, g.into)
        if has_cycle(g) or g.sink not in keep:
            return False
        sequences = seqgraph.simplified(seqgraph.made(g, keep))
        if graphs is not None:
            graphs[k] = seqgraph.dot(sequences)
        for score, bases in seqgraph.best_paths(sequences, MOST_PATHS, MOST_EXPANSIONS):
            if bases in found:
                continue
            cigar = haplotype_cigar(ref, bases)
            if cigar is None or any(op in "SN" for op, _ in cigar):
                continue
            span = sum(n for op, n in cigar if op in "MD")
            if span == len(ref) and span >= LEAST_SPAN:
                found[bases] = Haplotype(bases, cigar, score, k)
        return True

    if not any([attempt(k) for k in kmers]):
        k = kmers[-1]
        for _ in range(MORE_TIMES):
            k += STEP
            if attempt(min(k, LAST_K)):
                break
    return list(found.values())
