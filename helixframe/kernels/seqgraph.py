"""The sequence graph of an assembly: vertices are stretches of bases, and shared stretches are factored out.

It is made of a k-mer graph's vertices between its source and its sink.  Linear chains become one vertex;
where branches between two vertices share their first or last bases these become vertices of their own, and
so do the last bases that the ways into a vertex share.  No rewriting changes the sequences that paths spell.
"""

from __future__ import annotations

import heapq
import math
from collections import defaultdict

ROUNDS = 100


class SequenceGraph:
    def __init__(self):
        self.bases: dict[int, str] = {}
        self.out: dict[int, dict[int, int]] = {}
        self.into: dict[int, dict[int, int]] = {}
        self.source = self.sink = -1
        self.next = 0

    def vertex(self, bases: str) -> int:
        v, self.next = self.next, self.next + 1
        self.bases[v], self.out[v], self.into[v] = bases, {}, {}
        return v

    def edge(self, a: int, b: int, weight: int) -> None:
        self.out[a][b] = self.into[b][a] = self.out[a].get(b, 0) + weight

    def drop(self, v: int) -> None:
        for w in self.out.pop(v):
            del self.into[w][v]
        for w in self.into.pop(v):
            del self.out[w][v]
        del self.bases[v]

    def sizes(self) -> tuple[int, int]:
        return len(self.bases), sum(map(len, self.out.values()))


def made(graph, keep: set[int]) -> SequenceGraph:
    """The sequence graph of a k-mer graph's vertices in ``keep``: the source spells its k-mer, any other its last base."""
    s = SequenceGraph()
    names = {v: s.vertex(graph.kmer[v] if v == graph.source else graph.kmer[v][-1]) for v in sorted(keep)}
    for v in names:
        for w, n in graph.out[v].items():
            if w in names:
                s.edge(names[v], names[w], n)
    s.source, s.sink = names[graph.source], names[graph.sink]
    return s


def zipped(s: SequenceGraph) -> bool:
    """Joins each vertex with its only successor where that has no other predecessor; tells whether any was."""
    changed = False
    for v in sorted(s.bases):
        while v in s.bases and len(s.out[v]) == 1:
            (w,) = s.out[v]
            if len(s.into[w]) != 1 or w in (v, s.source) or v == s.sink:
                break
            s.bases[v] += s.bases[w]
            after = dict(s.out[w])
            s.drop(w)
            for x, n in after.items():
                s.edge(v, x, n)
            if w == s.sink:
                s.sink = v
            changed = True
    return changed


def _shared(texts: list[str], most: int) -> int:
    """How many first characters all texts share, ``most`` at most."""
    n = 0
    while n < most and len({t[n] for t in texts}) == 1:
        n += 1
    return n


def _factored(s: SequenceGraph, top: int | None, middle: list[int], bottom: int) -> bool:
    """Shared first bases (where ``top`` is their only predecessor) and last bases of ``middle`` as vertices of their own."""
    texts = [s.bases[m] for m in middle]
    shortest = min(map(len, texts))
    first = _shared(texts, shortest) if top is not None else 0
    last = _shared([t[::-1] for t in texts], shortest - first)
    if not first and not last:
        return False
    head = s.vertex(texts[0][:first]) if first else None
    tail = s.vertex(texts[0][len(texts[0]) - last :]) if last else None
    for m, text in zip(middle, texts, strict=True):
        entries, leave = dict(s.into[m]), s.out[m][bottom]
        inner = text[first : len(text) - last]
        s.drop(m)
        # an empty middle is an edge; of equal ones the weights are added up
        v = s.vertex(inner) if inner else None
        for a, n in entries.items():
            if head is not None:
                s.edge(a, head, n)
            start = head if head is not None else a
            if v is not None:
                s.edge(start, v, n)
            elif tail is not None:
                s.edge(start, tail, n)
            else:
                s.edge(start, bottom, n)
        if v is not None:
            s.edge(v, tail if tail is not None else bottom, leave)
        if tail is not None:
            s.edge(tail, bottom, leave)
    return True


def _diamonds(s: SequenceGraph) -> bool:
    for a in sorted(s.bases):
        if a not in s.bases:
            continue
        groups = defaultdict(list)
        for m in sorted(s.out[a]):
            if len(s.into[m]) == 1 and len(s.out[m]) == 1 and m not in (s.source, s.sink):
                groups[next(iter(s.out[m]))].append(m)
        for z, middle in sorted(groups.items()):
            if len(middle) > 1 and z != a and _factored(s, a, middle, z):
                return True
    return False


def _suffixes(s: SequenceGraph) -> bool:
    for z in sorted(s.bases):
        middle = [m for m in sorted(s.into[z]) if len(s.out[m]) == 1 and m not in (z, s.source, s.sink) and s.into[m]]
        if len(middle) < 2 or len(middle) != len(s.into[z]):
            continue
        shortest = min(len(s.bases[m]) for m in middle)
        # a vertex that the shared bases used up would leave an edge from each way into it
        if _shared([s.bases[m][::-1] for m in middle], shortest) in range(1, shortest) and _factored(s, None, middle, z):
            return True
    return False


def simplified(s: SequenceGraph, rounds: int = ROUNDS) -> SequenceGraph:
    """Zipped and factored until nothing changes."""
    zipped(s)
    for _ in range(rounds):
        if not (_diamonds(s) or _suffixes(s)):
            break
        zipped(s)
    return s


def best_paths(s: SequenceGraph, most: int, expansions: int) -> list[tuple[float, str]]:
    """(score, bases) of the best paths from source to sink by the sum of log10 of edge shares."""
    heap = [(0.0, s.bases[s.source], s.source)]
    visits: dict[int, int] = defaultdict(int)
    found = []
    while heap and len(found) < most:
        cost, bases, v = heapq.heappop(heap)
        if v == s.sink:
            found.append((-cost, bases))
            continue
        visits[v] += 1
        if visits[v] > expansions:
            continue
        total = sum(s.out[v].values())
        for w, n in s.out[v].items():
            heapq.heappush(heap, (cost - math.log10(n / total), bases + s.bases[w], w))
    return found


def dot(s: SequenceGraph) -> str:
    """The graph in the DOT language: vertices by their bases, edges by their weights."""
    lines = [f'  v{v} [label="{b}"{", shape=box" if v in (s.source, s.sink) else ""}];' for v, b in sorted(s.bases.items())]
    lines += [f'  v{v} -> v{w} [label="{n}"];' for v in sorted(s.out) for w, n in sorted(s.out[v].items())]
    return "\n".join(["digraph assembly {", *lines, "}"])
