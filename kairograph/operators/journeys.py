"""Searches for time-respecting paths on one machine; no Spark in here.

An atom ``(from, to, start, end)`` can be entered in ``[start, end)``, or at
``start`` if it is a point; entering takes ``traversal`` time.
"""

from __future__ import annotations

import heapq
import math
from collections import defaultdict
from dataclasses import dataclass

from kairograph.errors import BudgetExceeded

Atom = tuple[str, str, float, float, float]
INF = math.inf


@dataclass(frozen=True)
class Label:
    """The best way to a vertex: arrival, hops and number of such ways."""

    time: float
    hops: int
    count: int


class Search:
    """All states of a forward search from one source, layer by layer."""

    def __init__(self, atoms: dict[str, list[Atom]], source: str, at: float, upper: float = INF, traversal: float = 0.0):
        self.source, self.at = source, at
        self.best: dict[str, list[tuple[int, float]]] = {source: [(0, at)]}
        self.layers: list[dict[tuple[str, float], int]] = [{(source, at): 1}]
        self.before: dict[tuple[int, str, float], list[tuple[str, float, Atom]]] = {}
        earliest = {source: at}
        while self.layers[-1]:
            h = len(self.layers)
            fresh: dict[tuple[str, float], int] = defaultdict(int)
            for (v, t), n in self.layers[-1].items():
                for atom in atoms.get(v, ()):
                    entry = max(t, atom[2])
                    if entry != atom[2] and entry >= atom[3] or (entry == atom[3] != atom[2]):
                        continue
                    arrival, w = entry + traversal, atom[1]
                    if traversal and atom[3] > atom[2] and arrival > atom[3]:
                        continue
                    if arrival > upper or arrival >= earliest.get(w, INF):
                        continue  # as late with fewer hops or as many: never better
                    fresh[w, arrival] += n
                    self.before.setdefault((h, w, arrival), []).append((v, t, atom))
            for w, t in fresh:
                if t < earliest.get(w, INF):
                    earliest[w] = t
                    self.best.setdefault(w, [])
                    self.best[w] = [x for x in self.best[w] if x[0] < h] + [(h, t)]
            self.layers.append(dict(fresh))
        self.layers.pop()

    def label(self, v: str, criterion: str = "foremost_then_shortest") -> Label | None:
        ways = self.best.get(v)
        if not ways:
            return None
        h, t = min(ways, key=lambda x: (x[1], x[0]) if criterion == "foremost_then_shortest" else (x[0], x[1]))
        return Label(t, h, self.layers[h].get((v, t), 1))

    def routes(self, v: str, criterion: str = "foremost_then_shortest", most: int = 1_000_000) -> list[list[tuple[str, float]]]:
        """All best ways as lists of ``(vertex, time)``."""
        best = self.label(v, criterion)
        if best is None:
            return []
        if best.count > most:
            raise BudgetExceeded(f"{best.count} routes")
        out: list[list[tuple[str, float]]] = []

        def back(h: int, w: str, t: float, tail: list[tuple[str, float]]) -> None:
            if h == 0:
                out.append([(w, t), *tail])
                return
            for u, s, _ in self.before[h, w, t]:
                back(h - 1, u, s, [(w, t), *tail])

        back(best.hops, v, best.time, [])
        return sorted(out)

    def through(self, criterion: str = "foremost_then_shortest", targets: dict[str, float] | None = None) -> tuple[dict[str, float], dict[Atom, float]]:
        """Shares of best ways that run through each vertex, and that use each atom, summed over targets.

        ``targets`` gives the targets that count and how many best ways each has in all.
        """
        node: dict[str, float] = defaultdict(float)
        edge: dict[Atom, float] = defaultdict(float)
        ends: dict[tuple[int, str, float], float] = {}
        for v in self.best:
            if v != self.source and (b := self.label(v, criterion)) and (targets is None or v in targets):
                ends[b.hops, v, b.time] = 1 / (b.count if targets is None else targets[v])
        share: dict[tuple[int, str, float], float] = defaultdict(float)
        for h in range(len(self.layers) - 1, 0, -1):
            for v, t in self.layers[h]:
                key = (h, v, t)
                inner = share[key]
                node[v] += inner * self.layers[h][v, t]
                total = inner + ends.get(key, 0.0)
                if total:
                    for u, s, atom in self.before[key]:
                        n = self.layers[h - 1][u, s]
                        edge[atom] += total * n
                        share[h - 1, u, s] += total
        return node, edge


def winners(found: list[Search], source: str, criterion: str = "foremost_then_shortest") -> list[dict[str, float]]:
    """For each search, the targets whose best ways it has, and the number of best ways over all searches."""
    best: dict[str, tuple[tuple, float, list[int]]] = {}
    for i, f in enumerate(found):
        for v in f.best:
            b = f.label(v, criterion)
            if v == source or b is None:
                continue
            rank = (b.hops, b.time) if criterion == "min_hops" else (b.time, b.hops)
            if v not in best or rank < best[v][0]:
                best[v] = (rank, b.count, [i])
            elif rank == best[v][0]:
                best[v] = (rank, best[v][1] + b.count, [*best[v][2], i])
    return [{v: n for v, (_, n, who) in best.items() if i in who} for i in range(len(found))]


def shortest(atoms: dict[str, list[Atom]], source: str, at: float, upper: float = INF, cost: str = "weight") -> dict[str, tuple[float, float, int]]:
    """``vertex: (cost, arrival, hops)`` of the cheapest ways, earliest of equals."""
    done: dict[str, tuple[float, float, int]] = {}
    seen: dict[str, list[tuple[float, float]]] = defaultdict(list)
    heap: list[tuple[float, float, int, str]] = [(0.0, at, 0, source)]
    while heap:
        c, t, h, v = heapq.heappop(heap)
        if any(t >= x and c >= y for y, x in seen[v]):
            continue
        seen[v].append((c, t))
        done.setdefault(v, (c, t, h))
        for atom in atoms.get(v, ()):
            entry = max(t, atom[2])
            if entry <= upper and (entry == atom[2] or entry < atom[3]):
                heapq.heappush(heap, (c + (atom[4] if cost == "weight" else 1.0), entry, h + 1, atom[1]))
    return done


def fastest(atoms: dict[str, list[Atom]], source: str, at: float, upper: float = INF, traversal: float = 0.0) -> dict[str, tuple[float, float, float, int]]:
    """``vertex: (duration, departure, arrival, hops)``; departures are tried where something begins or ends."""
    out: dict[str, tuple[float, float, float, int]] = {source: (0.0, at, at, 0)}
    times = sorted({t for xs in atoms.values() for a in xs for t in ((a[2], a[3]) if a[3] > a[2] else (a[2],))})
    tries = {at}
    for a in atoms.get(source, ()):
        if a[2] == a[3]:
            tries.add(a[2])
        else:
            tries.update(t for t in times if a[2] <= t <= a[3])
            tries.add(a[2])
            tries.update(math.nextafter(t, -INF) for t in times if a[2] < t <= a[3])
    left = set(Search(atoms, source, at, upper, traversal).best) - {source}
    for depart in sorted(t for t in tries if at <= t <= upper):
        if not left:  # no way takes less than no time
            break
        found = Search(atoms, source, depart, upper, traversal)
        for v in found.best:
            b = found.label(v)
            if v != source and b and (v not in out or b.time - depart < out[v][0]):
                out[v] = (b.time - depart, depart, b.time, b.hops)
                if b.time == depart:
                    left.discard(v)
    return out


def latest(atoms: dict[str, list[Atom]], target: str, deadline: float, lower: float = -INF, traversal: float = 0.0) -> dict[str, tuple[float, bool, int]]:
    """``vertex: (latest departure, whether it is attained, hops)`` to be at the target by a deadline."""
    into: dict[str, list[Atom]] = defaultdict(list)
    for xs in atoms.values():
        for a in xs:
            into[a[1]].append(a)
    best: dict[str, tuple[float, bool, int]] = {target: (deadline, True, 0)}
    front, h = {target: (deadline, True)}, 0
    while front:
        h += 1
        fresh: dict[str, tuple[float, bool]] = {}
        for v, (t, sure) in front.items():
            for u, _, s, e, _ in into.get(v, ()):
                d = min(e - (traversal if e > s else 0.0), t - traversal)
                reached = sure if d < e or s == e else False
                if s == e:
                    d, reached = s, sure and s <= t - traversal or s < t - traversal
                    if s > t - traversal or (s == t - traversal and not sure):
                        continue
                elif d < s or (d == s and not sure and d == t - traversal):
                    continue
                elif d < t - traversal:
                    reached = traversal > 0
                if d < lower:
                    continue
                if u not in best or (d, reached) > best[u][:2]:
                    best[u] = (d, reached, h)
                    fresh[u] = (d, reached)
        front = fresh
    return best


def foremost_count(atoms: dict[str, list[Atom]], source: str, at: float, target: str, upper: float = INF, most: int = 100_000) -> int:
    """Number of vertex-simple earliest ways, counted one by one up to a budget."""
    found = Search(atoms, source, at, upper)
    best = min((t for _, t in found.best.get(target, [])), default=None)
    if best is None:
        return 0
    states = 0

    def walk(v: str, t: float, seen: frozenset[str]) -> int:
        nonlocal states
        states += 1
        if states > most:
            raise BudgetExceeded(f"more than {most} states")
        if v == target:
            return 1
        n = 0
        for atom in atoms.get(v, ()):
            entry = max(t, atom[2])
            if atom[1] not in seen and entry <= best and (entry == atom[2] or entry < atom[3]):
                n += walk(atom[1], entry, seen | {atom[1]})
        return n

    return walk(source, at, frozenset({source}))


def index(rows: list[Atom], directed: bool) -> dict[str, list[Atom]]:
    """Atoms by tail; both ways if undirected; overlapping or touching ones of a pair joined."""
    both = list(rows) if directed else [*rows, *((b, a, s, e, w) for a, b, s, e, w in rows)]
    groups: dict[tuple[str, str], list[Atom]] = defaultdict(list)
    for a in sorted(both, key=lambda x: (x[2], x[3])):
        groups[a[0], a[1]].append(a)
    out: dict[str, list[Atom]] = defaultdict(list)
    for (u, v), xs in groups.items():
        stretch = None
        for a in [x for x in xs if x[3] > x[2]]:
            if stretch and a[2] <= stretch[3]:
                stretch = (u, v, stretch[2], max(stretch[3], a[3]), stretch[4])
            else:
                if stretch:
                    out[u].append(stretch)
                stretch = a
        if stretch:
            out[u].append(stretch)
        points = {x[2]: x for x in reversed(xs) if x[3] == x[2]}
        out[u] += points.values()
    return {u: sorted(xs, key=lambda x: (x[2], x[3], x[1])) for u, xs in out.items()}
