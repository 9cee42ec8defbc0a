"""Kernels against closed forms and brute force; no Spark."""

import itertools
import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from kairograph.operators import communities as C
from kairograph.operators import crossbin as X
from kairograph.operators import journeys as J
from kairograph.operators import kernels as K


def graph(n, arcs, directed=True):
    b = np.zeros((n, n))
    for u, v in arcs:
        b[u, v] = 1
        if not directed:
            b[v, u] = 1
    return b


STAR = graph(5, [(0, i) for i in range(1, 5)], False)
CYCLE = graph(4, [(0, 1), (1, 2), (2, 3), (3, 0)])


def test_star():
    assert K.betweenness(STAR, False).tolist() == [6, 0, 0, 0, 0]
    assert K.load(STAR, False).tolist() == [6, 0, 0, 0, 0]
    assert K.closeness(STAR)[0] == 1 and K.closeness(STAR)[1] == pytest.approx(4 / 7)
    assert K.flow_betweenness(STAR, False).tolist() == [6, 0, 0, 0, 0]
    assert K.coreness(STAR, "out").tolist() == [1] * 5
    got = K.graph_measures(STAR, False)
    assert got["centralization_betweenness"] == pytest.approx(1)
    assert got["diameter"] == 2 and got["components"] == 1


def test_cycle():
    assert K.pagerank(CYCLE) == pytest.approx([0.25] * 4)
    assert K.graph_measures(CYCLE, True)["components_strong"] == 1
    assert K.graph_measures(CYCLE, True)["hierarchy"] == 0
    assert np.isnan(K.eigenvector(CYCLE)).sum() in (0, 4)
    assert K.prestige(CYCLE, "domain").tolist() == [3] * 4
    assert K.balance(CYCLE) == pytest.approx(CYCLE)


def test_balance_needs_total_support():
    assert K.balance(np.array([[1, 1], [0, 1]])) is None
    assert K.balance(graph(3, [(0, 1), (0, 2)])) is None


@settings(max_examples=30, deadline=None)
@given(st.integers(3, 6), st.integers(0, 2**30 - 1))
def test_triads_and_relabelling(n, bits):
    b = np.array([[bits >> (i * n + j) & 1 if i != j else 0 for j in range(n)] for i in range(n)], float)
    t = K.triads(b)
    assert t.sum() == math.comb(n, 3)
    p = np.random.default_rng(bits).permutation(n)
    c = b[np.ix_(p, p)]
    assert K.triads(c).tolist() == t.tolist()
    assert K.betweenness(c, True) == pytest.approx(K.betweenness(b, True)[p])
    assert K.pagerank(c) == pytest.approx(K.pagerank(b)[p])


@settings(max_examples=30, deadline=None)
@given(st.integers(0, 10_000))
def test_assignment_is_best(seed):
    r = np.random.default_rng(seed)
    n, m = map(int, r.integers(1, 5, 2))
    s = r.random((n, m))
    best = max(sum(s[i, j] for i, j in (zip(range(n), p, strict=False) if n <= m else ((i, j) for j, i in enumerate(p)))) for p in itertools.permutations(range(max(n, m)), min(n, m)))
    assert sum(s[i, j] for i, j in C.assign(s)) == pytest.approx(best)


def test_segments_and_silhouette():
    d = np.array([[0 if (i < 3) == (j < 3) else 1 for j in range(6)] for i in range(6)], float)
    assert X.best_segments(d, 2) == [1, 1, 1, 2, 2, 2]
    assert X.agglomerate(d, 2, "average") == [1, 1, 1, 2, 2, 2]
    assert X.agglomerate(d, 2, "ward") == [1, 1, 1, 2, 2, 2]
    assert X.silhouette(d, [1, 1, 1, 2, 2, 2]) == 1


def test_groupings():
    same = np.array([[3, 0], [0, 2]], float)
    got = C.compare_groupings(same)
    assert got["nmi"] == pytest.approx(1) and got["ari"] == pytest.approx(1) and got["vi"] == pytest.approx(0)
    a = np.zeros((8, 8))
    for g in (range(4), range(4, 8)):
        for i, j in itertools.permutations(g, 2):
            a[i, j] = 1
    assert len(set(C.louvain(C.modularity_matrix([a], 1, 0)[0], 1).tolist())) == 2


CHAIN = [("A", "B", 1, 2, 1), ("B", "C", 2, 3, 1), ("C", "D", 3, 4, 1), ("D", "E", 4, 5, 1)]
JOURNEYS = [("A", "B", 0, 0, 1), ("B", "D", 5, 5, 1), ("A", "C", 6, 6, 1), ("C", "D", 7, 7, 1), ("A", "F", 1, 1, 1), ("F", "G", 2, 2, 1), ("G", "D", 3, 3, 1)]


def test_chain():
    s = J.Search(J.index(CHAIN, True), "A", 1)
    assert [(v, s.label(v).time, s.label(v).hops) for v in "ABCDE"] == [("A", 1, 0), ("B", 1, 1), ("C", 2, 2), ("D", 3, 3), ("E", 4, 4)]
    assert [v for v, _ in s.routes("E")[0]] == list("ABCDE")


def test_three_journeys():
    atoms = J.index(JOURNEYS, True)
    s = J.Search(atoms, "A", 0)
    assert (s.label("D").time, s.label("D").hops, s.label("D").count) == (3, 3, 1)
    assert (s.label("D", "min_hops").time, s.label("D", "min_hops").hops) == (5, 2)
    assert J.fastest(atoms, "A", 0)["D"][:3] == (1, 6, 7)


def test_backwards_and_waiting():
    atoms = J.index([("C", "A", 5, 6, 1), ("A", "B", 1, 2, 1)], True)
    assert "B" not in J.Search(atoms, "C", 1).best
    assert J.Search(J.index([("A", "B", 0, 100, 1), ("Z", "A", 50, 51, 1)], True), "Z", 50).label("B").time == 50


def test_cheap_detour():
    atoms = J.index([("A", "B", 0, 0, 1), ("B", "C", 2, 2, 1), ("A", "C", 1, 1, 5)], True)
    assert J.shortest(atoms, "A", 0)["C"][0] == 2


def test_latest_departure():
    got = J.latest(J.index(CHAIN, True), "E", 10)
    assert got["D"][:2] == (5, False) and got["A"][:2] == (2, False)


def _brute(rows, source, at):
    best = {source: at}
    for _ in range(len(rows) + 1):
        for u, v, s, e, _ in rows:
            if u in best:
                t = max(best[u], s)
                if (t == s or t < e) and t < best.get(v, math.inf):
                    best[v] = t
    return best


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.sampled_from("ABCDE"), st.sampled_from("ABCDE"), st.integers(0, 8), st.integers(0, 4)), max_size=14))
def test_arrivals_match_relaxation(rows):
    rows = [(u, v, float(s), float(s + d), 1.0) for u, v, s, d in rows if u != v]
    s = J.Search(J.index(rows, True), "A", 0.0)
    assert {v: s.label(v).time for v in s.best} == _brute(rows, "A", 0.0)
    for v in s.best:
        routes = s.routes(v)
        assert len({tuple(r) for r in routes}) <= s.label(v).count == len(routes)
