"""Measures from lists of arcs against those of whole matrices."""

import numpy as np
import pandas as pd
import pytest

from kairograph.operators import centrality, snapshots
from kairograph.operators import kernels as K
from kairograph.operators import ways as W
from kairograph.sources import builders


def _graph(n, m, seed):
    rng = np.random.default_rng(seed)
    a, b = rng.integers(0, n, m), rng.integers(0, n, m)
    pairs = np.unique(np.stack([a, b], 1)[a != b], axis=0)
    matrix = np.zeros((n, n))
    matrix[pairs[:, 0], pairs[:, 1]] = 1
    return pairs[:, 0], pairs[:, 1], matrix


@pytest.fixture(scope="module", params=[True, False])
def series(request, spark):
    """Two windows of a random network, and their matrices."""
    directed, rows, want = request.param, [], []
    for k in (0, 1):
        a, b, m = _graph(23, 40, 5 + k)
        rows += [(f"v{i:02d}", f"v{j:02d}", k + 0.5) for i, j in zip(a, b)]
        want.append(m if directed else np.maximum(m, m.T))
    net = builders.network(spark.createDataFrame(rows, "from string, to string, time double"), directed=directed)
    names = sorted(r.name for r in net.nodes.collect())
    keep = [int(v[1:]) for v in names]
    return net, names, [m[np.ix_(keep, keep)] for m in want], directed


def _no_matrix(*_):
    raise AssertionError("a window became a matrix")


def _values(net, measure, monkeypatch, **how):
    monkeypatch.setattr(snapshots, "matrix", _no_matrix)
    monkeypatch.setattr(centrality, "matrix", _no_matrix)
    got = centrality.centrality_series(net, [measure], start=0.0, end=1.0, step=1.0, **how).toPandas()
    return [got[got.time == t].set_index("node").value for t in (0.0, 1.0)]


def _agree(series, measure, kernel, monkeypatch, **how):
    net, names, matrices, _ = series
    for got, m in zip(_values(net, measure, monkeypatch, **how), matrices):
        np.testing.assert_allclose(got.loc[names], kernel(m), rtol=1e-9, atol=1e-12)


def test_closeness(series, monkeypatch):
    _agree(series, "closeness", K.closeness, monkeypatch)
    if series[3]:
        _agree(series, "closeness", lambda b: K.closeness(b.T), monkeypatch, mode="in")


def test_reached_by_parts_blocks_and_hubs(monkeypatch):
    monkeypatch.setattr(W, "BLOCK", 7)
    monkeypatch.setattr(W, "RANKS", 2)
    a, b, m = _graph(60, 150, 1)
    got = pd.concat([W.reached(a, b, p, 3) for p in range(3)]).groupby("id").agg({"reached": "sum", "total": "sum", "far": "max"})
    d = K.distances(m)
    np.fill_diagonal(d, np.inf)
    fine = np.isfinite(d)
    for i in range(60):
        want = (fine[i].sum(), d[i][fine[i]].sum(), d[i][fine[i]].max(initial=0))
        assert (tuple(got.loc[i]) if i in got.index else (0, 0, 0)) == want


def test_harary(series, monkeypatch):
    _agree(series, "harary", K.harary, monkeypatch)


def test_centralization(series, monkeypatch):
    net, _, matrices, directed = series
    monkeypatch.setattr(snapshots, "matrix", _no_matrix)
    names = ["centralization_betweenness", "centralization_closeness"]
    got = snapshots.metrics(net, names, start=0.0, end=1.0, step=1.0).toPandas().set_index(["time", "measure"]).value
    for t, m in zip((0.0, 1.0), matrices):
        want = K.graph_measures(m, directed)
        assert [got[t, c] for c in names] == pytest.approx([want[c] for c in names])


def test_constraint(series, monkeypatch):
    _agree(series, "constraint", K.constraint, monkeypatch)


@pytest.mark.parametrize("whole", [1024, 0])
def test_power(series, monkeypatch, whole):
    monkeypatch.setattr(W, "WHOLE", whole)
    a, b, m = _graph(40, 120, 3)
    want = K.power(m, 0.05)
    got = W.solved(a, b, 40, 0.05)
    assert got * np.sqrt(40 / (got @ got)) == pytest.approx(want)
    _agree(series, "power", lambda b: K.power(b, 0.05), monkeypatch, beta=0.05)


def test_betweenness(series, monkeypatch):
    _agree(series, "betweenness", lambda b: K.betweenness(b, series[3]), monkeypatch)


def test_reach(series, monkeypatch):
    net, _, matrices, directed = series
    monkeypatch.setattr(snapshots, "matrix", _no_matrix)
    names = ["components_strong", "mean_distance", "diameter", "hierarchy"]
    got = snapshots.metrics(net, names, start=0.0, end=1.0, step=1.0).toPandas().set_index(["time", "measure"]).value
    for t, m in zip((0.0, 1.0), matrices):
        want = K.graph_measures(m, directed)
        assert [got[t, c] for c in names] == pytest.approx([want[c] for c in names])


def test_pagerank(series, monkeypatch):
    _agree(series, "pagerank", K.pagerank, monkeypatch)


def test_betweenness_of_beginnings_side_by_side_sorts_no_step(monkeypatch):
    a, b, m = _graph(40, 110, 3)
    sorts, unique = [], np.unique
    monkeypatch.setattr(W.np, "unique", lambda *x, **how: sorts.append(1) or unique(*x, **how))
    for states in (1, 130, 10_000):
        monkeypatch.setattr(W, "STATES", states)
        sorts.clear()
        got = pd.concat([W.between(a, b, part, 2, 1.0) for part in range(2)]).groupby("id")["value"].sum()
        assert len(sorts) == 2  # once for each part, to number its vertices
        np.testing.assert_allclose(got.reindex(range(40), fill_value=0.0), K.betweenness(m, True), rtol=1e-9, atol=1e-12)


def test_arcs_travel_as_one_value_of_a_window(series, monkeypatch):
    """However many parts a window has, no row of an arc is dealt out once for each."""
    net, names, matrices, _ = series
    monkeypatch.setattr(W, "BLOCK", 5)
    dealt, real = [], W.Arcs.dealt
    monkeypatch.setattr(W.Arcs, "dealt", lambda x, fn, schema, parts: (dealt.append((parts, x.windows.count(), x.windows.columns)), real(x, fn, schema, parts))[1])
    _agree(series, "closeness", K.closeness, monkeypatch)
    assert dealt == [(-(-len(names) // 5), len(matrices), ["bin", "n", "arcs"])]


def test_betweenness_of_large_windows_adds_up_few_arcs_one_by_one(monkeypatch):
    """A beginning of a large window goes through its arcs in order; only small steps are scattered."""
    a, b, m = _graph(400, 2000, 4)
    monkeypatch.setattr(W, "STATES", 400)
    scattered = []
    add = np.add

    class Counted:
        @staticmethod
        def at(out, where, what):
            scattered.append(len(where))
            add.at(out, where, what)

    monkeypatch.setattr(W.np, "add", Counted)
    got = W.between(a, b, 0, 1, 1.0).set_index("id")["value"]
    monkeypatch.undo()
    assert sum(scattered) < 400 * len(a) / 2
    np.testing.assert_allclose(got.reindex(range(400), fill_value=0.0), K.betweenness(m, True), rtol=1e-9, atol=1e-9)
