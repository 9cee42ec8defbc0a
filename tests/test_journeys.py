"""Ways by rounds of joins against searches vertex by vertex, and rules of presence, walls and limits."""

import math
import random

import pytest
from pyspark.sql import functions as F

from kairograph.errors import BudgetExceeded
from kairograph.operators import journeys as J
from kairograph.operators import paths
from kairograph.sources import builders

SPELLS = "from string, to string, start double, end double, weight double, session string"


def log(spark, rows, **how):
    full = [(a, b, float(s), float(e), float(w), x) for a, b, s, e, w, x in rows]
    return builders.from_tables(spark.createDataFrame(full, SPELLS), check=False, **how)


def some_rows(seed, n=70, points=0.5):
    r = random.Random(seed)
    out = []
    for _ in range(n):
        a, b = r.sample("abcdefgh", 2)
        s = r.randint(0, 30)
        out.append((a, b, s, s if r.random() < points else s + r.randint(1, 4), r.choice([1, 1, 2, 3]), r.choice("xy")))
    return out


def walls(rows, directed=True, collapse=False):
    out = {}
    for a, b, s, e, w, x in rows:
        out.setdefault("" if collapse else x, []).append((a, b, float(s), float(e), float(w)))
    return [J.index(v, directed) for _, v in sorted(out.items())]


@pytest.mark.parametrize("seed,directed,criterion", [(1, True, "foremost_then_shortest"), (2, False, "min_hops")])
def test_best_ways_and_their_shares(spark, seed, directed, criterion):
    rows = some_rows(seed, 40)
    net = log(spark, rows, directed=directed)
    begin, split = min(r[2] for r in rows), walls(rows, directed)
    want, node = {}, dict.fromkeys("abcdefgh", 0.0)
    edge = {a[:4]: 0.0 for w in split for xs in w.values() for a in xs}
    for s in "abcdefgh":
        found = [J.Search(w, s, begin) for w in split]
        for f, ends in zip(found, J.winners(found, s, criterion), strict=True):
            through, over = f.through(criterion, ends)
            for v, x in through.items():
                node[v] += x
            for a, x in over.items():
                edge[a[:4]] += x
            for v, n in ends.items():
                b = f.label(v, criterion)
                want[s, v] = (b.time, b.hops, n)
    got = {(r["source"], r["node"]): (r["arrival"], r["hops"], r["n_paths"]) for r in paths.paths(net, criterion=criterion).filter("source <> node").collect()}
    assert got == want
    b = {r["node"]: r["value"] for r in paths.path_centrality(net, ["betweenness"], criterion).collect()}
    assert b == pytest.approx({k: v for k, v in node.items() if k in b})
    if criterion == "foremost_then_shortest":
        e = {(r["from"], r["to"], r["start"], r["end"]): r["value"] for r in paths.edge_centrality(net).collect()}
        assert e == pytest.approx(edge)
        routes = {}
        for r in paths.path_steps(net).collect():
            routes.setdefault((r["source"], r["node"]), []).append(tuple(zip(r["route"], r["times"], strict=True)))
        assert {k: len(v) for k, v in routes.items()} == {k: v[2] for k, v in want.items()}
        assert all(v[0][0] == s and v[-1][0] == t and v[-1][1] == want[s, t][0] for (s, t), x in routes.items() for v in x)


@pytest.mark.parametrize("seed", [4])
def test_cheapest_and_latest(spark, seed):
    rows = some_rows(seed, 60)
    net = log(spark, rows)
    begin, end = min(r[2] for r in rows), max(r[3] for r in rows)
    (atoms,) = walls(rows, collapse=True)
    got = {(r["source"], r["node"]): (r["cost"], r["arrival"]) for r in paths.paths(net, criterion="shortest", sessions="collapse").collect()}
    want = {(s, v): x[:2] for s in "abcdefgh" for v, x in J.shortest(atoms, s, begin).items()}
    assert got == {k: v for k, v in want.items() if k[0] in {a for a, _ in got}}
    back = {(r["target"], r["node"]): (r["departure"], r["attained"], r["hops"]) for r in paths.backward_paths(net, sessions="collapse").collect()}
    assert back == {(t, v): x for t in "abcdefgh" for v, x in J.latest(atoms, t, end).items() if t in {a for a, _ in back}}
    latest = {(r["source"], r["node"]): r for r in paths.paths(net, criterion="latest_departure", sessions="collapse").collect()}
    assert {k: r["departure"] for k, r in latest.items()} == {(v, t): d for (t, v), (d, _, _) in back.items()}
    for (t, v), (d, sure, _) in back.items():
        r = latest[v, t]
        if not sure:
            assert (r["hops"], r["n_paths"]) == (None, 0)
        elif v != t:
            b = J.Search(atoms, v, d).label(t)
            assert (r["arrival"], r["hops"], r["n_paths"]) == (b.time, b.hops, b.count)


@pytest.mark.parametrize("seed,traversal", [(6, 0.0), (7, 1.0)])
def test_fastest(spark, seed, traversal):
    rows = some_rows(seed, 45)
    begin = min(r[2] for r in rows)
    (atoms,) = walls(rows, collapse=True)
    got = {(r["source"], r["node"]): r for r in paths.paths(log(spark, rows), criterion="fastest", sessions="collapse", traversal=traversal).collect()}
    names = {a for a, _ in got}
    want = {(s, v): x for s in names for v, x in J.fastest(atoms, s, begin, math.inf, traversal).items()}
    assert {k: r["latency"] for k, r in got.items()} == pytest.approx({k: x[0] for k, x in want.items()}, abs=1e-9)
    for (s, v), r in got.items():
        if r["n_paths"] and s != v:
            b = J.Search(atoms, s, r["departure"], math.inf, traversal).label(v)
            assert (r["arrival"], r["hops"], r["n_paths"]) == (b.time, b.hops, b.count) and b.time - r["departure"] == r["latency"]


def test_the_shortest_way_counts_equal_costs(spark):
    net = log(spark, [("a", "b", 1, 1, 1, None), ("b", "d", 2, 2, 1, None), ("a", "c", 1, 1, 1, None), ("c", "d", 2, 2, 1, None), ("a", "d", 2, 2, 2, None), ("a", "d", 3, 3, 1, None)])
    got = {r["node"]: (r["cost"], r["arrival"], r["hops"], r["n_paths"]) for r in paths.paths(net, ["a"], "shortest").collect()}
    assert got["d"] == (1, 3, 1, 1)
    got = {r["node"]: (r["cost"], r["arrival"], r["hops"], r["n_paths"]) for r in paths.paths(net, ["a"], "shortest", upper=2.0).collect()}
    assert got["d"] == (2, 2, None, 3)


def with_presence(spark, rows, presence, **how):
    p = spark.createDataFrame([(v, float(a), float(b)) for v, a, b in presence], "node string, start double, end double")
    return log(spark, rows, presence=p, **how)


def test_a_source_sets_out_when_it_is_there(spark):
    net = with_presence(spark, [("a", "b", 5, 5, 1, None), ("c", "d", 0, 0, 1, None)], [("a", 4, 9)])
    got = {r["node"]: r for r in paths.paths(net, ["a"]).collect()}
    assert (got["b"]["departure"], got["b"]["arrival"], got["b"]["latency"]) == (4, 5, 1)
    assert {r["node"]: r["latency"] for r in paths.reachability(net).collect()}["a"] == 1
    assert paths.paths(net, ["a"], at=2.0).count() == 0  # not there at that time
    assert paths.paths(net, ["a"], at=5.0).count() == 2
    inside = {(r["time"], r["source"], r["node"]): r["distance"] for r in paths.temporal_distances(net, "latency", start=0.0, end=10.0, step=10.0).collect()}
    assert inside[0.0, "a", "b"] == 1


def test_contacts_are_entered_while_both_ends_are_there(spark):
    net = with_presence(spark, [("a", "b", 0, 10, 1, None), ("b", "c", 0, 10, 1, None)], [("b", 2, 4), ("b", 6, 8), ("c", 5, 9)])
    got = {r["node"]: (r["arrival"], r["hops"], r["n_paths"]) for r in paths.paths(net, ["a"]).collect()}
    assert got == {"a": (0, 0, 1), "b": (2, 1, 1), "c": (6, 2, 1)}
    back = {r["node"]: (r["departure"], r["attained"]) for r in paths.backward_paths(net, ["c"]).collect()}
    assert back["a"] == (8, False) and back["b"] == (8, False)
    crossing = {r["node"]: r["arrival"] for r in paths.paths(net, ["a"], traversal=1.5).collect()}
    assert crossing["b"] == 3.5 and crossing["c"] == 7.5


def test_momentary_presence(spark):
    net = with_presence(spark, [("a", "b", 0, 10, 1, None), ("a", "c", 3, 3, 1, None)], [("b", 4, 4), ("c", 3, 3)])
    assert {r["node"]: r["arrival"] for r in paths.paths(net, ["a"]).collect()} == {"a": 0, "b": 4, "c": 3}


def test_ways_end_with_observed_time(spark):
    net = log(spark, [("a", "b", 1, 1, 1, None), ("b", "c", 7, 7, 1, None)], observed=((0, 5),))
    assert {r["node"] for r in paths.paths(net, ["a"]).collect()} == {"a", "b"}


def test_no_latency_is_infinite_efficiency(spark):
    net = log(spark, [("a", "b", 0, 0, 1, None), ("b", "c", 0, 0, 1, None)])
    got = paths.window_efficiency(net, "latency", start=0.0, end=1.0, step=1.0).first()
    assert math.isinf(got["temporal_efficiency"]) and got["temporal_diameter"] == 0 and not got["connected"]
    one = with_presence(spark, [("a", "b", 0, 0, 1, None)], [("a", 0, 1), ("b", 0, 1)])
    rows = paths.window_efficiency(one, start=0.0, end=4.0, step=2.0).orderBy("time").collect()
    assert rows[1]["temporal_efficiency"] is None and rows[1]["connected"] is None


def test_ties_at_the_last_place_stay(spark):
    rows = spark.createDataFrame([("a", "closeness", 3.0), ("b", "closeness", 2.0), ("c", "closeness", 2.0), ("d", "closeness", 1.0)], "node string, measure string, value double")
    assert {r["node"] for r in paths.closest(rows, 2).collect()} == {"a", "b", "c"}


def test_routes_have_a_budget(spark):
    rows = [(a, b, t, t, 1, None) for a, b, t in [("a", "b", 1), ("a", "b", 2), ("a", "b", 3), ("b", "c", 4)]]
    assert paths.path_steps(log(spark, rows), ["a"]).filter("node = 'c'").count() == 3
    with pytest.raises(BudgetExceeded):
        paths.path_steps(log(spark, rows), ["a"], most=2)


def test_sessions_are_walls(spark):
    net = log(spark, [("a", "b", 1, 1, 1, "A"), ("b", "c", 2, 2, 1, "B"), ("a", "x", 4, 4, 1, "A"), ("x", "e", 8, 8, 1, "A"), ("a", "z", 7, 7, 1, "B"), ("z", "e", 8, 8, 1, "B")])
    got = {r["node"]: (r["arrival"], r["n_paths"]) for r in paths.paths(net, ["a"]).collect()}
    assert "c" not in got and got["e"] == (8, 2) and got["a"] == (1, 1)
    assert "c" in {r["node"] for r in paths.paths(net, ["a"], sessions="collapse").collect()}


def test_no_contacts_lead_nowhere(spark):
    net = log(spark, [("a", "b", 1, 1, 1, None)])
    none = net.with_(spells=net.spells.filter(F.lit(False)))
    got = paths.paths(none, at=0.0).collect()
    assert {(r["source"], r["node"]) for r in got} == {("a", "a"), ("b", "b")}
