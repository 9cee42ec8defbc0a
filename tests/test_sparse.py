"""Measures by joins against dense kernels, and windows and vertices that are not there."""

import math
import random

import numpy as np
import pytest

from kairograph.functions.labels import components
from kairograph.operators import centrality, communities, kernels, sequences, snapshots
from kairograph.sources import builders

SPELLS = "from string, to string, start double, end double, weight double, session string"


def network(spark, seed, directed=True, n=9, ties=40, **how):
    r = random.Random(seed)
    rows = [(*(f"v{i}" for i in r.sample(range(n), 2)), float(t := r.randint(0, 2)), float(t), 1.0, r.choice("xy")) for _ in range(ties)]
    return builders.from_tables(spark.createDataFrame(rows, SPELLS), check=False, directed=directed, **how)


def matrices(net, names, **grid):
    out = {}
    for r in snapshots.snapshots(net, **grid).collect():
        b = out.setdefault(r["time"], np.zeros((len(names), len(names))))
        b[names.index(r["from"]), names.index(r["to"])] = 1
        if not net.directed:
            b[names.index(r["to"]), names.index(r["from"])] = 1
    return out


@pytest.mark.parametrize("directed", [True, False])
def test_census_cores_and_components(spark, directed):
    net = network(spark, 3, directed)
    names = sorted(r["name"] for r in net.nodes.collect())
    grid = {"start": 0.0, "end": 3.0, "step": 1.0, "window": 1.0}
    dense = matrices(net, names, **grid)
    got = {(r["time"], r["measure"]): r["value"] for r in snapshots.metrics(net, ["triads", "components", "largest_component", "connectedness", "efficiency"], **grid).collect()}
    core = {(r["time"], r["node"]): r["value"] for r in centrality.centrality_series(net, ["coreness"], **grid).collect()}
    for t, b in dense.items():
        want = kernels.graph_measures(b, directed)
        assert [got[t, f"triad_{c}"] for c in kernels.TRIADS] == kernels.triads(b).tolist()
        assert [got[t, m] for m in ("components", "largest_component", "connectedness")] == pytest.approx([want[m] for m in ("components", "largest_component", "connectedness")])
        assert got[t, "efficiency"] == pytest.approx(want["efficiency"], nan_ok=True)
        assert [core[t, v] for v in names] == kernels.coreness(b, "all" if directed else "out").tolist()


def test_windows_and_vertices_that_are_not_there(spark):
    rows = [("a", "b", 0.0, 0.5, 1.0, None), ("b", "c", 0.0, 0.5, 1.0, None)]
    presence = spark.createDataFrame([(v, 0.0, 1.0) for v in "abc"], "node string, start double, end double")
    net = builders.from_tables(spark.createDataFrame(rows, SPELLS), check=False, presence=presence)
    grid = {"start": 0.0, "end": 4.0, "step": 2.0}
    got = {(r["time"], r["measure"]): r["value"] for r in snapshots.metrics(net, list(snapshots.KERNEL), **grid).collect()}
    empty = {m: v for (t, m), v in got.items() if t == 2.0}
    assert len(empty) == 27 and empty["components"] == empty["components_strong"] == empty["efficiency"] == empty["triad_003"] == 0 and empty["connectedness"] == 1
    assert empty["mean_distance"] is None and math.isnan(empty["hierarchy"])
    series = {(r["time"], r["node"], r["measure"]): r["value"] for r in centrality.centrality_series(net, ["degree", "closeness"], ["all", "in"], **grid).collect()}
    assert {m for _, _, m in series} == {"degree", "degree_in", "closeness", "closeness_in"} and len(series) == 36
    assert all((v is None) == (t >= 2.0) for (t, _, _), v in series.items())
    assert series[0.0, "b", "degree"] == 2 and series[0.0, "b", "degree_in"] == 1


def test_components_of_long_chains_and_stars(spark):
    edges = [("p", i, i + 1) for i in range(300)] + [("q", 0, i) for i in range(1, 200)] + [("q", 500, 501), ("q", 501, 500)]
    got = components(spark.createDataFrame(edges, "k string, a long, b long"), ["k"]).collect()
    assert {(r["k"], r["label"]) for r in got} == {("p", 0), ("q", 0), ("q", 500)} and len(got) == 301 + 200 + 2


def test_relay_chains_are_components(spark):
    log = [("a", "b", 1.0), ("b", "c", 2.0), ("b", "d", 3.0), ("x", "y", 1.0), ("e", "b", 1.5)]
    net = builders.from_tables(spark.createDataFrame([(a, b, t, t, 1.0, None) for a, b, t in log], SPELLS), check=False)
    events = sequences.event_graph_events(net)
    got = {(r["from"], r["to"][0]): r["size"] for r in sequences.event_chains(events, sequences.event_graph(net)).join(events, "event").collect()}
    assert got == {("a", "b"): 4, ("b", "c"): 4, ("b", "d"): 4, ("e", "b"): 4, ("x", "y"): 1}
    assert {r["size"] for r in sequences.event_chains(events, sequences.event_graph(net, delta=0.1)).collect()} == {1}


def test_allegiance_has_all_pairs(spark):
    member = spark.createDataFrame([(t, v, c) for t, cs in ((1.0, "xxy"), (2.0, "xyy")) for v, c in zip("abc", cs, strict=True)], "time double, node string, community string")
    got = {(r["node1"], r["node2"]): r["value"] for r in communities.allegiance(member).collect()}
    assert len(got) == 9 and got["a", "b"] == 0.5 and got["a", "c"] == 0 and got["a", "a"] is None


def test_groupings_of_all_that_either_window_has(spark):
    rows = [(1.0, "a", "x"), (1.0, "b", "x"), (1.0, "c", "y"), (1.0, "d", "y"), (2.0, "a", "x"), (2.0, "b", "x"), (2.0, "c", "y"), (2.0, "e", "y"), (3.0, "e", "z")]
    got = {(r["time"], r["measure"]): r["value"] for r in communities.community_change(spark.createDataFrame(rows, "time double, node string, community string"), ["nmi", "ami", "uami"]).collect()}
    wide = communities.compare_groupings(np.array([[2.0, 0, 0], [0, 1, 1], [0, 1, 0]]))["ami"]  # x, y and the absent, then and now
    assert got[2.0, "nmi"] == got[2.0, "ami"] == 1 and got[2.0, "uami"] == pytest.approx(wide) and wide < 1
    assert got[3.0, "nmi"] is None or math.isnan(got[3.0, "nmi"])


@pytest.mark.parametrize("second,busy", [((2.0, 4.0), 0), ((2.0, 2.0), 1), ((1.0, 4.0), 1), ((0.0, 0.0), 1), ((2.5, 2.5), 0)])
def test_who_has_two_neighbours_at_once(spark, second, busy):
    rows = [("a", "b", 0.0, 2.0, 1.0, None), ("b", "a", 1.0, 2.0, 1.0, None), ("a", "c", *second, 1.0, None)]
    net = builders.from_tables(spark.createDataFrame(rows, SPELLS), check=False)
    assert snapshots.metrics(net, ["concurrent_nodes"], start=0.0, end=0.0, step=10.0, window=10.0).first()["value"] == busy


def test_components_of_a_long_chain_take_few_rounds(spark, monkeypatch):
    from kairograph.functions import labels

    stages = []
    kept = labels.keep
    monkeypatch.setattr(labels, "keep", lambda df, name: stages.append(name) or kept(df, name))
    r = random.Random(4)
    names = r.sample(range(10**9), 300)
    edges = [*zip(names, names[1:]), (-1, -1), (-5, -4)]
    got = {x["node"]: x["label"] for x in components(spark.createDataFrame(edges, "a long, b long"), []).collect()}
    assert got == dict.fromkeys(names, min(names)) | {-1: -1, -4: -5, -5: -5}
    assert len(stages) < 60  # a label that goes from neighbour to neighbour takes a stage for each step


def test_rounds_of_cores_collect_nothing(spark, monkeypatch):
    from kairograph.operators import sparse

    plans = []
    kept = sparse.keep
    monkeypatch.setattr(sparse, "keep", lambda df, name: plans.append(df._jdf.queryExecution().executedPlan().toString()) or kept(df, name))
    arcs = spark.createDataFrame([(0, a, b) for a in range(4) for b in range(4) if a != b] + [(0, 4, 0), (0, 0, 4)], "bin int, v long, w long")
    assert {r["v"]: r["core"] for r in sparse.coreness(arcs, ["bin"]).collect()} == {0: 3, 1: 3, 2: 3, 3: 3, 4: 1}
    assert not any("BroadcastHashJoin" in p for p in plans)
