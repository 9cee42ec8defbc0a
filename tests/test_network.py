"""Operators on hand-made networks with known answers."""

import math

import pytest
from pyspark.sql import functions as F

from kairograph.errors import BadInput, NeedsDirected, NoSessions
from kairograph.functions.timeops import infer_unit, resolve
from kairograph.operators import centrality, communities, crossbin, dynamics, edit, nulls, paths, results, sequences, snapshots
from kairograph.plans.grid import make_grid, n_bins
from kairograph.plans.network import merge_windows
from kairograph.sources import builders


def net_of(spark, rows, schema="from string, to string, start double, end double", **more):
    return builders.from_tables(spark.createDataFrame(rows, schema), **more)


def rows_of(df, *columns):
    return sorted(tuple(round(v, 9) if isinstance(v, float) and not math.isnan(v) else v for v in r) for r in df.select(*columns).collect())


@pytest.fixture(scope="module")
def triangle(spark):
    return net_of(spark, [("A", "B", 1.0, 4.0), ("B", "C", 2.0, 5.0), ("C", "A", 3.0, 6.0)])


def test_small_parts():
    assert merge_windows([(2, 3), (0, 1), (1, 2)]) == ((0.0, 3.0),)
    assert n_bins(0.3, 0.1) == 3 and n_bins(0.31, 0.1) == 4
    assert [infer_unit(x) for x in (60, 3600, 86400, 10 * 86400)] == ["seconds", "minutes", "hours", "days"]
    assert resolve(["Sender", "x"], "from") == "Sender"


def test_builders(spark):
    turns = spark.createDataFrame([("Ana", "t1", 1.0), ("Ben", "t1", 2.0), ("Ana", "t1", 4.0), ("Cy", "t1", 5.0), ("Dee", "t2", 1.0), ("Eli", "t2", 3.0), ("Eli", "t2", 6.0)], "actor string, group string, time double")
    assert rows_of(builders.turns_network(turns).spells, "from", "to", "start") == [("Ana", "Ben", 2.0), ("Ana", "Cy", 5.0), ("Ben", "Ana", 4.0), ("Dee", "Eli", 3.0)]
    meet = spark.createDataFrame([("x", "g", 1.0), ("y", "g", 3.0), ("z", "h", 2.0)], "actor string, group string, time double")
    assert rows_of(builders.network(meet).spells, "from", "to", "start", "end") == [("x", "y", 1.0, 3.0)]
    posts = spark.createDataFrame([("a", "b", 1.0, "t"), ("b", "a", 4.0, "t"), ("a", "a", 9.0, "t")], "sender string, receiver string, timestamp double, thread string")
    assert rows_of(builders.network(posts).spells, "from", "to", "start", "end") == [("a", "b", 1.0, 4.0), ("b", "a", 4.0, 4.0)]
    cast = builders.broadcast_network(meet)
    assert rows_of(cast.spells, "from", "to", "start") == [("x", "y", 1.0), ("y", "x", 3.0)]
    dates = spark.createDataFrame([("a", "b", "2024-01-01", "2024-01-03"), ("b", "c", "2024-01-02", "2024-01-09")], "from string, to string, start string, end string")
    dated = builders.network(dates)
    assert dated.unit == "days" and rows_of(dated.spells, "start", "end") == [(0.0, 2.0), (1.0, 8.0)]
    with pytest.raises(BadInput):
        net_of(spark, [("a", "b", 2.0, 1.0)])


def test_round_trip(spark, tmp_path, triangle):
    builders.write_network(triangle, str(tmp_path))
    assert rows_of(builders.read_network(spark, str(tmp_path)).spells, "from", "to") == [("A", "B"), ("B", "C"), ("C", "A")]


def test_grid_and_snapshots(triangle):
    g = make_grid(triangle)
    assert [(b.lo, b.closed) for b in g.bins] == [(1, False), (2, False), (3, False), (4, False), (5, True)]
    assert [r[2] for r in rows_of(snapshots.snapshot_summary(triangle), "time", "nodes", "ties")] == [1, 2, 3, 2, 1]
    m = {(r["time"], r["measure"]): r["value"] for r in snapshots.metrics(triangle, ["density", "transitivity", "triangles", "components"]).collect()}
    assert m[3.0, "density"] == 0.5 and m[3.0, "triangles"] == 1 and m[1.0, "components"] == 2 and m[1.0, "transitivity"] == 1
    with pytest.raises(NoSessions):
        snapshots.snapshots(triangle, sessions="separate")


def test_undirected_has_no_arcs(spark):
    net = net_of(spark, [("a", "b", 0.0, 1.0)], directed=False)
    with pytest.raises(NeedsDirected):
        snapshots.metrics(net, ["reciprocity"])
    with pytest.raises(NeedsDirected):
        sequences.motifs(net, 1)


def test_strength_share(spark):
    net = net_of(spark, [("A", "B", 0.0, 4.0, 8.0), ("A", "C", 1.5, 1.5, 3.0)], "from string, to string, start double, end double, weight double")
    got = centrality.centrality_series(net, ["strength"], mode="out", step=2.0).filter("node = 'A'")
    assert rows_of(got, "time", "value") == [(0.0, 7.0), (2.0, 4.0)]


def test_presence_and_observation(spark):
    presence = spark.createDataFrame([("A", 0.0, 2.0)], "node string, start double, end double")
    net = net_of(spark, [("A", "B", 0.0, 4.0), ("B", "C", 0.0, 4.0)], presence=presence, observed=((1.0, 3.0),))
    assert rows_of(net.fragments(), "from", "to", "start", "end") == [("A", "B", 1.0, 2.0), ("B", "C", 1.0, 3.0)]
    x = dynamics.exposure(net, window="all").first()
    assert x["occupied"] == 3.0 and x["risk"] == 1 * 6 + 1 * 2


def test_exact_density_by_change_points(triangle):
    x = dynamics.exposure(triangle, window="all").first()
    assert x["occupied"] == 9 and x["risk"] == 5 * 6 and x["temporal_density"] == pytest.approx(0.3)


def test_events_and_durations(triangle):
    e = rows_of(dynamics.events(triangle), "time", "formation", "dissolution", "active", "new_pairs")
    assert e[0] == (1.0, 1, 0, 1, 1) and e[-1] == (5.0, 0, 2, 1, 0)
    assert [r[3] for r in rows_of(dynamics.durations(triangle), "from", "to", "events", "union")] == [3.0, 3.0, 3.0]


def test_gaps_and_burstiness(spark):
    net = net_of(spark, [("A", "B", 0.0, 0.0), ("A", "B", 1.0, 1.0), ("A", "B", 2.0, 2.0), ("B", "C", 2.0, 2.0)])
    assert rows_of(dynamics.gaps(net, "pair"), "from", "index", "gap") == [("A", 1, 1.0), ("A", 2, 1.0)]
    b = {r["from"]: r for r in dynamics.burstiness(net, "pair").collect()}
    assert b["A"]["burstiness"] == -1 and b["B"]["burstiness"] is None and b["A"]["memory"] is None


def test_pshifts(spark):
    net = net_of(spark, [("A", "B", 1.0, 1.0), ("B", "A", 2.0, 2.0), ("C", "A", 3.0, 3.0), ("C", "B", 4.0, 4.0), ("C", "A", 5.0, 5.0), ("C", "B", 5.0, 5.0), ("A", "C", 6.0, 6.0)])
    got = {r["shift"]: r["count"] for r in sequences.pshifts(net).collect()}
    assert len(got) == 13
    assert {k: v for k, v in got.items() if v} == {"AB-BA": 1, "AB-XB": 1, "AB-AY": 1, "AB-A0": 1, "A0-XA": 1}


def test_event_graph(spark):
    net = net_of(spark, [("A", "B", 1.0, 1.0), ("B", "C", 2.0, 2.0), ("C", "D", 3.0, 3.0), ("A", "C", 4.0, 4.0), ("B", "D", 5.0, 5.0)])
    assert rows_of(sequences.event_graph(net), "via", "wait") == [("B", 1.0), ("B", 4.0), ("C", 1.0)]
    assert rows_of(sequences.event_graph(net, delta=2.0), "via", "wait") == [("B", 1.0), ("C", 1.0)]
    assert rows_of(sequences.event_graph(net, adjacency="next"), "via", "wait") == [("B", 1.0), ("C", 1.0)]


def test_event_graph_after(spark):
    """70 microseconds in days: more than rounding, less than ``after``."""
    t = 19_731.0
    net = net_of(spark, [("A", "B", t, t), ("B", "C", t + 8.1e-10, t + 8.1e-10), ("B", "D", t + 2e-9, t + 2e-9), ("B", "E", t + 0.5 + 2e-10, t + 0.5 + 2e-10)])
    graph = lambda **how: sorted(sequences.event_graph(net, **how).join(net.spells.select(F.col("raw_id").alias("second"), "to"), "second").toPandas().to)
    assert graph(delta=0.5) == ["C", "D", "E"]
    assert graph(delta=0.5, after=1e-9) == ["D"]
    assert graph(adjacency="next") == ["C"]
    assert graph(adjacency="next", after=1e-9) == ["D"]


def test_rates_without_idle_time(spark):
    """Both pairs are tied all through: what forms then forms at once."""
    net = net_of(spark, [("A", "B", 0.0, 2.0), ("B", "A", 0.0, 2.0), ("A", "B", 0.5, 1.0)])
    rows = dynamics.rates(net, step=1.0).orderBy("time").collect()
    assert [r.formation_rate for r in rows] == [None, None]
    rows = dynamics.rates(net, infinite=True, step=1.0).orderBy("time").collect()
    assert rows[0].formation_rate == math.inf and math.isnan(rows[1].formation_rate)


def test_motif_boundary(spark):
    net = net_of(spark, [("A", "B", 1.0, 1.0), ("B", "C", 2.0, 2.0), ("A", "C", 3.0, 3.0)])
    assert sequences.motifs(net, 2).count() == 40
    assert sequences.motifs(net, 2).agg(F.sum("count")).first()[0] == 1
    assert sequences.motifs(net, 1).agg(F.sum("count")).first()[0] == 0


@pytest.fixture(scope="module")
def sparse(spark):
    pairs = {0: ["AB", "CD", "AC", "EF"], 1: ["AB", "CD", "BE"], 3: ["AB", "EF", "CE", "DF"], 4: ["AB", "CD", "EF"]}
    return net_of(spark, [(p[0], p[1], float(t), t + 1.0) for t, ps in pairs.items() for p in ps], directed=False, observed=((0.0, 5.0),))


def test_turnover_with_an_empty_window(sparse):
    assert [v for _, v in rows_of(crossbin.turnover(sparse), "time", "volatility")] == [0.2, 0.2, round(4 / 15, 9), 0.2]
    assert crossbin.fluctuability(sparse).first()[0] == 0.5


def test_persistence_goldens(sparse):
    got = {r["node"]: r["overlap"] for r in crossbin.persistence(sparse, "node").collect()}
    want = {"A": 0.42677669529663687, "B": 0.42677669529663687, "C": 0.17677669529663687, "E": 0.17677669529663687}
    assert got["A"] == pytest.approx(want["A"]) and got["B"] == pytest.approx(want["B"]) and got["C"] == pytest.approx(want["C"])
    assert crossbin.persistence(sparse, "overall").first()[0] == pytest.approx(0.2723139127471974)


def test_segregation_goldens(spark, sparse):
    label = spark.createDataFrame([(v, "x" if v in "ABC" else "y") for v in "ABCDEF"], "node string, community string")
    assert [round(v, 4) for _, v in rows_of(crossbin.segregation(sparse, label), "time", "value")] == [0.7778, -0.1111, 0.0, 0.7778, 0.4444]


def test_similarity_forms(sparse):
    for method in ("jaccard", "overlap", "cosine", "hamming", "pearson"):
        got = {(r["time1"], r["time2"]): r["value"] for r in crossbin.similarity(sparse, method).collect()}
        assert len(got) == 25
        assert got[0.0, 1.0] == pytest.approx({"jaccard": 2 / 5, "overlap": 2 / 3, "cosine": 2 / math.sqrt(12), "hamming": 3, "pearson": (15 * 2 - 12) / math.sqrt(4 * 11 * 3 * 12)}[method])
    assert crossbin.phases(sparse, k=2).count() == 5


def test_paths_and_reach(spark):
    net = net_of(spark, [("A", "B", 1.0, 2.0), ("B", "C", 2.0, 3.0), ("C", "D", 3.0, 4.0), ("D", "E", 4.0, 5.0)])
    assert rows_of(paths.paths(net, ["A"]), "node", "arrival", "hops") == [("A", 1.0, 0), ("B", 1.0, 1), ("C", 2.0, 2), ("D", 3.0, 3), ("E", 4.0, 4)]
    assert rows_of(paths.arrivals(net, ["A"]), "node", "arrival") == [("A", 1.0), ("B", 1.0), ("C", 2.0), ("D", 3.0), ("E", 4.0)]
    r = {x["node"]: x for x in paths.reachability(net).collect()}
    assert r["A"]["reach_out"] == 4 and r["E"]["reach_in"] == 4 and r["E"]["reach_out"] == 0
    steps = paths.path_steps(net, ["A"])
    assert rows_of(paths.pathways(steps), "route", "n_hops")[-1] == ("A -> B -> C -> D -> E", 4)
    hops = rows_of(paths.path_network(steps), "from", "to", "weight")
    assert hops == [("A", "B", 4), ("B", "C", 3), ("C", "D", 2), ("D", "E", 1)]
    tree = {r["node"]: r["count"] for r in paths.path_trajectories(steps).collect()}
    assert tree["A@1.0"] == 4
    b = {r["node"]: r["value"] for r in paths.path_centrality(net, ["betweenness"]).collect()}
    assert b == {"A": 0, "B": 3, "C": 4, "D": 3, "E": 0}
    per_edge = {(r["from"], r["to"]): r["value"] for r in paths.edge_centrality(net).collect()}
    assert per_edge["B", "C"] == b["C"] + 2


def test_efficiency_chain(spark):
    net = net_of(spark, [("A", "B", 0.0, 1.0), ("B", "C", 1.0, 2.0), ("C", "D", 2.0, 3.0)])
    got = paths.distance_summary(net).first()
    assert got["temporal_efficiency"] == pytest.approx(13 / 36) and got["temporal_diameter"] == 3


def test_katz(spark):
    net = net_of(spark, [("A", "B", 0.0, 0.0), ("B", "C", 1.0, 1.0)])
    assert rows_of(paths.stream_centrality(net, "katz", beta=0.3), "node", "value") == [("A", 0.0), ("B", 0.3), ("C", 0.39)]
    assert paths.stream_centrality(net, "pagerank").agg(F.sum("value")).first()[0] == pytest.approx(1)


def test_mixing(spark):
    nodes = spark.createDataFrame([("a1", "A"), ("a2", "A"), ("b1", "B"), ("b2", "B")], "name string, g string")
    net = net_of(spark, [(u, v, 0.0, 0.0) for u, v in (("a1", "a2"), ("a1", "b1"), ("a2", "b1"), ("b1", "a1"), ("b1", "b2"))], nodes=nodes)
    assert rows_of(snapshots.mixing(net, "g", window="all"), "from_group", "to_group", "ties") == [("A", "A", 1), ("A", "B", 2), ("B", "A", 1), ("B", "B", 1)]


def test_communities(spark):
    rows = [(a, b, float(t), t + 1.0) for t in (0, 1) for g in ("ABCD", "EFGH") for i, a in enumerate(g) for b in g[i + 1 :]]
    net = net_of(spark, rows, directed=False, observed=((0.0, 2.0),))
    member, runs = communities.temporal_communities(net, [1, 2])
    assert member.select("community").distinct().count() == 2 and runs.filter("best").count() == 1
    q = crossbin.multislice_modularity(net, member).first()
    assert q["q"] == pytest.approx(q["q_intra"] + q["q_inter"]) and q["q"] == pytest.approx(runs.filter("best").first()["q"])
    matched, happened = communities.match_communities(communities.snapshot_communities(net))
    assert {r["event"] for r in happened.collect()} == {"born", "persist"}
    assert communities.community_trajectory(matched).agg(F.max("flexibility")).first()[0] == 0
    assert {r["measure"]: r["value"] for r in communities.community_change(matched).collect()}["nmi"] == pytest.approx(1)
    share = communities.allegiance(matched).filter("node1 <> node2").groupBy("value").count().collect()
    assert {r["value"]: r["count"] for r in share} == {1.0: 24, 0.0: 32}


@pytest.mark.parametrize("model", nulls.MODELS)
def test_null_models_keep_what_they_should(spark, triangle, model):
    got = nulls.randomise(triangle, model, n=2, seed=3)
    assert got.count() == 6
    if model in ("times", "timeline", "edges", "labels", "targets"):
        assert rows_of(got.filter("replicate = 1").select((F.col("end") - F.col("start")).alias("d")), "d") == [(3.0,)] * 3
    if model == "targets":
        assert rows_of(got.filter("replicate = 1"), "to") == [("A",), ("B",), ("C",)]
    assert sorted(map(str, got.collect())) == sorted(map(str, nulls.randomise(triangle, model, n=2, seed=3).collect()))


def test_null_summary(spark):
    seen = spark.createDataFrame([("a", 5.0), ("b", 0.0)], "k string, observed double")
    null = spark.createDataFrame([("a", float(i)) for i in range(4)] + [("b", 0.0)] * 4, "k string, null double")
    got = {r["k"]: r for r in nulls.summarise_null(seen, null, ["k"], "greater").collect()}
    assert got["a"]["p"] == 0.2 and got["b"]["p"] == 1 and got["a"]["p_adj"] == 0.4 and got["b"]["n_ties"] == 4


def test_generators(spark):
    net = nulls.random_network(spark, 10, 5, 0.3)
    assert net.nodes.count() == 10 and not net.spells.isEmpty()
    assert not nulls.random_network(spark, 8, 6, birth=0.3, persist=0.7).spells.isEmpty()
    assert nulls.renewal_network(spark, 6, 1.0, 5.0).spells.filter("start > 5").isEmpty()


def test_edits(spark, triangle):
    more = edit.add_ties(triangle, spark.createDataFrame([("A", "C", 9.0, 10.0)], "from string, to string, start double, end double"))
    assert more.span() == (1.0, 10.0)
    with pytest.raises(BadInput):
        edit.add_ties(triangle, spark.createDataFrame([("A", "Q", 9.0, 10.0)], "from string, to string, start double, end double"))
    with pytest.raises(BadInput):
        edit.remove_nodes(triangle, ["A"])
    assert edit.remove_nodes(triangle, ["A"], cascade=True).spells.count() == 1
    assert edit.remove_ties(triangle, source="A").spells.count() == 2
    with pytest.raises(BadInput):
        edit.remove_ties(triangle, source="Z")
    assert rows_of(edit.rename_nodes(triangle, {"A": "B", "B": "A"}).spells, "from", "to") == [("A", "C"), ("B", "A"), ("C", "B")]
    assert edit.update_ties(triangle, "`from` = 'A'", {"end": 9.0}).span()[1] == 9
    assert edit.induce_subgraph(triangle, nodes="name <> 'C'").spells.count() == 1
    split = edit.set_tie_sessions(triangle, breaks=[2.0])
    assert rows_of(split.spells, "from", "session") == [("A", "1"), ("B", "2"), ("C", "2")]
    assert rows_of(edit.rename_sessions(split, {"2": "x"}).spells, "session") == [("1",), ("x",), ("x",)]
    assert edit.set_vertex_spells(triangle, "ties").presence.count() == 3
    assert edit.clear_observations(edit.set_observations(triangle, start=2, end=3)).observed is None
    nodes = edit.update_nodes(triangle, spark.createDataFrame([("A", 7)], "name string, x int"))
    assert rows_of(nodes.nodes.filter("x is not null"), "name", "x") == [("A", 7)]


def test_results(triangle):
    r = centrality.centrality_series(triangle, ["degree"])
    assert len(results.widen(r).columns) == 2 + 5
    assert results.top_nodes(r, 1).select("node").distinct().count() == 1
    assert results.summarise(r).count() == 3
    for what in ("edges", "observed_edges", "nodes", "bins", "observations", "vertex_spells"):
        results.tidy(triangle, what).collect()
    assert [t[1:] for t in rows_of(results.animation_bins(triangle), "time", "ties", "forming", "dissolving")] == [(1, None, 0), (2, 1, 0), (3, 1, 1), (2, 0, 1), (1, 0, None)]


def test_censoring(spark):
    net = net_of(spark, [("A", "B", 0.0, 1.0, True, False), ("A", "B", 2.0, 3.0, False, True)], "from string, to string, start double, end double, onset_censored boolean, terminus_censored boolean")
    assert rows_of(dynamics.events(net), "formation", "dissolution", "new_pairs")[0] == (0, 0, 0)
    assert dynamics.events(net).agg(F.sum("formation"), F.sum("dissolution"), F.sum("new_pairs")).first()[:] == (1, 1, 0)
