"""Time-respecting paths, reachability, and centralities built on them."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import pairwise

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kairograph.errors import BadInput, BudgetExceeded, UnknownMeasure
from kairograph.operators import journeys as J
from kairograph.operators import rounds as R
from kairograph.operators import streams as S
from kairograph.plans.network import Network
from kairograph.plans.storage import keep

#: Contacts that are sent to every task, for ways that are counted one by one.
MAX_ATOMS = 2_000_000
CRITERIA = ("foremost_then_shortest", "min_hops", "foremost", "shortest", "fastest", "latest_departure")


def _bounds(net: Network, at: float | None, upper: float) -> tuple[float, float]:
    """A search's window: from ``at`` or the network's first time, to ``upper`` or the end of observed time."""
    if net.observed and upper == math.inf:
        upper = net.observed[-1][1]
    return (net.span()[0] if at is None else float(at)), upper


@dataclass
class _Ways:
    """Contacts of a network, and searches over them."""

    net: Network
    sessions: str
    traversal: float = 0.0

    def __post_init__(self) -> None:
        # Vertices may come from the whole log; here their names are asked for again and again.
        self.net = self.net.with_(nodes=keep(self.net.nodes.select("name"), "names"))
        self.atoms = R.contacts(self.net, self.sessions, self.traversal)

    def origins(self, anchor: DataFrame, key: Column, limit: Column, forward: bool = True) -> DataFrame:
        """States without hops in each session in which an origin has contacts."""
        near = "from" if forward else "to"
        walls = self.atoms.select("wall", F.col(near).alias("node")).distinct()
        exact = F.col("exact") if "exact" in anchor.columns else F.lit(1)
        rows = anchor.select(key.alias("key"), F.col("name").alias("node"), "time", exact.alias("exact"), limit.alias("limit"))
        return rows.join(walls, "node", "left").withColumns({"wall": F.coalesce("wall", F.lit("")), "count": F.lit(1.0)})

    def search(self, origins: DataFrame, forward: bool = True, arcs: bool = False) -> R.Search:
        return R.explore(origins, self.atoms, self.traversal, forward, self.net.presence is not None, arcs)

    def forward(self, sources: list[str] | None, at: float | None, upper: float, arcs: bool = False) -> R.Search:
        lower, upper = _bounds(self.net, at, upper)
        anchor = R.anchors(self.net, R.window(self.net, lower, upper), at, True, sources)
        return self.search(self.origins(anchor, F.col("name"), F.col("upper")), True, arcs)


def _begins(search: R.Search) -> DataFrame:
    return search.layers[0].select(F.col("key"), F.col("time").alias("begin")).distinct()


def _one_by_one(net: Network, sessions: str, sources: list[str] | None, at: float | None, upper: float, fn: Callable[[str, float, list], Iterator[tuple]], schema: str) -> DataFrame:
    """``fn(source, begin, contacts by session)`` in parallel over sources; contacts are broadcast up to a checked number."""
    spark = net.spells.sparkSession
    rows = R.contacts(net, sessions).select("wall", "from", "to", "lo", "hi", "weight").limit(MAX_ATOMS + 1).collect()
    if len(rows) > MAX_ATOMS:
        raise BudgetExceeded(f"more than {MAX_ATOMS} contacts")
    walls: dict = {}
    for r in rows:
        walls.setdefault(r["wall"], []).append(tuple(r)[1:])
    sent = spark.sparkContext.broadcast(sorted((w, J.index(a, True)) for w, a in walls.items()))
    names = [s.split(" ")[0] for s in schema.split(", ")]
    start = R.anchors(net, R.window(net, *_bounds(net, at, upper)), at, True, sources).select("name", "time")
    start = start.repartition(max(2, spark.sparkContext.defaultParallelism), "name")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame([r for s, t in zip(pdf["name"], pdf["time"], strict=True) for r in fn(s, t, sent.value)], columns=names)

    return start.mapInPandas(run, schema)


PATHS = "source string, node string, departure double, arrival double, latency double, hops long, n_paths double, cost double"


def paths(net: Network, sources: list[str] | None = None, criterion: str = "foremost_then_shortest", at: float | None = None, upper: float = math.inf, traversal: float = 0.0, sessions: str = "bounded", cost: str = "weight", deadline: float | None = None) -> DataFrame:
    """``source, node, departure, arrival, latency, hops, n_paths, cost`` of every vertex reached.

    Sessions are walls: each is searched by itself and the best way stays; ways that
    are as good add up.  A source sets out at ``at``, which it must be there for, or else
    at its first moment in the window.  Where no way attains an optimum but ways come
    arbitrarily near it, ``hops`` is null and ``n_paths`` 0 (latest_departure).
    """
    if criterion not in CRITERIA:
        raise UnknownMeasure(criterion)
    if criterion == "foremost":
        return _searched_paths(net, sources, at, upper, traversal, sessions)
    ways = _Ways(net, sessions, traversal)
    if criterion == "fastest":
        return _fastest(ways, sources, at, upper)
    if criterion == "latest_departure":
        return _latest(ways, sources, at, upper, deadline)
    lower, upper = _bounds(net, at, upper)
    if criterion == "shortest":
        anchor = R.anchors(ways.net, R.window(net, lower, upper), at, True, sources)
        origins = ways.origins(anchor, F.col("name"), F.col("upper"))
        best = R.cheapest(origins, ways.atoms, cost, traversal, net.presence is not None)
        begin = anchor.select(F.col("name").alias("key"), F.col("time").alias("begin"))
    else:
        found = ways.forward(sources, at, upper)
        best, begin = found.best(criterion), _begins(found)
        best = best.withColumn("cost", F.col("hops").cast("double") if criterion == "min_hops" else F.col("time"))
    own = F.col("key") == F.col("node")
    return best.join(begin, "key").select(F.col("key").alias("source"), "node", F.col("begin").alias("departure"), F.col("time").alias("arrival"), (F.col("time") - F.col("begin")).alias("latency"), "hops", F.when(own, 1.0).otherwise(F.col("count")).alias("n_paths"), "cost")


def _latest(ways: _Ways, sources: list[str] | None, at: float | None, upper: float, deadline: float | None) -> DataFrame:
    """Latest departures that meet a deadline; from each, the earliest arrival and the ways that make it."""
    net = ways.net
    lower, _ = _bounds(net, at, upper)
    end = net.span()[1] if deadline is None else float(deadline)
    back = ways.search(ways.origins(R.anchors(net, R.window(net, lower, end), end, False), F.col("name"), F.lit(lower), False), False).best()
    leave = back.select(F.col("node").alias("name"), F.col("key").alias("target"), "time", "exact", F.lit(end).alias("by"))
    if sources is not None:
        leave = leave.filter(F.col("name").isin(list(sources)))
    out = _leaving(ways, keep(leave, "departures"))
    return out.select("source", "node", "departure", "arrival", (F.col("arrival") - F.col("departure")).alias("latency"), "hops", "n_paths", (-F.col("departure")).alias("cost"))


def _leaving(ways: _Ways, leave: DataFrame) -> DataFrame:
    """``source, node, departure, arrival, hops, n_paths`` of the earliest ways from a departure of each pair.

    ``leave`` has ``name, target, time, exact`` and ``by``, when the target is reached
    at the latest; a departure that is only approached has an arrival, but no way that
    makes it.
    """
    origins = ways.origins(leave, F.struct("name", "target"), F.col("by"))
    best = ways.search(origins).best().filter("node = key.target").select("key", "node", F.col("time").alias("arrival"), "hops", "count")
    out = best.join(leave.select(F.struct("name", "target").alias("key"), "time", "exact"), "key")
    attained = F.col("exact") == 1
    n = F.when(F.col("key.name") == F.col("node"), 1.0).when(attained, F.col("count")).otherwise(0.0)
    return out.select(F.col("key.name").alias("source"), "node", F.col("time").alias("departure"), "arrival", F.when(attained, F.col("hops")).alias("hops"), n.alias("n_paths"))


def _fastest(ways: _Ways, sources: list[str] | None, at: float | None, upper: float) -> DataFrame:
    """Ways that take least time, whenever they begin; a vertex is with itself from its beginning."""
    lower, upper = _bounds(ways.net, at, upper)
    anchor = keep(R.anchors(ways.net, R.window(ways.net, lower, upper), at, True, sources), "anchors")
    best = keep(R.spans(ways.origins(anchor, F.col("name"), F.col("upper")), ways.atoms, ways.traversal), "spans")
    leave = best.select(F.col("key").alias("name"), F.col("node").alias("target"), F.col("departure").alias("time"), "exact", F.col("arrival").alias("by"))
    out = _leaving(ways, leave).join(best.select(F.col("key").alias("source"), "node", "duration"), ["source", "node"])
    out = out.select("source", "node", "departure", "arrival", F.col("duration").alias("latency"), "hops", "n_paths", F.col("duration").alias("cost"))
    zero = F.lit(0.0)
    own = anchor.select(F.col("name").alias("source"), F.col("name").alias("node"), F.col("time").alias("departure"), F.col("time").alias("arrival"), zero.alias("latency"), F.lit(0).cast("long").alias("hops"), F.lit(1.0).alias("n_paths"), zero.alias("cost"))
    return out.unionByName(own)


def _searched_paths(net: Network, sources: list[str] | None, at: float | None, upper: float, traversal: float, sessions: str) -> DataFrame:
    """Earliest ways counted one by one, in a search of its own for each source, up to a number of states."""
    _, upper = _bounds(net, at, upper)

    def fn(source: str, begin: float, walls: list) -> Iterator[tuple]:
        best: dict[str, tuple] = {source: (source, source, begin, begin, 0.0, 0, 1.0, begin)}
        for _, atoms in walls:
            found = J.Search(atoms, source, begin, upper, traversal)
            for v in found.best:
                if v == source or not (b := found.label(v)):
                    continue
                row = (source, v, begin, b.time, b.time - begin, b.hops, float(J.foremost_count(atoms, source, begin, v, upper)), b.time)
                old = best.get(v)
                if old is None or b.time < old[3]:
                    best[v] = row
                elif b.time == old[3]:
                    best[v] = (*old[:6], old[6] + row[6], old[7])
        yield from best.values()

    return _one_by_one(net, sessions, sources, at, upper, fn, PATHS)


def backward_paths(net: Network, targets: list[str] | None = None, deadline: float | None = None, lower: float = -math.inf, traversal: float = 0.0, sessions: str = "bounded") -> DataFrame:
    """``target, node, departure, attained, hops, n_paths``: the latest departures that still reach a target.

    ``attained`` is false where ways come arbitrarily near a departure that none has.
    """
    if net.observed and lower == -math.inf:
        lower = net.observed[0][0]
    end = net.span()[1] if deadline is None else float(deadline)
    ways = _Ways(net, sessions, traversal)
    anchor = R.anchors(ways.net, R.window(net, lower, end), deadline, False, targets)
    best = ways.search(ways.origins(anchor, F.col("name"), F.col("lower"), False), False).best()
    n = F.when(F.col("key") == F.col("node"), 1.0).otherwise(F.col("count"))
    return best.select(F.col("key").alias("target"), "node", F.col("time").alias("departure"), (F.col("exact") == 1).alias("attained"), "hops", n.alias("n_paths"))


def path_steps(net: Network, sources: list[str] | None = None, criterion: str = "foremost_then_shortest", at: float | None = None, upper: float = math.inf, sessions: str = "bounded", most: int = 1_000_000) -> DataFrame:
    """``source, node, route, times``: every best way as arrays of vertices and times."""
    found = _Ways(net, sessions).forward(sources, at, upper, True)
    return found.routes(found.best(criterion).filter("key <> node"), most).withColumnRenamed("key", "source")


def arrivals(net: Network, sources: list[str] | None = None, at: float | None = None, upper: float = math.inf) -> DataFrame:
    """``source, node, arrival`` alone, sessions collapsed: one number for each pair, no counts.

    Each round joins the vertices whose arrival improved with the ties that leave
    them; rounds end when nothing improves, after as many as the longest way has hops.
    """
    return _arrivals(net, sources, at, upper)[1]


def _arrivals(net: Network, sources: list[str] | None, at: float | None, upper: float) -> tuple[DataFrame, DataFrame]:
    lower, upper = _bounds(net, at, upper)
    atoms = R.contacts(net, "collapse").select("from", "to", "lo", "hi", "closed")
    begin = R.anchors(net, R.window(net, lower, upper), at, True, sources).select(F.col("name").alias("source"), F.col("time").alias("begin"))
    known = keep(begin.select("source", F.col("source").alias("node"), F.col("begin").alias("arrival")), "known")
    front = known
    while True:
        entry = F.greatest("arrival", "lo")
        moved = front.join(atoms, front["node"] == atoms["from"]).withColumn("t", entry)
        moved = moved.filter(((F.col("t") < F.col("hi")) | (F.col("t") == F.col("hi")) & F.col("closed")) & (F.col("t") <= upper)).groupBy("source", F.col("to").alias("node")).agg(F.min("t").alias("arrival"))
        old = known.withColumnRenamed("arrival", "old")
        front = keep(moved.join(old, ["source", "node"], "left").filter("old is null or arrival < old").select("source", "node", "arrival"), "front")
        if front.isEmpty():
            return begin, known
        known = keep(known.unionByName(front).groupBy("source", "node").agg(F.min("arrival").alias("arrival")), "known")


def reachability(net: Network, at: float | None = None, upper: float = math.inf) -> DataFrame:
    """``node, reach_out, reach_in, share_out, share_in, latency``: whom a vertex reaches and who reaches it; latency from its own beginning."""
    begin, known = _arrivals(net, None, at, upper)
    a = known.filter("source <> node").join(begin, "source")
    n = net.nodes.count()
    out = a.groupBy(F.col("source").alias("node")).agg(F.count("*").alias("reach_out"), F.avg(F.col("arrival") - F.col("begin")).alias("latency"))
    into = a.groupBy("node").agg(F.count("*").alias("reach_in"))
    rows = net.nodes.select(F.col("name").alias("node")).join(out, "node", "left").join(into, "node", "left")
    most = float(max(1, n - 1))
    zero = lambda c: F.coalesce(c, F.lit(0))
    return rows.select("node", zero("reach_out").alias("reach_out"), zero("reach_in").alias("reach_in"), (zero("reach_out") / most).alias("share_out"), (zero("reach_in") / most).alias("share_in"), "latency")


def pathways(steps: DataFrame, top: int | None = None, min_hops: int = 1) -> DataFrame:
    """``route, n_hops, count, share, arrival`` of vertex sequences, most frequent first."""
    g = steps.filter(F.size("route") > min_hops).groupBy(F.array_join("route", " -> ").alias("route")).agg(F.first(F.size("route") - 1).alias("n_hops"), F.count("*").alias("count"), F.min(F.element_at("times", -1)).alias("arrival"))
    total = steps.filter(F.size("route") > min_hops).agg(F.count("*").alias("total"))
    out = g.crossJoin(total).select("route", "n_hops", "count", (F.col("count") / F.greatest("total", F.lit(1))).alias("share"), "arrival")
    return out.orderBy(F.desc("count"), "n_hops", "route").limit(top) if top else out


def path_network(steps: DataFrame) -> DataFrame:
    """``from, to, weight, first, last, n_endpoints``: hops of all routes put together."""
    hop = steps.select("source", "node", F.posexplode(F.slice("route", 2, F.greatest(F.size("route") - 1, F.lit(0)))).alias("i", "to"), "route", "times")
    hop = hop.select(F.element_at("route", F.col("i") + 1).alias("from"), "to", F.element_at("times", F.col("i") + 2).alias("t"), "node")
    return hop.groupBy("from", "to").agg(F.count("*").alias("weight"), F.min("t").alias("first"), F.max("t").alias("last"), F.countDistinct("node").alias("n_endpoints"))


def path_trajectories(steps: DataFrame, min_count: int = 1) -> DataFrame:
    """``prefix, parent, node, depth, count, probability``: the tree of timed beginnings of routes."""
    token = F.transform(F.arrays_zip("route", "times"), lambda x: F.concat(x["route"], F.lit("@"), x["times"].cast("string")))
    p = steps.select(token.alias("k"), F.explode(F.sequence(F.lit(1), F.size("route"))).alias("depth"))
    p = p.select(F.array_join(F.slice("k", 1, F.col("depth")), ">").alias("prefix"), F.when(F.col("depth") > 1, F.array_join(F.slice("k", 1, F.col("depth") - 1), ">")).alias("parent"), F.element_at("k", F.col("depth")).alias("node"), "depth")
    n = p.groupBy("prefix", "parent", "node", "depth").agg(F.count("*").alias("count")).filter(F.col("count") >= min_count)
    up = n.select(F.col("prefix").alias("parent"), F.col("count").alias("above"))
    return n.join(up, "parent", "left").select("prefix", "parent", "node", "depth", "count", (F.col("count") / F.col("above")).alias("probability"))


def path_centrality(net: Network, measures: list[str], criterion: str = "foremost_then_shortest", at: float | None = None, upper: float = math.inf, sessions: str = "bounded", mode: str = "out") -> DataFrame:
    """``node, measure, value`` for closeness, betweenness and efficiency over best ways; one search serves all.

    ``mode`` "in" takes the ways that end at a vertex, for closeness and efficiency.
    """
    if mode not in ("out", "in"):
        raise BadInput("mode is out or in")
    if "betweenness" in measures and criterion not in ("foremost_then_shortest", "min_hops"):
        raise BadInput("betweenness counts ways that are earliest, or have the fewest hops")
    ways = _Ways(net, sessions)
    names = ways.net.nodes
    n = names.count()
    side = "source" if mode == "out" else "node"
    found = best = None
    if criterion in ("foremost_then_shortest", "min_hops") or "efficiency" in measures:
        found = ways.forward(None, at, upper, "betweenness" in measures)
        best = keep(found.best(criterion if criterion == "min_hops" else "foremost_then_shortest"), "best")
    parts = []
    for m in measures:
        if m == "closeness":
            if criterion in ("foremost_then_shortest", "min_hops"):
                rows = best.join(_begins(found), "key").select(F.col("key").alias("source"), "node", (F.col("hops").cast("double") if criterion == "min_hops" else F.col("time") - F.col("begin")).alias("d"))
            else:
                rows = paths(net, None, criterion, at, upper, sessions=sessions).select("source", "node", (F.col("latency") if criterion != "shortest" else F.col("cost")).alias("d"))
            got = rows.filter("source <> node").groupBy(F.col(side).alias("node")).agg(F.avg("d").alias("d")).select("node", F.when(F.col("d") > 0, 1 / F.when(F.col("d") > 0, F.col("d")).otherwise(1.0)).otherwise(float("inf")).alias("value"))
        elif m == "efficiency":
            rows = found.best("min_hops").select(F.col("key").alias("source"), "node", "hops").filter("source <> node")
            got = rows.groupBy(F.col(side).alias("node")).agg((F.sum(1 / F.col("hops")) / max(1, n - 1)).alias("value"))
        elif m == "betweenness":
            got = found.shares(best)[0]
        else:
            raise UnknownMeasure(m)
        base = names.select(F.col("name").alias("node"))
        nothing = F.lit(None).cast("double") if m == "efficiency" and n < 2 else F.lit(0.0)
        parts.append(base.join(got, "node", "left").select("node", F.lit(m).alias("measure"), F.coalesce("value", nothing).alias("value")))
    return R.union(parts)


def edge_centrality(net: Network, at: float | None = None, upper: float = math.inf, sessions: str = "bounded") -> DataFrame:
    """``from, to, start, end, value``: shares of best ways that use each contact, nought for unused ones.

    Only the sessions that have the best ways to an end count for it.
    """
    ways = _Ways(net, sessions)
    found = ways.forward(None, at, upper, True)
    used = found.shares(found.best())[1]
    every = ways.atoms.select("from", "to", "start", "end").distinct()
    return every.join(used, ["from", "to", "start", "end"], "left").select("from", "to", "start", "end", F.coalesce("value", F.lit(0.0)).alias("value"))


def _windows(net: Network, **grid) -> DataFrame:
    from kairograph.plans.grid import make_grid

    return net.spells.sparkSession.createDataFrame([(float(b.lo), float(b.hi)) for b in make_grid(net, **grid).bins], "lower double, upper double")


def temporal_distances(net: Network, basis: str = "hops", sessions: str = "bounded", **grid) -> DataFrame:
    """``time, source, node, distance``: hops of earliest ways, or latency, inside each window; what is not reached has no row."""
    if basis not in ("hops", "latency"):
        raise BadInput("basis is hops or latency")
    ways = _Ways(net, sessions)
    found = ways.search(ways.origins(R.anchors(ways.net, _windows(net, **grid)), F.struct("name", "lower"), F.col("upper")))
    rows = found.best().filter("key.name <> node")
    distance = F.col("hops").cast("double") if basis == "hops" else F.col("time") - F.col("begin")
    return rows.join(_begins(found), "key").select(F.col("key.lower").alias("time"), F.col("key.name").alias("source"), "node", distance.alias("distance"))


def window_efficiency(net: Network, basis: str = "hops", sessions: str = "bounded", **grid) -> DataFrame:
    """``time, temporal_efficiency, temporal_diameter, connected`` of every window, over the vertices that are there in it.

    A pair that is joined without latency makes the efficiency by latency infinite;
    with fewer than two vertices all is null.
    """
    d = temporal_distances(net, basis, sessions, **grid)
    inverse = F.when(F.col("distance") > 0, 1 / F.when(F.col("distance") > 0, F.col("distance"))).otherwise(float("inf"))
    g = d.groupBy("time").agg(F.sum(inverse).alias("s"), F.max("distance").alias("m"), F.count("*").alias("c"))
    windows = _windows(net, **grid)
    there = R.anchors(net, windows).groupBy("lower").agg(F.count("*").alias("n"))
    out = windows.join(there, "lower", "left").join(g, F.col("lower") == F.col("time"), "left")
    pairs = F.col("n") * (F.col("n") - 1)
    some = lambda c: F.when(F.col("n") >= 2, c)
    return out.select(F.col("lower").alias("time"), some(F.coalesce("s", F.lit(0.0)) / F.when(pairs > 0, pairs)).alias("temporal_efficiency"), F.col("m").alias("temporal_diameter"), some(F.coalesce("c", F.lit(0)) == pairs).alias("connected"))


def closest(closeness: DataFrame, top: int) -> DataFrame:
    """The ``top`` vertices by closeness, with all that equal the last one."""
    rows = closeness.filter("measure = 'closeness'")
    last = rows.orderBy(F.desc("value")).limit(top).agg(F.min("value").alias("last"))
    near = R.TOLERANCE * F.greatest(F.lit(1.0), F.abs("last"))
    return rows.crossJoin(last).filter((F.col("value") >= F.col("last") - near) | (F.col("value") == F.col("last"))).drop("last")


def distance_summary(net: Network, at: float | None = None, upper: float = math.inf) -> DataFrame:
    """``temporal_efficiency, temporal_diameter, connected`` over hops of all ordered pairs."""
    n = net.nodes.count()
    p = paths(net, None, "min_hops", at, upper).filter("source <> node")
    return p.agg((F.coalesce(F.sum(1 / F.col("hops")), F.lit(0.0)) / max(1, n * (n - 1))).alias("temporal_efficiency"), F.max("hops").alias("temporal_diameter"), (F.count("*") == n * (n - 1)).alias("connected"))


def stream_centrality(net: Network, measure: str, beta: float = 0.1, decay: float = 0.0, damping: float = 0.85, transition: float = 1.0, sessions: str = "bounded", start: float | None = None, end: float | None = None) -> DataFrame:
    """``session, node, value`` of Katz, PageRank or walk scores of a contact stream.

    Katz and walk scores are rounds of joins (`streams`).  PageRank is one ordered
    pass, of one task for each session; its state is two numbers for each vertex.
    """
    if measure not in ("katz", "pagerank", "walk"):
        raise UnknownMeasure(measure)
    if measure != "pagerank":
        return {"katz": S.katz, "walk": S.walks}[measure](net, beta, decay, sessions, start, end)

    names = keep(net.nodes.select("name", F.monotonically_increasing_id().alias("id")), "numbers")
    side = lambda c, i: names.select(F.col("name").alias(c), F.col("id").alias(i))
    stream = S.contact_stream(net, sessions, start, end).join(side("from", "a"), "from").join(side("to", "b"), "to").select("session", "t", "a", "b", F.col("n").cast("int").alias("n"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        session = pdf["session"].iloc[0]
        when, a, b, n = (pdf[c].to_numpy() for c in ("t", "a", "b", "n"))
        order = np.lexsort((b, a, when))
        order = np.repeat(order, n[order])
        when, a, b = when[order], a[order], b[order]
        ids = np.unique(np.concatenate([a, b]))
        a, b = np.searchsorted(ids, a), np.searchsorted(ids, b)
        cuts = [0, *(np.flatnonzero(np.diff(when)) + 1).tolist(), len(when)]
        batches = ((float(when[i]), a[i:j], b[i:j]) for i, j in pairwise(cuts))
        return pd.DataFrame({"session": session, "id": ids, "value": stream_pagerank(batches, len(ids), damping, transition)})

    found = stream.groupBy("session").applyInPandas(run, "session string, id long, value double")
    return found.join(names, "id").select("session", F.col("name").alias("node"), "value")


def stream_pagerank(batches: list, n: int, damping: float, transition: float) -> np.ndarray:
    """Temporal PageRank of Rozenshtein and Gionis (2016), one instant at a time.

    A contact starts a walk of weight ``1 - damping`` at its sender and takes it, with
    the ``active`` walks that wait there, to its receiver.  ``transition`` is the
    chance that a waiting walk stays; at 1 none is left behind.  An instant touches only
    the vertices of its contacts.
    """
    score, active = np.zeros(n), np.zeros(n)
    begun = 1 - damping
    for _, sender, receiver in batches:
        if len(sender) == 1:
            u, v = sender[0], receiver[0]
            moved = damping * (active[u] + begun)
            score[u] += begun
            score[v] += moved
            active[u] = 0.0 if transition == 1 else transition * (active[u] + begun)
            active[v] += moved if transition == 1 else (1 - transition) * moved
            continue
        moved = damping * (active[sender] + begun)
        np.add.at(score, sender, begun)
        np.add.at(score, receiver, moved)
        who, sent = np.unique(sender, return_counts=True)
        active[who] = 0.0 if transition == 1 else transition**sent * (active[who] + begun * sent)
        np.add.at(active, receiver, moved if transition == 1 else (1 - transition) * moved)
    total = score.sum()
    return score / total if total else np.full(n, np.nan)
