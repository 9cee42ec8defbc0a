"""Searches for time-respecting ways as rounds of joins, for all origins at once.

A state is a vertex reached at a time; ``exact`` 0 means arbitrarily near that time
but not at it.  Round h joins the states of h - 1 hops with the contacts that can be
entered from them, drops what is no better than a state of fewer hops, and adds up how
many ways lead to each new state.  Its arcs are kept, so counts and shares can be
carried back along them.  A search has a ``key`` (its origin, or origin and window);
sessions are walls that no way crosses.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kairograph.errors import BudgetExceeded
from kairograph.functions.islands import islands
from kairograph.plans.network import Network
from kairograph.plans.storage import keep

#: Counts of ways are exact up to here.
MOST = float(2**53)
#: Vertices of walls that are broadcast; more are shuffled.
SMALL = 100_000
STATE = ["key", "wall", "node", "time", "exact"]


def union(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def contacts(net: Network, sessions: str = "bounded", traversal: float = 0.0) -> DataFrame:
    """``wall, from, to, start, end, weight, lo, hi, closed``: when each contact can be entered.

    A contact is a maximal stretch, or a point, in which a pair is tied; it can be
    entered from ``lo`` until ``hi``, there too if ``closed``, while both ends are
    present and, where crossing takes time, until it is crossed.  A contact whose ends
    come and go has a row for each of these times.
    """
    f = net.with_(presence=None).fragments().select(F.coalesce(net.walls(sessions), F.lit("")).alias("wall"), "from", "to", "start", "end", "weight")
    if not net.directed:
        f = f.unionByName(f.select("wall", F.col("to").alias("from"), F.col("from").alias("to"), "start", "end", "weight"))
    pair = ["wall", "from", "to"]
    stretches = islands(f.filter("start < end"), pair, first=["weight"])
    points = f.filter("start = end").groupBy(*pair, "start", "end").agg(F.min("weight").alias("weight"))
    atoms = stretches.unionByName(points).withColumns({"lo": F.col("start"), "until": F.lit(float("inf"))})
    if net.presence is not None:
        for end in ("from", "to"):
            there = net.presence.select(F.col("node").alias(end), F.col("start").alias("a"), F.col("end").alias("b"))
            atoms = atoms.join(there, end, "left").withColumns({"a": F.coalesce("a", F.lit(float("-inf"))), "b": F.coalesce("b", F.lit(float("inf")))})
            moment = F.col("a") == F.col("b")
            inside = F.when(F.col("start") == F.col("end"), (F.col("a") <= F.col("start")) & ((F.col("start") < F.col("b")) | moment)).otherwise((F.col("a") < F.col("end")) & ((F.col("b") > F.col("lo")) | moment & (F.col("b") == F.col("lo"))))
            atoms = atoms.filter(inside & (~moment | (F.col("a") >= F.col("lo")))).withColumns({"lo": F.greatest("lo", "a"), "until": F.least("until", "b")}).drop("a", "b")
        if traversal:
            head = net.presence.select(F.col("node").alias("to"), F.col("start").alias("a"), F.col("end").alias("b"))
            done = F.col("start") + traversal
            known = head.select("to").distinct().withColumn("known", F.lit(True))
            late = atoms.filter("start = end").join(known, "to", "left").join(head.withColumnRenamed("to", "head"), (F.col("to") == F.col("head")) & (F.col("a") <= done) & ((done < F.col("b")) | (F.col("a") == done) & (F.col("b") == done)), "left")
            points = late.filter("known is null or head is not null").select(atoms.columns).distinct()
            atoms = atoms.filter("start < end").unionByName(points)
    point = F.col("start") == F.col("end")
    moment = (F.col("lo") == F.col("until")) & (F.col("lo") < F.col("end")) & F.lit(traversal == 0)
    whole = F.least("end", "until")
    hi = F.when(point | moment, F.col("lo")).otherwise(whole - traversal)
    closed = F.when(point | moment, True).otherwise(F.lit(traversal > 0) & (F.col("end") < F.col("until")))
    out = atoms.select(*pair, "start", "end", "weight", "lo", hi.alias("hi"), closed.alias("closed"))
    return keep(out.filter((F.col("lo") < F.col("hi")) | (F.col("lo") == F.col("hi")) & F.col("closed")), "contacts")


def present(net: Network, at: Column) -> DataFrame:
    """``name, there``: whether a vertex exists at a time; one without declared presence always does."""
    names = net.nodes.select("name")
    if net.presence is None:
        return names.withColumn("there", F.lit(True))
    p = net.presence.withColumn("in", ((F.col("start") <= at) & (at < F.col("end"))) | ((F.col("start") == at) & (F.col("end") == at)))
    return names.join(p.groupBy(F.col("node").alias("name")).agg(F.max("in").alias("there")), "name", "left").select("name", F.coalesce("there", F.lit(True)).alias("there"))


def anchors(net: Network, windows: DataFrame, at: float | None = None, forward: bool = True, names: list[str] | None = None) -> DataFrame:
    """``name, lower, upper, time``: where a search in a window begins.

    A vertex with declared presence begins at its first (backward: last) instant there;
    one that is never there has no search.  ``at`` is taken as it is, by those who are
    there then.
    """
    who = present(net, F.lit(float(at))).filter("there").select("name") if at is not None else net.nodes.select("name")
    if names is not None:
        who = who.filter(F.col("name").isin(list(names)))
    rows = who.crossJoin(F.broadcast(windows))  # windows are few
    bound = F.col("lower") if forward else F.col("upper")
    if at is not None or net.presence is None:
        return rows.select("name", "lower", "upper", (F.lit(float(at)) if at is not None else bound).alias("time"))
    rows = rows.join(net.presence.select(F.col("node").alias("name"), "start", "end"), "name", "left")
    moment = F.col("start") == F.col("end")
    first = F.greatest("start", "lower") if forward else F.least("end", "upper")
    fits = F.when(moment, (F.col("start") >= F.col("lower")) & (F.col("start") <= F.col("upper"))).when(F.lit(forward), (first < F.col("end")) & (first <= F.col("upper"))).otherwise((first >= F.col("start")) & (first >= F.col("lower")))
    time = F.when(F.col("start").isNull(), bound).when(fits, first)
    best = (F.min if forward else F.max)(time).alias("time")
    return rows.groupBy("name", "lower", "upper").agg(best).filter("time is not null")


def window(net: Network, lower: float, upper: float) -> DataFrame:
    return net.spells.sparkSession.createDataFrame([(float(lower), float(upper))], "lower double, upper double")


def _rank(forward: bool, time: str = "time", exact: str = "exact") -> Column:
    """Smaller is better: earlier, or later backward, and there what is certain to be reached last, or first."""
    return F.struct(F.col(time).alias("t"), F.col(exact).alias("e")) if forward else F.struct((-F.col(time)).alias("t"), (1 - F.col(exact)).alias("e"))


def _enter(traversal: float) -> tuple[Column, Column]:
    """Earliest time at the far end, and whether it is exact, for one who is ready at ``t0``."""
    t, lo, hi = F.col("t0"), F.col("lo"), F.col("hi")
    first = F.greatest(t, lo)
    sure = F.when((first < hi) | ((first == hi) & F.col("closed")), first)
    inside = (lo < t) & (t <= hi)
    later = (lo >= t) & ((lo < hi) | F.col("closed"))
    value = F.when(F.col("e0") == 1, sure).otherwise(F.when(inside, t).when(later, lo))
    return value + traversal, F.when((F.col("e0") == 0) & inside, 0).otherwise(1)


def _leave(traversal: float) -> tuple[Column, Column]:
    """Latest time to set out for one who has to be across by ``t0``, and whether it is exact."""
    b, lo, hi = F.col("t0"), F.col("lo"), F.col("hi")
    value = F.least(hi, b - traversal)
    member = (value >= lo) & ((value < hi) | ((value == hi) & F.col("closed")))
    across = (value + traversal < b) | ((value + traversal == b) & (F.col("e0") == 1))
    can = (value > lo) | ((value == lo) & member & across)
    return F.when(can, value), F.when(member & across, 1).otherwise(0)


@dataclass
class Search:
    """Layers of states by hops, and the arcs that lead to each layer from the one before."""

    forward: bool
    layers: list[DataFrame]
    arcs: list[DataFrame]

    def states(self) -> DataFrame:
        return union([x.withColumn("hops", F.lit(h).cast("long")) for h, x in enumerate(self.layers)])

    def best(self, criterion: str = "foremost_then_shortest") -> DataFrame:
        """``key, node, time, exact, hops, count`` of the best ways over all walls."""
        s = self.states().groupBy("key", "node", "time", "exact", "hops").agg(F.sum("count").alias("count"))
        # Of equal times, one that is reached stands before one that is only approached.
        s = s.withColumn("rank", F.struct((F.col("time") if self.forward else -F.col("time")).alias("t"), (1 - F.col("exact")).alias("e")))
        order = ("hops", "rank") if criterion == "min_hops" else ("rank", "hops")
        out = s.groupBy("key", "node").agg(F.min(F.struct(*order, "time", "exact", "count")).alias("b"))
        count = F.when(F.col("b.count") > MOST, F.raise_error(F.lit("more ways than can be counted exactly"))).otherwise(F.col("b.count"))
        return out.select("key", "node", "b.time", "b.exact", "b.hops", count.alias("count"))

    def _ends(self, best: DataFrame, h: int) -> DataFrame:
        """States of layer ``h`` in which best ways end, with the number of best ways."""
        b = best.filter((F.col("hops") == h) & (F.col("hops") > 0)).select("key", "node", "time", "exact", F.col("count").alias("all"))
        return self.layers[h].join(b, ["key", "node", "time", "exact"])

    def shares(self, best: DataFrame) -> tuple[DataFrame, DataFrame]:
        """``node, value`` and ``from, to, start, end, value``: shares of best ways through vertices and over contacts, summed over searches and ends."""
        best = keep(best, "best")
        share, nodes, edges = None, [], []
        for h in range(len(self.arcs), 0, -1):
            ends = self._ends(best, h).select(*STATE, (1 / F.col("all")).alias("end"))
            states = self.layers[h].select(*STATE, "count").join(ends, STATE, "left")
            states = states.join(share, STATE, "left") if share is not None else states.withColumn("inner", F.lit(None).cast("double"))
            zero = lambda c: F.coalesce(c, F.lit(0.0))
            states = keep(states.select(*STATE, (zero("inner") * F.col("count")).alias("through"), (zero("inner") + zero("end")).alias("total")).filter("total > 0"), "shares")
            nodes.append(states.groupBy("node").agg(F.sum("through").alias("value")))
            onward = self.arcs[h - 1].join(states.select(*STATE, "total"), STATE)
            edges.append(onward.groupBy("before", "node", "start", "end").agg(F.sum(F.col("total") * F.col("count")).alias("value")).withColumnsRenamed({"before": "from", "node": "to"}))
            share = onward.groupBy("key", "wall", "before", "t0", "e0").agg(F.sum("total").alias("inner")).withColumnsRenamed({"before": "node", "t0": "time", "e0": "exact"})
        if not nodes:
            none = self.layers[0].limit(0)
            return none.select("node", F.lit(0.0).alias("value")), none.select(F.col("node").alias("from"), F.col("node").alias("to"), F.col("time").alias("start"), F.col("time").alias("end"), F.lit(0.0).alias("value"))
        return union(nodes).groupBy("node").agg(F.sum("value").alias("value")), union(edges).groupBy("from", "to", "start", "end").agg(F.sum("value").alias("value"))

    def routes(self, best: DataFrame, most: float) -> DataFrame:
        """``key, node, route, times``: every best way as arrays of vertices and times; ``most`` for one end."""
        best = keep(best.filter("hops > 0"), "best")
        if not best.filter(F.col("count") > most).isEmpty():
            raise BudgetExceeded(f"more than {most:g} routes to one end")
        open_, done = None, []
        for h in range(len(self.arcs), 0, -1):
            ends = self._ends(best, h).select(*STATE, F.col("node").alias("target"), F.array(F.struct("node", "time")).alias("tail"))
            open_ = ends if open_ is None else open_.unionByName(ends)
            open_ = self.arcs[h - 1].join(open_, STATE).select("key", "wall", F.col("before").alias("node"), F.col("t0").alias("time"), F.col("e0").alias("exact"), "target", F.concat(F.array(F.struct(F.col("before").alias("node"), F.col("t0").alias("time"))), "tail").alias("tail"))
            open_ = keep(open_, "routes")
            if h == 1:
                done.append(open_)
        if not done:
            return best.select("key", "node", F.array("node").alias("route"), F.array("time").alias("times")).limit(0)
        return done[0].select("key", F.col("target").alias("node"), F.col("tail.node").alias("route"), F.col("tail.time").alias("times"))


def _worth_leaving(front: DataFrame, known: DataFrame, heads: DataFrame, forward: bool) -> DataFrame:
    """States from which something can still be bettered.

    Where a search has reached every vertex of its wall, a state that is no earlier
    than all of them leads nowhere.
    """
    reached = known.join(heads, ["wall", "node"])
    size = heads.groupBy("wall").agg(F.count("*").alias("size"))
    all_ = reached.groupBy("key", "wall").agg(F.count("*").alias("n"), F.max("known").alias("last")).join(size, "wall").filter("n = size").select("key", "wall", "last")
    rank = _rank(forward, "t0", "e0")
    return front.join(all_, ["key", "wall"], "left").filter(F.col("last").isNull() | (rank < F.col("last"))).drop("last")


def explore(origins: DataFrame, atoms: DataFrame, traversal: float = 0.0, forward: bool = True, pieces: bool = False, arcs: bool = True) -> Search:
    """All states that are no worse than those of fewer hops.

    ``origins`` has ``key, wall, node, time, exact, limit, count``.  ``pieces``: a
    contact may have several rows, of which a way uses the first it can.  Without
    ``arcs`` only states are kept, which is enough for times, hops and counts.
    """
    near, far = ("from", "to") if forward else ("to", "from")
    ties = atoms.withColumnsRenamed({near: "before", far: "node"}).select("wall", "before", "node", "start", "end", "lo", "hi", "closed")
    heads = keep(ties.select("wall", "node").distinct(), "heads")
    heads = F.broadcast(heads) if heads.count() < SMALL else heads
    time, exact = _enter(traversal) if forward else _leave(traversal)
    found = Search(forward, [keep(origins.select(*STATE, "limit", "count"), "states")], [])
    best = lambda x: x.select("key", "wall", "node", _rank(forward).alias("known"))
    known = best(found.layers[0])
    while True:
        front = _worth_leaving(found.layers[-1].withColumnsRenamed({"node": "before", "time": "t0", "exact": "e0"}), known, heads, forward)
        moved = front.join(ties, ["wall", "before"]).withColumns({"time": time, "exact": exact})
        within = F.col("time") <= F.col("limit") if forward else (F.col("time") > F.col("limit")) | ((F.col("time") == F.col("limit")) & (F.col("exact") == 1))
        moved = moved.filter(within)
        moved = moved.join(known, ["key", "wall", "node"], "left").filter(F.col("known").isNull() | (_rank(forward) < F.col("known"))).drop("known", "lo", "hi", "closed")
        if pieces:
            one = ["key", "wall", "before", "t0", "e0", "node", "start", "end"]
            moved = moved.groupBy(*one).agg(F.min(F.struct(_rank(forward).alias("r"), "time", "exact", "limit", "count")).alias("m")).select(*one, "m.time", "m.exact", "m.limit", "m.count")
        if arcs:
            moved = keep(moved, "arcs")
        layer = keep(moved.groupBy(*STATE).agg(F.first("limit").alias("limit"), F.sum("count").alias("count")).select(*STATE, "limit", "count"), "states")
        if layer.isEmpty():
            return found
        found.layers.append(layer)
        found.arcs.append(moved)
        known = keep(known.unionByName(best(layer)).groupBy("key", "wall", "node").agg(F.min("known").alias("known")), "known")


TOLERANCE = 1.4901161193847656e-08


def cheapest(origins: DataFrame, atoms: DataFrame, cost: str = "weight", traversal: float = 0.0, pieces: bool = False) -> DataFrame:
    """``key, node, cost, time, hops, count`` of the cheapest ways, earliest of equals.

    A label is a vertex, a time and a cost; one that is dearer than another that is
    there no later is dropped, so labels are corrected until none is new.  ``hops`` is
    null where ways of equal cost and time differ in it.
    """
    from pyspark.sql import Window

    price = F.col("weight") if cost == "weight" else F.lit(1.0)
    ties = atoms.withColumnsRenamed({"from": "before", "to": "node"}).select("wall", "before", "node", "start", "end", "lo", "hi", "closed", price.alias("price"))
    time, exact = _enter(traversal)
    at = ["key", "wall", "node"]
    labels = [keep(origins.select(*STATE, "limit", "count", F.lit(0.0).alias("cost")), "labels")]
    by_time = Window.partitionBy(*at).orderBy("time").rangeBetween(Window.unboundedPreceding, 0)
    same = lambda low: F.col("cost") <= F.col(low) + TOLERANCE * F.greatest(F.lit(1.0), F.col(low))
    while True:
        front = labels[-1].withColumnsRenamed({"node": "before", "time": "t0", "exact": "e0"})
        moved = front.join(ties, ["wall", "before"]).withColumns({"time": time, "exact": exact, "cost": F.col("cost") + F.col("price")}).filter("time <= limit")
        if pieces:
            one = ["key", "wall", "before", "t0", "e0", "node", "start", "end"]
            moved = moved.groupBy(*one).agg(F.min(F.struct("time", "exact", "cost", "limit", "count")).alias("m")).select(*one, "m.*")
        fresh = moved.select(*STATE, "limit", "count", "cost", F.lit(1).alias("fresh"))
        old = union(labels).withColumn("fresh", F.lit(0))
        both = fresh.unionByName(old).withColumn("low", F.min("cost").over(by_time)).filter((F.col("fresh") == 1) & same("low"))
        layer = keep(both.groupBy(*STATE).agg(F.first("limit").alias("limit"), F.sum("count").alias("count"), F.min("cost").alias("cost")), "labels")
        if layer.isEmpty():
            break
        labels.append(layer)
    every = union([x.withColumn("hops", F.lit(h).cast("long")) for h, x in enumerate(labels)])
    low = every.groupBy("key", "node").agg(F.min("cost").alias("low"))
    every = every.join(low, ["key", "node"]).filter(same("low"))
    first = every.groupBy("key", "node").agg(F.min("time").alias("first"))
    every = every.join(first, ["key", "node"]).filter("time = first")
    hops = F.when(F.min("hops") == F.max("hops"), F.min("hops"))
    return every.groupBy("key", "node").agg(F.min("low").alias("cost"), F.min("time").alias("time"), hops.alias("hops"), F.sum("count").alias("count"))


def spans(origins: DataFrame, atoms: DataFrame, traversal: float = 0.0) -> DataFrame:
    """``key, node, departure, exact, duration, arrival`` of the ways that take least time.

    A label stands for all ways over the same contacts: who leaves at d < ``latest``
    arrives at ``max(d + crossing, earliest)``, so it is as good as another that is
    ready no earlier and leaves no later, and is dropped.  The least time is
    ``crossing`` where one can leave late enough, else ``earliest - latest``, which is
    attained if ``exact``.  Of equal ones those that are attained stay, then the
    earliest departure.
    """
    from pyspark.sql import Window

    order = Window.partitionBy("wall", "from", "to").orderBy("lo", "hi").rowsBetween(Window.unboundedPreceding, -1)
    ties = keep(atoms.select("wall", "from", "to", "lo", "hi", "closed", F.max("hi").over(order).alias("gone")), "ties")
    at = ["key", "wall", "node"]
    shape = [*at, "earliest", "latest", "exact", "limit"]

    def capped(df: DataFrame) -> DataFrame:
        over = F.col("latest") > F.col("limit")
        return df.withColumns({"exact": F.when(over, 1).otherwise(F.col("exact")), "latest": F.least("latest", "limit")}).filter("earliest <= limit").select(shape)

    def frontier(df: DataFrame, fresh: bool) -> DataFrame:
        """Labels that none ready as early leaves later than; with ``fresh`` only new ones."""
        end = F.struct("latest", "exact")
        best = df.groupBy(*at, "earliest", "limit").agg(F.max(F.struct("latest", "exact", -F.col("fresh"))).alias("b")).select(*at, "earliest", "limit", "b.latest", "b.exact", (-F.col("b.col3")).alias("fresh"))
        before = Window.partitionBy(*at).orderBy("earliest").rowsBetween(Window.unboundedPreceding, -1)
        best = best.withColumn("top", F.max(end).over(before)).filter(F.col("top").isNull() | (end > F.col("top")))
        return (best.filter("fresh = 1") if fresh else best).select(shape)

    first = origins.withColumnRenamed("node", "from").join(ties, ["wall", "from"])
    begin = F.greatest("time", "lo")
    first = first.filter((begin < F.col("hi")) | (begin == F.col("hi")) & F.col("closed"))
    first = capped(first.select("key", "wall", F.col("to").alias("node"), (begin + traversal).alias("earliest"), F.col("hi").alias("latest"), F.col("closed").cast("int").alias("exact"), "limit"))
    layers = [keep(frontier(first.withColumn("fresh", F.lit(1)), True), "labels")]
    known, hops = layers[0], 1
    while not layers[-1].isEmpty():
        across = hops * traversal
        ready, ends, lo, hi = F.col("earliest"), F.col("latest"), F.col("lo"), F.col("hi")
        can = (F.greatest(ready, lo) < hi) | (F.greatest(ready, lo) == hi) & F.col("closed")
        useful = F.col("gone").isNull() | (F.col("gone") <= ready) | (F.col("gone") < ends + across)
        moved = layers[-1].withColumnRenamed("node", "from").join(ties, ["wall", "from"]).filter(can & useful)
        stop = hi - across
        exact = F.when(stop < ends, F.col("closed").cast("int")).when(stop == ends, F.least(F.col("closed").cast("int"), F.col("exact"))).otherwise(F.col("exact"))
        moved = capped(moved.select("key", "wall", F.col("to").alias("node"), (F.greatest(ready, lo) + traversal).alias("earliest"), F.least(ends, stop).alias("latest"), exact.alias("exact"), "limit"))
        old = known.withColumn("fresh", F.lit(0))
        layers.append(keep(frontier(moved.withColumn("fresh", F.lit(1)).unionByName(old), True), "labels"))
        # Where crossing takes time, a way of more contacts cannot stand for one of fewer, but one of fewer can for it.
        known = keep(frontier(known.unionByName(layers[-1]).withColumn("fresh", F.lit(0)), False), "known")
        hops += 1
    every = union([x.withColumn("across", F.lit((h + 1) * traversal)) for h, x in enumerate(layers)])
    free = (F.col("latest") > F.col("earliest") - F.col("across")) | (F.col("latest") == F.col("earliest") - F.col("across")) & (F.col("exact") == 1)
    duration = F.when(free, F.col("across")).otherwise(F.col("earliest") - F.col("latest"))
    leave = F.when(free, F.col("earliest") - F.col("across")).otherwise(F.col("latest"))
    sure = F.when(free, 1).otherwise(F.col("exact"))
    rows = every.filter("key <> node").groupBy("key", "node").agg(F.min(F.struct(duration.alias("duration"), (1 - sure).alias("limit"), leave.alias("departure"), "earliest")).alias("b"))
    return rows.select("key", "node", "b.departure", (1 - F.col("b.limit")).alias("exact"), "b.duration", F.col("b.earliest").alias("arrival"))
