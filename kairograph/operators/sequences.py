"""Event sequences: participation shifts, event graphs, motifs."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kairograph.errors import BadInput, NeedsDirected
from kairograph.functions.labels import components
from kairograph.functions.timeops import c_leq, c_lt, c_tol
from kairograph.operators.snapshots import ratio
from kairograph.plans.network import Network

#: The thirteen shifts by family.
PSHIFTS = {
    "receiving": ("AB-BA", "AB-B0", "AB-BY"),
    "claiming": ("A0-X0", "A0-XA", "A0-XY"),
    "usurping": ("AB-X0", "AB-XA", "AB-XB", "AB-XY"),
    "continuing": ("A0-AY", "AB-A0", "AB-AY"),
}


def _turn_rows(net: Network, sessions: str) -> DataFrame:
    """Turns in order: all receivers of one sender at one time are one turn to the group.

    A turn to the sender alone is a ``loop``; turns before an observed start or of
    another observed stretch have another ``part``.
    """
    t = F.col("start")
    part = F.lit(0) if net.observed is None else F.coalesce(*[F.when(c_leq(F.lit(a), t) & c_leq(t, F.lit(b)), F.lit(i)) for i, (a, b) in enumerate(net.observed)])
    s = net.spells.filter(~F.col("onset_censored")).select(net.walls(sessions).alias("wall"), part.alias("part"), "from", "to", t.alias("t")).filter("part is not null")
    other = F.when(F.col("from") != F.col("to"), F.col("to"))
    rows = s.groupBy("wall", "part", "t", "from").agg(F.countDistinct(other).alias("n"), F.min(other).alias("one"))
    return rows.select("wall", "part", "t", "from", F.when(F.col("n") == 1, F.col("one")).alias("to"), (F.col("n") == 0).alias("loop"))


def lagged(rows: DataFrame, keys: list[str], order: list[str], columns: list[str], stretch: float) -> DataFrame:
    """``columns`` of the row before, as ``_<name>``; the first of ``order`` is a time.

    Rows are cut by ``stretch`` of time, so that a key with very many rows is many
    groups; the first row of each looks at the last one of the stretch before.
    """
    rows = rows.withColumn("_cut", F.floor(F.col(order[0]) / stretch))
    own = Window.partitionBy(*keys, "_cut").orderBy(*order)
    was = F.struct(*columns)
    last = rows.groupBy(*keys, "_cut").agg(F.max_by(was, F.struct(*order)).alias("_last"))
    last = last.select(*[F.col(k).alias(f"_on_{k}") for k in keys], F.col("_cut").alias("_on_cut"), F.lag("_last").over(Window.partitionBy(*keys).orderBy("_cut")).alias("_carried"))
    same = F.col("_cut") == F.col("_on_cut")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_on_{k}"))
    both = rows.withColumn("_lag", F.lag(was).over(own)).join(last, same)
    before = F.coalesce("_lag", "_carried")
    return both.select(*[c for c in rows.columns if c != "_cut"], before.isNotNull().alias("_has"), *[before[c].alias(f"_{c}") for c in columns])


def _shift() -> Column:
    a, b, c, d = (F.col(x) for x in ("a", "b", "c", "d"))
    group, wide = b.isNull(), d.isNull()
    return (
        F.when(~group & (c == b), F.when(wide, "AB-B0").when(d == a, "AB-BA").otherwise("AB-BY"))
        .when(group & (c != a), F.when(wide, "A0-X0").when(d == a, "A0-XA").otherwise("A0-XY"))
        .when(~group & (c != a) & (c != b), F.when(wide, "AB-X0").when(d == a, "AB-XA").when(d == b, "AB-XB").otherwise("AB-XY"))
        .when((c == a) & group & ~wide, "A0-AY")
        .when((c == a) & ~group & wide, "AB-A0")
        .when((c == a) & ~group & ~wide & (d != b), "AB-AY")
    )


def pshift_events(net: Network, sessions: str = "bounded") -> DataFrame:
    """``session, time, shift`` of every turn that makes one."""
    if not net.directed:
        raise NeedsDirected("participation shifts need senders and receivers")
    lo, hi = net.span()
    stretch = (hi - lo) / 256 or 1.0
    rows = lagged(_turn_rows(net, sessions), ["wall", "part"], ["t", "from", "to"], ["from", "to", "loop"], stretch).filter(F.col("_has") & ~F.col("_loop") & ~F.col("loop"))
    rows = rows.select("wall", "t", F.col("_from").alias("a"), F.col("_to").alias("b"), F.col("from").alias("c"), F.col("to").alias("d"))
    return rows.select(F.col("wall").alias("session"), F.col("t").alias("time"), _shift().alias("shift")).filter("shift is not null")


def pshift_summary(shifts: DataFrame) -> DataFrame:
    """``family, count, share, top_shift`` of a table of the thirteen shifts."""
    total = Window.partitionBy()  # four families
    g = shifts.groupBy("family").agg(F.sum("count").alias("count"), F.max_by("shift", F.struct("count", F.col("shift"))).alias("top"))
    return g.select("family", "count", ratio(F.col("count"), F.sum("count").over(total), float("nan")).alias("share"), F.when(F.col("count") > 0, F.col("top")).alias("top_shift"))


def pshifts(net: Network, sessions: str = "bounded", cumulative: bool = False) -> DataFrame:
    """``shift, family, count, share`` of the thirteen shifts, or running counts at each time."""
    spark = net.spells.sparkSession
    kinds = spark.createDataFrame([(s, f) for f, names in PSHIFTS.items() for s in names], "shift string, family string")
    found = pshift_events(net, sessions)
    if cumulative:
        at = found.groupBy("time", "shift").agg(F.count("*").alias("n"))
        w = Window.partitionBy("shift").orderBy("time").rowsBetween(Window.unboundedPreceding, 0)
        return at.withColumn("count", F.sum("n").over(w)).drop("n")
    counts = found.groupBy("shift").agg(F.count("*").alias("count"))
    total = found.agg(F.count("*").alias("total"))
    out = F.broadcast(kinds).join(counts, "shift", "left").crossJoin(total)  # 13 rows and one
    return out.select("shift", "family", F.coalesce("count", F.lit(0)).alias("count"), ratio(F.coalesce("count", F.lit(0)), F.col("total"), float("nan")).alias("share"))


def event_graph(net: Network, delta: float = math.inf, adjacency: str = "all", direction: str = "respect", sessions: str = "bounded", merge: bool = False, after: float | None = None) -> DataFrame:
    """Arcs between events that share a vertex, the second starting after the first ends.

    ``first, second, via, wait``.  With a finite ``delta`` time is cut into
    stretches a little longer than that, so that the join is on vertex and stretch and
    rounding does not carry a partner past the next one.  ``next`` looks along each
    vertex's own line of events and forms no other pairs.  Times that differ by rounding
    are equal, unless ``after`` says how much later than an end a start must be; then
    ``delta`` is exact too.
    """
    if adjacency not in ("all", "next") or direction not in ("respect", "ignore") or delta < 0:
        raise BadInput("adjacency is all or next, direction respect or ignore, delta not negative")
    if after is not None and after < 0:
        raise BadInput("after must not be negative")
    if merge:
        s = net.spells.groupBy(net.walls(sessions).alias("wall"), "from", "start", "end").agg(F.min("raw_id").alias("raw_id"), F.array_sort(F.collect_set("to")).alias("to"))
    else:
        s = net.spells.select(net.walls(sessions).alias("wall"), "raw_id", "from", F.array("to").alias("to"), "start", "end")
    respect = direction == "respect" and net.directed
    every = F.array_distinct(F.concat(F.array("from"), F.col("to")))
    leave = s.withColumn("via", F.explode("to" if respect else every))
    enter = s.withColumn("via", F.col("from")) if respect else leave
    one = leave.select("wall", "via", F.col("raw_id").alias("first"), F.col("end").alias("e1"))
    two = enter.select("wall", "via", F.col("raw_id").alias("second"), F.col("start").alias("s2"))
    on_keys = lambda a, b: a["wall"].eqNullSafe(b["wall"]) & (a["via"] == b["via"])
    on = on_keys(one, two)
    near = c_lt(F.col("e1"), F.col("s2")) if after is None else F.col("s2") > F.col("e1") + after
    if math.isfinite(delta):
        near = near & (c_leq(F.col("s2"), F.col("e1") + delta) if after is None else F.col("s2") <= F.col("e1") + delta)
    if adjacency == "next":
        line = one.select("wall", "via", (F.col("e1") + (c_tol(F.col("e1"), F.col("e1")) if after is None else after)).alias("t"), F.lit(0).alias("starts"), "first", "e1").unionByName(two.select("wall", "via", F.col("s2").alias("t"), F.lit(1).alias("starts"), F.lit(None).cast("long").alias("first"), F.lit(None).cast("double").alias("e1")))
        ahead = Window.partitionBy("wall", "via").orderBy(F.desc("t"), "starts").rowsBetween(Window.unboundedPreceding, -1)
        one = line.withColumn("to_come", F.min(F.when(F.col("starts") == 1, F.col("t"))).over(ahead)).filter("starts = 0 and to_come is not null").select("wall", "via", "first", "e1", "to_come")
        on = on_keys(one, two) & (one["to_come"] == two["s2"])
    elif math.isfinite(delta) and delta > 0:
        cell = 1.0625 * delta
        one = one.withColumn("k", F.explode(F.array(F.floor(F.col("e1") / cell), F.floor(F.col("e1") / cell) + 1)))
        two = two.withColumn("k2", F.floor(F.col("s2") / cell))
        on = on_keys(one, two) & (one["k"] == two["k2"])
    out = one.join(two, on).filter(near & (F.col("first") != F.col("second"))).select("first", "second", one["via"], "e1", "s2")
    return out.select("first", "second", "via", (F.col("s2") - F.col("e1")).alias("wait"))


def event_graph_events(net: Network, sessions: str = "bounded", merge: bool = False) -> DataFrame:
    """``event, session, from, to, start, end``: the vertices of the event graph.

    With ``merge`` all receivers of one sender's message are one event.
    """
    if not merge:
        return net.spells.select(F.col("raw_id").alias("event"), net.walls(sessions).alias("session"), "from", F.array("to").alias("to"), "start", "end")
    return net.spells.groupBy(net.walls(sessions).alias("session"), "from", "start", "end").agg(F.min("raw_id").alias("event"), F.array_sort(F.collect_set("to")).alias("to")).select("event", "session", "from", "to", "start", "end")


def event_chains(events: DataFrame, arcs: DataFrame) -> DataFrame:
    """``event, chain, size``: relay chains are the components that arcs join; ``chain`` is the least event of one.

    An event without arcs is a chain of its own.
    """
    label = components(arcs.select(F.col("first").alias("a"), F.col("second").alias("b")), []).withColumnsRenamed({"node": "event", "label": "chain"})
    rows = events.select("event").join(label, "event", "left").select("event", F.coalesce("chain", "event").alias("chain"))
    return rows.join(rows.groupBy("chain").agg(F.count("*").alias("size")), "chain").select("event", "chain", "size")


def event_graph_summary(net: Network, **how) -> DataFrame:
    """``raw_id, in_degree, out_degree, mean_wait`` of every event."""
    g = event_graph(net, **how)
    out = g.groupBy(F.col("first").alias("raw_id")).agg(F.countDistinct("second").alias("out_degree"), F.avg("wait").alias("mean_wait"))
    into = g.groupBy(F.col("second").alias("raw_id")).agg(F.countDistinct("first").alias("in_degree"))
    return net.spells.select("raw_id").join(into, "raw_id", "left").join(out, "raw_id", "left").select("raw_id", F.coalesce("in_degree", F.lit(0)).alias("in_degree"), F.coalesce("out_degree", F.lit(0)).alias("out_degree"), "mean_wait")


#: Pattern words, and families by their first class.
MOTIF_WORDS = ("III", "IIO", "IOI", "IOO", "OII", "OIO", "OOI", "OOO")
MOTIF_FAMILIES = ("star_pre", "star_mid", "star_post", "two_node", "triangle")
#: Classes of each pattern of endpoints, in order of first appearance.
MOTIF_KEYS = {
    "010101": (25, 32), "010102": (8,), "010110": (26, 31), "010112": (2,), "010120": (7,), "010121": (1,), "010201": (16,), "010202": (24,), "010210": (15,),
    "010212": (39,), "010220": (23,), "010221": (40,), "011001": (27, 30), "011002": (6,), "011010": (28, 29), "011012": (4,), "011020": (5,), "011021": (3,),
    "011201": (11,), "011202": (35,), "011210": (12,), "011212": (20,), "011220": (36,), "011221": (19,), "012001": (14,), "012002": (22,), "012010": (13,),
    "012012": (37,), "012020": (21,), "012021": (38,), "012101": (9,), "012102": (33,), "012110": (10,), "012112": (18,), "012120": (34,), "012121": (17,),
}


def motif_instances(net: Network, delta: float, sessions: str = "bounded") -> DataFrame:
    """``session, key`` of every three events on two or three vertices within ``delta``."""
    if not net.directed:
        raise NeedsDirected("motifs need directions")
    if delta <= 0 or not math.isfinite(delta):
        raise BadInput("motifs need a finite window")
    s = net.spells.filter(F.col("from") != F.col("to")).select(F.coalesce(net.walls(sessions), F.lit("")).alias("wall"), "raw_id", "from", "to", F.col("start").alias("t"))
    cell = 1.0625 * delta  # a partner within delta is in the same or the next stretch whatever the rounding
    rank = lambda x, n: s.select("wall", F.col("raw_id").alias(f"r{n}"), F.col("from").alias(f"f{n}"), F.col("to").alias(f"t{n}"), F.col("t").alias(f"s{n}"))  # noqa: E731, ARG005
    one, two, three = rank(s, 1), rank(s, 2), rank(s, 3)
    order = lambda i, j: F.struct(F.col(f"s{i}"), F.col(f"f{i}"), F.col(f"t{i}"), F.col(f"r{i}")) < F.struct(F.col(f"s{j}"), F.col(f"f{j}"), F.col(f"t{j}"), F.col(f"r{j}"))
    ends = lambda df, n: df.withColumn("v", F.explode(F.array(f"f{n}", f"t{n}"))).withColumn("k", F.floor(F.col(f"s{n}") / cell))
    wide = lambda df, n: df.withColumn("v", F.explode(F.array(f"f{n}", f"t{n}"))).withColumn("k", F.explode(F.array(F.floor(F.col(f"s{n}") / cell), F.floor(F.col(f"s{n}") / cell) + 1)))
    pairs = wide(one, 1).join(ends(two, 2), ["wall", "v", "k"]).filter(order(1, 2) & c_leq(F.col("s2"), F.col("s1") + delta)).drop("v", "k").dropDuplicates(["r1", "r2"])
    # The third shares a vertex with the first or the second.
    vs = pairs.withColumn("v", F.explode(F.array_distinct(F.array("f1", "t1", "f2", "t2")))).withColumn("k", F.explode(F.array(F.floor(F.col("s1") / cell), F.floor(F.col("s1") / cell) + 1)))
    third = ends(three, 3)
    trios = vs.join(third, ["wall", "v", "k"]).filter(order(2, 3) & c_leq(F.col("s3"), F.col("s1") + delta)).drop("v", "k").dropDuplicates(["r1", "r2", "r3"])
    where = [F.col(c) for c in ("f1", "t1", "f2", "t2", "f3", "t3")]
    seen = F.array_distinct(F.array(*where))
    key = F.concat(*[(F.array_position(seen, c) - 1).cast("string") for c in where])
    return trios.filter(F.size(seen) <= 3).select(F.col("wall").alias("session"), key.alias("key"), seen.alias("nodes"))


def motif_nodes(net: Network, delta: float, sessions: str = "bounded") -> DataFrame:
    """``node, motif, count``: classes at the vertices they belong to.

    A star belongs to its centre, the vertex that all its events touch; a class of
    two vertices to the one of them it is seen from; a triangle to all three.
    """
    spark = net.spells.sparkSession
    found = motif_instances(net, delta, sessions).groupBy("key", "nodes").agg(F.count("*").alias("n"))
    places = []
    for k, classes in MOTIF_KEYS.items():
        events = [set(k[i : i + 2]) for i in (0, 2, 4)]
        if len(classes) == 2:
            words = ["".join("O" if k[i] == str(v) else "I" for i in (0, 2, 4)) for v in (0, 1)]
            places += [(k, c, v) for c in classes for v in (0, 1) if words[v] == MOTIF_WORDS[(c - 1) % 8]]
        elif classes[0] > 32:
            places += [(k, classes[0], v) for v in range(3)]
        else:
            places += [(k, classes[0], v) for v in range(3) if all(str(v) in e for e in events)]
    table = F.broadcast(spark.createDataFrame(places, "key string, motif int, place int"))
    return found.join(table, "key").groupBy(F.element_at("nodes", F.col("place") + 1).alias("node"), "motif").agg(F.sum("n").alias("count"))


def motif_summary(counts: DataFrame, by: str = "family") -> DataFrame:
    """``count, share, top_motif`` of each family, or of each ``node`` of attributed classes."""
    g = counts.groupBy(by).agg(F.sum("count").alias("count"), F.max_by("motif", F.struct("count", -F.col("motif"))).alias("top"))
    total = counts.agg(F.sum("count").alias("total"))
    return g.crossJoin(total).select(by, "count", ratio(F.col("count"), F.col("total"), float("nan")).alias("share"), F.when(F.col("count") > 0, F.col("top")).alias("top_motif"))  # one row


def motifs(net: Network, delta: float, sessions: str = "bounded") -> DataFrame:
    """``motif, family, pattern, count`` of all forty classes."""
    spark = net.spells.sparkSession
    classes = spark.createDataFrame([(i + 1, MOTIF_FAMILIES[i // 8], MOTIF_WORDS[i % 8]) for i in range(40)], "motif int, family string, pattern string")
    keys = spark.createDataFrame([(k, c) for k, cs in MOTIF_KEYS.items() for c in cs], "key string, motif int")
    found = motif_instances(net, delta, sessions).groupBy("key").agg(F.count("*").alias("n")).join(F.broadcast(keys), "key").groupBy("motif").agg(F.sum("n").alias("n"))
    return classes.join(found, "motif", "left").select("motif", "family", "pattern", F.coalesce("n", F.lit(0)).alias("count"))
