"""Summaries of results: one short table of a longer one."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kairograph.functions.islands import union_length
from kairograph.operators.snapshots import ratio
from kairograph.plans.grid import make_grid, snapshot_edges
from kairograph.plans.network import Network

NAN = float("nan")


def similarity_summary(result: DataFrame) -> DataFrame:
    """``time, mean, min, max, nearest``: how each window is like the others; ties go to the earlier one."""
    other = F.when(F.col("time1") != F.col("time2"), F.col("value"))
    nearest = F.max_by("time2", F.when(other.isNotNull(), F.struct(other, -F.col("time2"))))
    return result.groupBy(F.col("time1").alias("time")).agg(F.avg(other).alias("mean"), F.min(other).alias("min"), F.max(other).alias("max"), nearest.alias("nearest"))


def projection_summary(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """``bin, active, within_slice, identity_arcs`` of a time-expanded graph."""
    ends = edges.filter("kind = 'within'").select(F.explode(F.array("from_state", "to_state")).alias("state")).distinct()
    there = vertices.select("state", "bin")
    active = there.join(ends, "state", "left_semi").groupBy("bin").agg(F.count("*").alias("active"))
    arcs = edges.join(there, edges["from_state"] == there["state"]).groupBy("bin").agg(F.count(F.when(F.col("kind") == "within", 1)).alias("within_slice"), F.count(F.when(F.col("kind") == "identity", 1)).alias("identity_arcs"))
    out = there.select("bin").distinct().join(active, "bin", "left").join(arcs, "bin", "left")
    return out.select("bin", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("active", "within_slice", "identity_arcs")])


def paths_summary(paths: DataFrame, nodes: DataFrame) -> DataFrame:
    """``source, reachable, share, median_latency, max_latency, median_hops, max_hops`` of each source's paths."""
    others = nodes.agg((F.count("*") - 1).alias("others"))
    g = paths.filter("source <> node").groupBy("source").agg(F.count("*").alias("reachable"), F.median("latency").alias("median_latency"), F.max("latency").alias("max_latency"), F.median("hops").alias("median_hops"), F.max("hops").alias("max_hops"))
    out = paths.select("source").distinct().join(g, "source", "left").crossJoin(others)  # one row
    reachable = F.coalesce("reachable", F.lit(0))
    return out.select("source", reachable.alias("reachable"), ratio(reachable, F.col("others"), NAN).alias("share"), "median_latency", "max_latency", "median_hops", "max_hops")


def pathway_endpoints(steps: DataFrame) -> DataFrame:
    """``node, routes, count, share, min_hops, first_arrival`` of the ends of routes."""
    s = steps.select("node", F.array_join("route", " -> ").alias("r"), (F.size("route") - 1).alias("h"), F.element_at("times", -1).alias("t"))
    total = s.agg(F.count("*").alias("total"))
    g = s.groupBy("node").agg(F.countDistinct("r").alias("routes"), F.count("*").alias("count"), F.min("h").alias("min_hops"), F.min("t").alias("first_arrival"))
    return g.crossJoin(total).select("node", "routes", "count", ratio(F.col("count"), F.col("total"), NAN).alias("share"), "min_hops", "first_arrival")  # one row


def path_network_nodes(edges: DataFrame) -> DataFrame:
    """``node, out_weight, in_weight, first``: vertices of a path network."""
    out = edges.select(F.col("from").alias("node"), F.col("weight").alias("o"), F.lit(0).alias("i"), F.lit(None).cast("double").alias("t"))
    into = edges.select(F.col("to").alias("node"), F.lit(0).alias("o"), F.col("weight").alias("i"), F.col("first").alias("t"))
    return out.unionByName(into).groupBy("node").agg(F.sum("o").alias("out_weight"), F.sum("i").alias("in_weight"), F.min("t").alias("first"))


def path_network_summary(edges: DataFrame) -> DataFrame:
    """``property, value``: edges, nodes, traversals, heaviest, first and last of a path network."""
    n = edges.select(F.explode(F.array("from", "to")).alias("v")).agg(F.countDistinct("v").cast("double").alias("nodes"))
    wide = edges.agg(F.count("*").cast("double").alias("edges"), F.sum("weight").cast("double").alias("traversals"), F.max("weight").cast("double").alias("heaviest"), F.min("first").alias("first"), F.max("last").alias("last")).crossJoin(n)
    return wide.unpivot([], wide.columns, "property", "value")


def trajectory_depths(tree: DataFrame) -> DataFrame:
    """``depth, branches, vertices, count, mean_branching`` of a tree of timed beginnings."""
    kids = tree.filter("parent is not null").groupBy(F.col("parent").alias("prefix")).agg(F.count("*").alias("kids"))
    vertex = F.regexp_replace("node", "@[^@]*$", "")
    return tree.join(kids, "prefix", "left").groupBy("depth").agg(F.count("*").alias("branches"), F.countDistinct(vertex).alias("vertices"), F.sum("count").alias("count"), F.avg("kids").alias("mean_branching"))


def collapsed_sessions(net: Network) -> DataFrame:
    """``session, pairs, nodes, union_duration, total_duration`` of every session's collapsed network."""
    f = net.fragments().select(F.coalesce("session", F.lit("")).alias("session"), "from", "to", "start", "end")
    pairs = f.groupBy("session").agg(F.countDistinct("from", "to").alias("pairs"), F.sum(F.col("end") - F.col("start")).alias("total_duration"))
    nodes = f.select("session", F.explode(F.array("from", "to")).alias("v")).groupBy("session").agg(F.countDistinct("v").alias("nodes"))
    union = union_length(f, ["session", "from", "to"], "u").groupBy("session").agg(F.sum("u").alias("union_duration"))
    return pairs.join(nodes, "session").join(union, "session").select("session", "pairs", "nodes", "union_duration", "total_duration")


def collapsed_nodes(pairs: DataFrame) -> DataFrame:
    """``node, partners, spells, total_duration`` of a collapsed network's vertices."""
    both = pairs.select(F.col("from").alias("node"), F.col("to").alias("w"), "spell_count", "total_duration").unionByName(pairs.select(F.col("to").alias("node"), F.col("from").alias("w"), "spell_count", "total_duration"))
    return both.groupBy("node").agg(F.countDistinct("w").alias("partners"), F.sum("spell_count").alias("spells"), F.sum("total_duration").alias("total_duration"))


def modularity_bins(net: Network, membership: DataFrame, gamma: float = 1.0, **grid) -> DataFrame:
    """``time, q, two_m, n_communities`` of every slice by itself."""
    g = make_grid(net, **grid)
    bins = g.frame(net.spells.sparkSession).select("bin", "time")
    e = snapshot_edges(net, g).filter(F.col("from") != F.col("to")).groupBy("bin", F.least("from", "to").alias("u"), F.greatest("from", "to").alias("v")).agg(F.sum("weight").alias("w"))
    arcs = e.select("bin", F.col("u").alias("node"), F.col("v").alias("other"), "w").unionByName(e.select("bin", F.col("v").alias("node"), F.col("u").alias("other"), "w"))
    c = membership.join(F.broadcast(bins), "time").select("bin", "node", F.col("community").cast("string").alias("c"))  # windows: a parameter's size
    k = arcs.groupBy("bin", "node").agg(F.sum("w").alias("k"))
    m = k.groupBy("bin").agg(F.sum("k").alias("two_m"))
    inside = arcs.join(c, ["bin", "node"]).join(c.select("bin", F.col("node").alias("other"), F.col("c").alias("c2")), ["bin", "other"]).filter("c = c2").groupBy("bin").agg(F.sum("w").alias("inside"))
    null = k.join(c, ["bin", "node"]).groupBy("bin", "c").agg(F.sum("k").alias("k")).groupBy("bin").agg(F.sum(F.col("k") * F.col("k")).alias("k2"))
    n = c.groupBy("bin").agg(F.countDistinct("c").alias("n_communities"))
    out = bins.join(n, "bin", "left").join(m, "bin", "left").join(inside, "bin", "left").join(null, "bin", "left")
    two_m = F.coalesce("two_m", F.lit(0.0))
    q = ratio(F.coalesce("inside", F.lit(0.0)) - gamma * F.coalesce(F.col("k2") / F.col("two_m"), F.lit(0.0)), two_m, NAN)
    return out.select("time", q.alias("q"), two_m.alias("two_m"), F.coalesce("n_communities", F.lit(0)).alias("n_communities"))


def community_sizes(membership: DataFrame, active: DataFrame | None = None) -> DataFrame:
    """``time, community, n_nodes, n_active``; ``active(time, node)`` are the vertices with ties, all if not given."""
    m = membership.select("time", "node", "community")
    if active is None:
        marked = m.withColumn("a", F.lit(1))
    else:
        marked = m.join(active.select("time", "node").distinct().withColumn("a", F.lit(1)), ["time", "node"], "left")
    return marked.groupBy("time", "community").agg(F.count("*").alias("n_nodes"), F.count("a").alias("n_active"))


def community_summary(membership: DataFrame) -> DataFrame:
    """``community, n_states, n_nodes, first_time, last_time, n_bins, persistence``."""
    steps = membership.select("time").distinct().withColumn("k", F.row_number().over(Window.orderBy("time")))  # windows
    m = membership.join(F.broadcast(steps), "time")
    g = m.groupBy("community").agg(F.count("*").alias("n_states"), F.countDistinct("node").alias("n_nodes"), F.min("time").alias("first_time"), F.max("time").alias("last_time"), F.countDistinct("time").alias("n_bins"), (F.max("k") - F.min("k") + 1).alias("reach"))
    return g.select("community", "n_states", "n_nodes", "first_time", "last_time", "n_bins", (F.col("n_bins") / F.col("reach")).alias("persistence"))


def trajectory_times(membership: DataFrame) -> DataFrame:
    """``time, persistence``: share of vertices that keep their label from the window before; all windows together at a null time."""
    rows = membership.select("time", "node", F.col("community").cast("string").alias("c")).withColumn("old", F.lag("c").over(Window.partitionBy("node").orderBy("time"))).filter("old is not null")
    same = F.avg((F.col("old") == F.col("c")).cast("double")).alias("persistence")
    return rows.groupBy("time").agg(same).unionByName(rows.agg(same).withColumn("time", F.lit(None).cast("double")))


def recruitment(allegiance: DataFrame, reference: DataFrame) -> DataFrame:
    """``node, recruitment, integration``: mean allegiance to one's own group of ``reference(node, group)`` and to others.

    Pairs that are never together count as nought, which sizes of groups tell without listing them.
    """
    ref = reference.select("node", F.col("group").cast("string").alias("g"))
    size = ref.groupBy("g").agg(F.count("*").alias("n"))
    total = ref.agg(F.count("*").alias("all"))
    a = allegiance.join(ref.select(F.col("node").alias("node1"), F.col("g").alias("g1")), "node1").join(ref.select(F.col("node").alias("node2"), F.col("g").alias("g2")), "node2")
    sums = a.groupBy(F.col("node1").alias("node")).agg(F.sum(F.when(F.col("g1") == F.col("g2"), F.col("value"))).alias("own"), F.sum(F.when(F.col("g1") != F.col("g2"), F.col("value"))).alias("other"))
    out = ref.join(F.broadcast(size), "g").crossJoin(total).join(sums, "node", "left")  # groups; one row
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return out.select("node", ratio(zero("own"), F.col("n") - 1, NAN).alias("recruitment"), ratio(zero("other"), F.col("all") - F.col("n"), NAN).alias("integration"))


def surrogate_summary(spells: DataFrame) -> DataFrame:
    """``replicate, n_events, n_pairs, t_min, t_max, mean_duration`` of surrogate networks."""
    return spells.groupBy("replicate").agg(F.count("*").alias("n_events"), F.countDistinct("from", "to").alias("n_pairs"), F.min("start").alias("t_min"), F.max("end").alias("t_max"), F.avg(F.col("end") - F.col("start")).alias("mean_duration"))


def significance_summary(cells: DataFrame) -> DataFrame:
    """``measure, tested, significant, median_z`` of tested cells; one measure ``value`` if they name none."""
    c = cells if "measure" in cells.columns else cells.withColumn("measure", F.lit("value"))
    return c.groupBy("measure").agg(F.count("*").alias("tested"), F.count(F.when(F.col("p_adj") < 0.05, 1)).alias("significant"), F.median("z").alias("median_z"))


def phase_table(phases: DataFrame, similarity: DataFrame) -> DataFrame:
    """``phase, start, end, n_bins, cohesion``: cohesion is the mean likeness of different windows of a phase."""
    p = F.broadcast(phases)  # windows
    pair = similarity.join(p.select(F.col("time").alias("time1"), F.col("phase").alias("p1")), "time1").join(p.select(F.col("time").alias("time2"), F.col("phase").alias("p2")), "time2").filter("p1 = p2 and time1 <> time2")
    cohesion = pair.groupBy(F.col("p1").alias("phase")).agg(F.avg("value").alias("cohesion"))
    return phases.groupBy("phase").agg(F.min("time").alias("start"), F.max("time").alias("end"), F.count("*").alias("n_bins")).join(cohesion, "phase", "left")


def animation_frames(net: Network, **grid) -> DataFrame:
    """``time, from, to, weight, state``: what a picture of each window shows; ties are new, kept or last."""
    g = make_grid(net, **grid)
    e = snapshot_edges(net, g).select("bin", "time", "from", "to", "weight")
    w = Window.partitionBy("from", "to").orderBy("bin")
    new = F.coalesce(F.lag("bin").over(w) != F.col("bin") - 1, F.lit(True))
    last = F.coalesce(F.lead("bin").over(w) != F.col("bin") + 1, F.lit(True))
    state = F.when(new & last, "brief").when(new, "new").when(last, "last").otherwise("kept")
    return e.select("time", "from", "to", "weight", state.alias("state"))


def head_with_counts(df: DataFrame, order: list[str], n: int = 6, tail: bool = False) -> DataFrame:
    """The first (or last) ``n`` rows in an order, with ``rows_shown`` and ``rows_in_all`` beside them."""
    total = df.agg(F.count("*").alias("rows_in_all"))
    keys = [F.desc(c) if tail else F.asc(c) for c in order]
    shown = df.orderBy(*keys).limit(n)
    return shown.crossJoin(total).withColumn("rows_shown", F.least(F.lit(n).cast("long"), "rows_in_all"))


def describe(net: Network, temporal_density: bool = False) -> DataFrame:
    """``property, value`` in fifteen rows: what the network is, its clock, and its densities as text.

    The density over all time is asked for, as it needs a pass of its own.
    """
    from kairograph.operators.dynamics import exposure
    from kairograph.operators.snapshots import metrics

    lo, hi = net.span()
    number = lambda c: F.regexp_replace(c.cast("string"), r"\.0$", "")
    s = net.spells.agg(F.count("*").alias("spells"), F.countDistinct("from", "to").alias("pairs"), F.countDistinct("session").alias("sessions"))
    n = net.nodes.agg(F.count("*").alias("vertices"))
    mean = metrics(net, ["density"], sessions="collapse").agg(F.round(F.avg("value"), 4).alias("mean"))
    wide = s.crossJoin(n).crossJoin(mean)  # one row each
    if temporal_density:
        wide = wide.crossJoin(exposure(net, window="all").select(F.round("temporal_density", 4).alias("density")))
    attributes = ", ".join(c for c in net.nodes.columns if c not in ("id", "label", "name", "x", "y")) or "none"
    text = {
        "format": F.lit(net.format),
        "directed": F.lit("yes" if net.directed else "no"),
        "vertices": F.col("vertices").cast("string"),
        "edge spells": F.col("spells").cast("string"),
        "distinct pairs": F.col("pairs").cast("string"),
        "time unit": F.lit(net.unit),
        "observed from": number(F.lit(lo)),
        "observed to": number(F.lit(hi)),
        "span": number(F.lit(hi - lo)),
        "bin width": number(F.lit(float(net.interval))),
        "time bins": F.lit(str(len(make_grid(net).bins))),
        "mean snapshot density": number(F.col("mean")),
        "temporal density": number(F.col("density")) if temporal_density else F.lit("not computed"),
        "sessions": F.when(F.col("sessions") > 0, F.col("sessions").cast("string")).otherwise("none"),
        "vertex attributes": F.lit(attributes),
    }
    return wide.select(*(c.alias(k) for k, c in text.items())).unpivot([], list(text), "property", "value")
