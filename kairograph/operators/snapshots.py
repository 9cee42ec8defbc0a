"""Snapshots, mixing, and measures of whole snapshots."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kairograph.errors import NeedsDirected, UnknownMeasure
from kairograph.operators import kernels as K
from kairograph.operators import sparse as S
from kairograph.plans.grid import Grid, eligible, make_grid, snapshot_edges
from kairograph.plans.network import Network

NAN = float("nan")


def ratio(num, den, empty=0.0):
    """``num / den`` with a stated value where the denominator is nought."""
    return F.when(den != 0, num.cast("double") / den.cast("double")).otherwise(F.lit(empty).cast("double"))


def snapshots(net: Network, at: float | None = None, sessions: str = "bounded", **grid) -> DataFrame:
    """``[session,] time, from, to, weight, n_spells`` of every active pair and window.

    ``at`` keeps the windows that cover a time, else the one that begins nearest.
    """
    g = make_grid(net, **grid)
    if at is not None:
        cover = [b for b in g.bins if b.lo <= at < b.hi or (b.closed and at <= b.hi) or b.lo == at]
        g = Grid(tuple(cover or [min(g.bins, key=lambda b: abs(b.lo - at))]), g.step, g.window)
    return snapshot_edges(net, g, sessions).drop("bin")


def snapshot_summary(net: Network, sessions: str = "bounded", **grid) -> DataFrame:
    """``time, ties, nodes, weight`` of every window, empty ones too."""
    g = make_grid(net, **grid)
    e = snapshot_edges(net, g, sessions)
    keys = [k for k in ("session",) if k in e.columns]
    ends = e.select(*keys, "bin", "weight", F.explode(F.array("from", "to")).alias("name"))
    nodes = ends.groupBy(*keys, "bin").agg(F.countDistinct("name").alias("nodes"))
    ties = e.groupBy(*keys, "bin").agg(F.count("*").alias("ties"), F.sum("weight").alias("weight"))
    return _rectangle(net, g, ties.join(nodes, [*keys, "bin"]), keys).select(*keys, "time", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("ties", "nodes")], F.coalesce("weight", F.lit(0.0)).alias("weight"))


def _rectangle(net: Network, g: Grid, df: DataFrame, keys: list[str]) -> DataFrame:
    """Every window (of every session) with its row of ``df``, if any."""
    frame = F.broadcast(g.frame(net.spells.sparkSession).select("bin", "time"))  # windows: a parameter's size
    base = net.spells.select("session").distinct().crossJoin(frame) if keys else frame
    return base.join(df.drop("time"), [*keys, "bin"], "left")


def mixing(net: Network, by: str, sessions: str = "bounded", **grid) -> DataFrame:
    """``[session,] time, cell, from_group, to_group, ties``: distinct pairs between groups of vertices, all cells."""
    g = make_grid(net, **grid)
    group = net.nodes.select("name", F.coalesce(F.col(by).cast("string"), F.lit("(missing)")).alias("g"))
    e = snapshot_edges(net, g, sessions)
    keys = [k for k in ("session",) if k in e.columns]
    e = e.select(*keys, "bin", "from", "to").distinct()
    for end in ("from", "to"):
        e = e.join(group.select(F.col("name").alias(end), F.col("g").alias(f"{end}_group")), end)
    if not net.directed:
        e = e.withColumns({"from_group": F.least("from_group", "to_group"), "to_group": F.greatest("from_group", "to_group")})
    counts = e.groupBy(*keys, "bin", "from_group", "to_group").agg(F.count("*").alias("ties"))
    levels = group.select("g").distinct()
    cells = levels.withColumnRenamed("g", "from_group").crossJoin(levels.withColumnRenamed("g", "to_group"))  # groups: all cells are the result
    if not net.directed:
        cells = cells.filter("from_group <= to_group")
    cells = cells.crossJoin(F.broadcast(g.frame(net.spells.sparkSession).select("bin", "time")))
    if keys:
        cells = cells.crossJoin(net.spells.select("session").distinct())
    mark = " -> " if net.directed else " -- "
    quoted = lambda c: F.when(F.contains(F.col(c), F.lit(mark)), F.concat(F.lit('"'), F.col(c), F.lit('"'))).otherwise(F.col(c))
    same = (cells["bin"] == counts["bin"]) & (cells["from_group"] == counts["from_group"]) & (cells["to_group"] == counts["to_group"])
    for k in keys:
        same = same & cells[k].eqNullSafe(counts[k])
    out = cells.join(counts, same, "left").select(*[cells[k] for k in keys], "time", cells["from_group"], cells["to_group"], F.coalesce("ties", F.lit(0)).alias("ties"))
    return out.select(*keys, "time", F.concat(quoted("from_group"), F.lit(mark), quoted("to_group")).alias("cell"), "from_group", "to_group", "ties")


DIRECTED_ONLY = {"reciprocity", "mutual", "asymmetric", "null", "in_2stars", "out_2stars", "indegree_1_5", "outdegree_1_5"}
TABLE = ("density", "edges", "active_nodes", "isolates", "reciprocity", "mutual", "asymmetric", "null", "degree_mean", "degree_variance", "degree_min", "degree_max", "mean_degree", "indegree_1_5", "outdegree_1_5", "in_2stars", "out_2stars", "two_paths", "centralization_degree", "transitivity", "triangles", "assortativity")
KERNEL = ("components", "components_strong", "largest_component", "mean_distance", "diameter", "connectedness", "efficiency", "hierarchy", "lubness", "centralization_betweenness", "centralization_closeness", "triads")


def _pairs(net: Network, g: Grid, sessions: str) -> tuple[DataFrame, list[str]]:
    e = snapshot_edges(net, g, sessions)
    keys = [k for k in ("session",) if k in e.columns]
    return e.filter(F.col("from") != F.col("to")).select(*keys, "bin", "from", "to"), keys


def metrics(net: Network, measures: list[str] | None = None, sessions: str = "bounded", **grid) -> DataFrame:
    """``[session,] time, measure, value`` of every window.

    Measures of degrees, dyads, triads and weak components are joins and sums; those
    that need ways deal the ends of ways to tasks, which have a window's arcs (`ways`);
    only lubness takes a snapshot to a task as a matrix.  A window in which no vertex is
    eligible has rows too, as stated in `EMPTY`.
    """
    asked = list(measures or [m for m in TABLE if net.directed or m not in DIRECTED_ONLY])
    exact = ("temporal_density", "observed_pair_density", "onset_intensity", "observed_pair_onset_intensity")
    if unknown := [m for m in asked if m not in (*TABLE, *KERNEL, *exact, "concurrent_nodes", "concurrent_share")]:
        raise UnknownMeasure(f"unknown measures {unknown}")
    if not net.directed and (bad := DIRECTED_ONLY.intersection(asked)):
        raise NeedsDirected(f"{sorted(bad)} need a directed network")
    g = make_grid(net, **grid)
    e, keys = _pairs(net, g, sessions)
    parts = []
    if any(m in TABLE for m in asked):
        wide = _table_measures(net, g, e, keys, asked)
        cols = [m for m in asked if m in TABLE]
        parts.append(wide.unpivot([*keys, "time"], cols, "measure", "value"))
    if any(m in S.OF_COMPONENTS or m == "triads" for m in asked):
        parts += _join_measures(net, g, e, keys, asked)
    if dense := [m for m in asked if m in KERNEL and m not in S.OF_COMPONENTS and m != "triads"]:
        parts += _way_measures(net, g, e, keys, dense)
    if any(m.startswith("concurrent") for m in asked):
        parts.append(_concurrency(net, g, [m for m in asked if m.startswith("concurrent")], keys, sessions))
    if any(m in exact for m in asked):
        from kairograph.operators.dynamics import exposure

        wide = exposure(net, **grid)
        parts.append(wide.unpivot(["time"], [m for m in asked if m in exact], "measure", "value"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _table_measures(net: Network, g: Grid, e: DataFrame, keys: list[str], asked: list[str]) -> DataFrame:
    at = [*keys, "bin"]
    population = eligible(net, g).groupBy("bin").agg(F.count("*").alias("n"))
    base = _rectangle(net, g, e.groupBy(*at).agg(F.count("*").alias("m")), keys).join(population, "bin", "left")
    n, m = F.coalesce("n", F.lit(0)), F.coalesce("m", F.lit(0))
    base = base.select(*at, "time", n.cast("double").alias("n"), m.cast("double").alias("m"))
    ends = e.select(*at, F.col("from").alias("v"), F.lit(1).alias("o"), F.lit(0).alias("i")).unionByName(e.select(*at, F.col("to").alias("v"), F.lit(0).alias("o"), F.lit(1).alias("i")))
    deg = ends.groupBy(*at, "v").agg(F.sum("o").cast("double").alias("o"), F.sum("i").cast("double").alias("i"))
    total = F.col("o") + F.col("i")
    pair = lambda x: x * (x - 1) / 2
    sums = deg.groupBy(*at).agg(
        F.count("*").cast("double").alias("act"), F.sum(total).alias("d1"), F.sum(total * total).alias("d2"), F.max(total).alias("dmax"), F.min(total).alias("dmin"), F.sum("o").alias("o1"),
        F.sum(F.pow("i", F.lit(1.5))).alias("i15"), F.sum(F.pow("o", F.lit(1.5))).alias("o15"), F.sum(pair(F.col("i"))).alias("i2"), F.sum(pair(F.col("o"))).alias("o2"), F.sum(F.col("i") * F.col("o")).alias("io"), F.sum(pair(total)).alias("t2"),
    )
    out = base.join(sums, at, "left")
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    N, M = F.col("n"), F.col("m")
    half = 1.0 if net.directed else 2.0
    act = zero("act")
    mean = ratio(zero("d1"), N)
    values = {
        "density": ratio(M * half, N * (N - 1)),
        "edges": M,
        "active_nodes": act,
        "isolates": N - act,
        "degree_mean": mean,
        "degree_variance": F.when(N > 1, (zero("d2") - N * mean * mean) / F.when(N > 1, N - 1).otherwise(1.0)).otherwise(0.0),
        "degree_min": F.when(act < N, 0.0).otherwise(zero("dmin")),
        "degree_max": zero("dmax"),
        "mean_degree": ratio(M * half, N),
        "indegree_1_5": zero("i15"),
        "outdegree_1_5": zero("o15"),
        "in_2stars": zero("i2"),
        "out_2stars": zero("o2"),
        "centralization_degree": F.when(N >= 3, (N * zero("dmax") - zero("d1")) / F.when(N >= 3, (N - 1) * (2 * N - 4) if net.directed else (N - 1) * (N - 2)).otherwise(1.0)).otherwise(F.lit(None).cast("double")),
    }
    if {"reciprocity", "mutual", "asymmetric", "null", "two_paths"}.intersection(asked) and net.directed:
        back = e.select(*at, F.col("to").alias("from"), F.col("from").alias("to"))
        out = out.join(e.join(back, [*at, "from", "to"]).groupBy(*at).agg(F.count("*").cast("double").alias("rec")), at, "left")
        rec = zero("rec")
        values |= {"reciprocity": ratio(rec, M), "mutual": rec / 2, "asymmetric": M - rec, "null": N * (N - 1) / 2 - rec / 2 - (M - rec), "two_paths": zero("io") - rec}
    else:
        values["two_paths"] = zero("t2")
    if {"transitivity", "triangles"}.intersection(asked):
        both = e if net.directed else e.unionByName(e.select(*keys, "bin", F.col("to").alias("from"), F.col("from").alias("to")))
        one, two = both.select(*at, F.col("from").alias("a"), F.col("to").alias("b")), both.select(*at, F.col("from").alias("b"), F.col("to").alias("c"))
        way = one.join(two, [*at, "b"]).filter("a <> c")
        straight = both.select(*at, F.col("from").alias("a"), F.col("to").alias("c"), F.lit(1.0).alias("hit"))
        round_ = both.select(*at, F.col("from").alias("c"), F.col("to").alias("a"), F.lit(1.0).alias("cyc"))
        closed = way.join(straight, [*at, "a", "c"], "left").join(round_, [*at, "a", "c"], "left").groupBy(*at).agg(F.count("*").cast("double").alias("ways"), F.sum(F.coalesce("hit", F.lit(0.0))).alias("closed"), F.sum(F.coalesce("cyc", F.lit(0.0))).alias("cycles"))
        out = out.join(closed, at, "left")
        values["transitivity"] = ratio(zero("closed"), zero("ways"), 1.0)
        values["triangles"] = zero("cycles") / 3 + zero("closed") if net.directed else zero("closed") / 6
    if "assortativity" in asked:
        d = deg.select(*at, "v", total.alias("d"))
        arcs = e if net.directed else e.unionByName(e.select(*keys, "bin", F.col("to").alias("from"), F.col("from").alias("to")))
        xy = arcs.join(d.select(*at, F.col("v").alias("from"), F.col("d").alias("x")), [*at, "from"]).join(d.select(*at, F.col("v").alias("to"), F.col("d").alias("y")), [*at, "to"])
        s = xy.groupBy(*at).agg(F.count("*").cast("double").alias("k"), F.sum("x").alias("sx"), F.sum("y").alias("sy"), F.sum(F.col("x") * F.col("y")).alias("sxy"), F.sum(F.col("x") * F.col("x")).alias("sxx"), F.sum(F.col("y") * F.col("y")).alias("syy"))
        vx, vy = F.col("k") * F.col("sxx") - F.col("sx") ** 2, F.col("k") * F.col("syy") - F.col("sy") ** 2
        good = (F.col("k") >= 2) & (vx > 0) & (vy > 0)
        out = out.join(s.select(*at, F.when(good, (F.col("k") * F.col("sxy") - F.col("sx") * F.col("sy")) / F.sqrt(F.when(good, vx * vy).otherwise(1.0))).alias("asso")), at, "left")
        values["assortativity"] = F.col("asso")
    return out.select(*keys, "time", *[values[c].cast("double").alias(c) for c in asked if c in TABLE])


def matrix(pdf: pd.DataFrame, names: list[str], directed: bool) -> np.ndarray:
    """The 0/1 matrix of a snapshot's pairs."""
    where = {v: i for i, v in enumerate(names)}
    b = np.zeros((len(names), len(names)))
    if len(pdf):
        b[[where[v] for v in pdf["from"]], [where[v] for v in pdf["to"]]] = 1
        if not directed:
            b = np.maximum(b, b.T)
    np.fill_diagonal(b, 0)
    return b


def per_snapshot(net: Network, g: Grid, e: DataFrame, keys: list[str], fn, schema: str) -> DataFrame:
    """``fn(time, pairs, names)`` on each window's pairs and eligible vertices."""
    people = eligible(net, g).select("bin", "time", F.col("name").alias("from"), F.lit(None).cast("string").alias("to"))
    if keys:
        people = people.crossJoin(net.spells.select("session").distinct())
    both = people.unionByName(e.join(F.broadcast(g.frame(net.spells.sparkSession).select("bin", "time")), "bin").select(*people.columns))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        names = sorted(pdf.loc[pdf["to"].isna(), "from"])
        out = fn(pdf["time"].iloc[0], pdf[pdf["to"].notna()], names)
        for k in keys:
            out[k] = pdf[k].iloc[0]
        return out

    return both.groupBy(*keys, "bin").applyInPandas(run, ", ".join([*(f"{k} string" for k in keys), schema]))


#: What measures of ways are in a window without vertices: null where the quantity has no value.
EMPTY = {"components_strong": 0.0, "mean_distance": None, "diameter": None, "hierarchy": NAN, "lubness": NAN, "centralization_betweenness": None, "centralization_closeness": None}


def _way_measures(net: Network, g: Grid, e: DataFrame, keys: list[str], asked: list[str]) -> list[DataFrame]:
    from kairograph.operators import ways as W

    directed, spark, parts = net.directed, net.spells.sparkSession, []

    def lub(time: float, pdf: pd.DataFrame, names: list[str]) -> pd.DataFrame:
        b = matrix(pdf, names, directed)
        return pd.DataFrame({"time": time, "measure": ["lubness"], "value": [K.lubness(K.distances(b), K.components(b))]})

    if "lubness" in asked:
        parts.append(per_snapshot(net, g, e, keys, lub, "time double, measure string, value double").select(*keys, "time", "measure", "value"))
    if sparse := [m for m in asked if m != "lubness"]:
        found = W.metrics(W.Arcs(net, g, e, keys), sparse, directed)
        parts.append(found.join(F.broadcast(g.frame(spark).select("bin", "time")), "bin").select(*keys, "time", "measure", "value"))
    values = spark.createDataFrame([(m, EMPTY[m]) for m in asked], "measure string, value double")
    nobody = _rectangle(net, g, g.frame(spark).select("bin", "time"), []).join(eligible(net, g).select("bin").distinct(), "bin", "left_anti")
    if keys:
        nobody = net.spells.select("session").distinct().crossJoin(nobody)
    return [*parts, nobody.crossJoin(values).select(*keys, "time", "measure", "value")]


def _join_measures(net: Network, g: Grid, e: DataFrame, keys: list[str], asked: list[str]) -> list[DataFrame]:
    at = [*keys, "bin"]
    n = eligible(net, g).groupBy("bin").agg(F.count("*").cast("double").alias("n"))
    base = _rectangle(net, g, e.select(*at).distinct(), keys).select(*at, "time").join(n, "bin", "left").na.fill(0.0, ["n"])
    e, parts = e.distinct(), []
    if wanted := [m for m in asked if m in S.OF_COMPONENTS]:
        got = S.component_measures(e, base.select(*at, "n"), at, net.directed)
        parts.append(got.join(base.select(*at, "time"), at).unpivot([*keys, "time"], wanted, "measure", "value"))
    if "triads" in asked:
        both = e if net.directed else e.unionByName(e.select(*keys, "bin", F.col("to").alias("from"), F.col("from").alias("to")))
        got = S.triads(both, base.select(*at, "n"), at).withColumnsRenamed({c: f"triad_{c}" for c in S.CLASSES})
        parts.append(got.join(base.select(*at, "time"), at).unpivot([*keys, "time"], [f"triad_{c}" for c in S.CLASSES], "measure", "value"))
    return parts


def _concurrency(net: Network, g: Grid, asked: list[str], keys: list[str], sessions: str) -> DataFrame:
    """Vertices with ties to two others at one instant of the window.

    Ties to one neighbour are put together, then a vertex's beginnings and ends are
    added up in order.  A stretch ends before another begins at the same time; a point
    meets both.
    """
    from kairograph.functions.islands import islands
    from kairograph.plans.grid import active

    at = [*keys, "bin"]
    a = active(net, g, sessions).select(*at, "from", "to", F.greatest("start", "lo").alias("start"), F.least("end", "hi").alias("end"))
    arcs = a.select(*at, F.col("from").alias("v"), F.col("to").alias("w"), "start", "end").unionByName(a.select(*at, F.col("to").alias("v"), F.col("from").alias("w"), "start", "end"))
    s = islands(arcs, [*at, "v", "w"]).withColumn("point", (F.col("start") == F.col("end")).cast("int"))
    on = F.struct(F.col("start").alias("t"), (2 - 2 * F.col("point")).alias("turn"), F.lit(1).alias("d"))
    off = F.struct(F.col("end").alias("t"), (1 + 2 * F.col("point")).alias("turn"), F.lit(-1).alias("d"))
    steps = s.select(*at, "v", F.explode(F.array(on, off)).alias("x")).select(*at, "v", "x.*")
    run = Window.partitionBy(*at, "v").orderBy("t", "turn").rowsBetween(Window.unboundedPreceding, 0)
    busy = steps.withColumn("held", F.sum("d").over(run)).filter("held >= 2").select(*at, "v").distinct()
    counts = busy.groupBy(*at).agg(F.count("*").cast("double").alias("c"))
    n = eligible(net, g).groupBy("bin").agg(F.count("*").cast("double").alias("n"))
    out = _rectangle(net, g, counts, keys).join(n, "bin", "left")
    c = F.coalesce("c", F.lit(0.0))
    return out.select(*keys, "time", c.alias("concurrent_nodes"), ratio(c, F.coalesce("n", F.lit(0.0))).alias("concurrent_share")).unpivot([*keys, "time"], asked, "measure", "value")
