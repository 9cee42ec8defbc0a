"""Centrality of vertices in each window."""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kairograph.errors import BadInput, NeedsDirected, UnknownMeasure
from kairograph.operators import kernels as K
from kairograph.operators import ways as W
from kairograph.operators.snapshots import matrix, per_snapshot, ratio
from kairograph.operators.sparse import coreness
from kairograph.plans.grid import active, eligible, make_grid, snapshot_edges
from kairograph.plans.network import Network

BY_MODE = ("degree", "strength", "closeness", "coreness", "harary", "diffusion", "participation")
PLAIN = ("betweenness", "eigenvector", "pagerank", "hub", "authority", "constraint", "power", "information", "load", "flow_betweenness")
PRESTIGE = ("indegree", "indegree.rownorm", "indegree.rowcolnorm", "domain", "domain.proximity", "eigenvector", "eigenvector.rownorm", "eigenvector.colnorm", "eigenvector.rowcolnorm")
JOINS = ("degree", "indegree", "outdegree", "strength", "diffusion", "participation", "coreness")
#: Measures from lists of arcs, and what a vertex without arcs has.
SPARSE = {"closeness": 0.0, "harary": 0.0, "betweenness": 0.0, "pagerank": None, "power": 0.0, "constraint": float("nan")}


def centrality_series(net: Network, measures: list[str], mode: str | list[str] = "all", sessions: str = "bounded", groups: str | None = None, rescale: bool = False, damping: float = 0.85, beta: float = 0.1, spread: float = 1.0, **grid) -> DataFrame:
    """``[session,] time, node, measure, value`` of every vertex and window; null where a vertex is not there.

    Degree, strength, diffusion, participation, coreness and constraint are joins and
    sums; closeness, betweenness and harary deal ends of ways to tasks that have a
    window's arcs, pagerank and power take those to one task; the others take one
    snapshot to a task as a matrix.  ``prestige:<kind>`` names a kind of prestige.
    With several modes, measures that know them are named ``<measure>_<mode>``, but for
    "all".
    """
    modes = [mode] if isinstance(mode, str) else list(dict.fromkeys(mode))
    if not modes or set(modes) - {"all", "in", "out"}:
        raise BadInput("mode must be all, in or out")
    for m in measures:
        known = m in (*BY_MODE, *PLAIN, "indegree", "outdegree") or m.startswith("prestige:") and m[9:] in PRESTIGE
        if not known:
            raise UnknownMeasure(m)
        if not net.directed and (m in ("indegree", "outdegree", "hub", "authority") or m.startswith("prestige")):
            raise NeedsDirected(m)
    g = make_grid(net, **grid)
    edges = snapshot_edges(net, g, sessions)
    keys = [k for k in ("session",) if k in edges.columns]
    base = net.nodes.select(F.col("name").alias("node")).crossJoin(F.broadcast(g.frame(net.spells.sparkSession).select("bin", "time")))  # windows: a parameter's size
    there = eligible(net, g).select("bin", F.col("name").alias("node"), F.lit(True).alias("there"))
    base = base.join(there, ["bin", "node"], "left")
    if keys:
        base = base.crossJoin(net.spells.select("session").distinct())
    parts = []
    arcs = W.Arcs(net, g, edges, keys) if any(m in SPARSE for m in measures) else None
    for m in measures:
        aware = net.directed and m in BY_MODE
        for how in modes if aware else modes[:1]:
            label = f"{m}_{how}" if aware and len(modes) > 1 and how != "all" else m
            if m in JOINS:
                values = _joins(net, g, edges, keys, m, {"indegree": "in", "outdegree": "out"}.get(m, how), sessions, groups, spread)
                empty = F.lit(float("nan") if m == "participation" else 0.0)
            elif m in SPARSE:
                values, empty = _sparse(arcs, m, how, net.directed, damping, beta), F.lit(SPARSE[m]).cast("double")
            else:
                values, empty = _kernels(net, g, edges, keys, m, rescale), F.lit(None).cast("double")
            row = base.join(values, [*keys, "bin", "node"], "left")
            parts.append(row.select(*keys, "time", "node", F.lit(label).alias("measure"), F.when(F.col("there"), F.coalesce("value", empty)).alias("value")))
    return reduce(DataFrame.unionByName, parts)


def _sparse(arcs: W.Arcs, m: str, mode: str, directed: bool, damping: float, beta: float) -> DataFrame:
    """``bin, node, value`` of the vertices that have arcs, for pagerank of all."""
    turned = directed and mode == "in"
    return {
        "closeness": lambda: W.closeness(arcs, turned), "harary": lambda: W.harary(arcs, turned), "betweenness": lambda: W.betweenness(arcs, directed),
        "pagerank": lambda: W.pagerank(arcs, damping), "power": lambda: W.power(arcs, beta), "constraint": lambda: W.constraint(arcs),
    }[m]()


def _kernels(net: Network, g, edges: DataFrame, keys: list[str], m: str, rescale: bool) -> DataFrame:
    """``bin, node, value`` of a measure that needs a whole snapshot."""
    directed = net.directed

    def fn(time: float, pdf: pd.DataFrame, names: list[str]) -> pd.DataFrame:
        b = matrix(pdf, names, directed)
        if m.startswith("prestige:"):
            v = K.prestige(b, m[9:])
            if rescale:
                v = v / v.sum() if v.sum() else v * float("nan")
        else:
            v = {
                "eigenvector": lambda: K.eigenvector(b), "hub": lambda: K.hub(b), "authority": lambda: K.authority(b), "information": lambda: K.information(b), "load": lambda: K.load(b, directed), "flow_betweenness": lambda: K.flow_betweenness(b, directed),
            }[m]()
        return pd.DataFrame({"time": time, "node": names, "value": pd.Series(v, dtype=float)})

    e = edges.filter(F.col("from") != F.col("to")).select(*keys, "bin", "from", "to")
    found = per_snapshot(net, g, e, keys, fn, "time double, node string, value double")
    frame = g.frame(net.spells.sparkSession).select("bin", "time")
    return found.join(F.broadcast(frame), "time").drop("time")


def _arcs(e: DataFrame, keys: list[str], directed: bool, mode: str, *more: str) -> DataFrame:
    """``v, w`` for the ties that ``mode`` counts at ``v``."""
    out = e.select(*keys, "bin", F.col("from").alias("v"), F.col("to").alias("w"), *more)
    back = e.select(*keys, "bin", F.col("to").alias("v"), F.col("from").alias("w"), *more)
    if not directed or mode == "all":
        return out.unionByName(back)
    return out if mode == "out" else back


def _joins(net: Network, g, edges: DataFrame, keys: list[str], m: str, mode: str, sessions: str, groups: str | None, spread: float) -> DataFrame:
    at = [*keys, "bin"]
    arcs = _arcs(edges, keys, net.directed, mode)
    if m in ("degree", "indegree", "outdegree"):
        return arcs.groupBy(*at, F.col("v").alias("node")).agg(F.count("*").cast("double").alias("value"))
    if m == "strength":
        a = active(net, g, sessions)
        whole = F.col("raw_end") - F.col("raw_start")
        overlap = F.least("end", "hi") - F.greatest("start", "lo")
        share = F.when((whole == 0) | F.lit(g.window == 0), 1.0).otherwise(F.least(F.lit(1.0), overlap / F.when(whole == 0, 1.0).otherwise(whole)))
        return _arcs(a.withColumn("x", F.col("weight") * share), keys, net.directed, mode, "x").groupBy(*at, F.col("v").alias("node")).agg(F.sum("x").alias("value"))
    if m == "diffusion":
        deg = arcs.groupBy(*at, "v").agg(F.count("*").cast("double").alias("k"))
        near = arcs.distinct().join(deg.select(*at, F.col("v").alias("w"), F.col("k").alias("kw")), [*at, "w"], "left").groupBy(*at, "v").agg(F.sum(F.coalesce("kw", F.lit(0.0))).alias("s"))
        return deg.join(near, [*at, "v"]).select(*at, F.col("v").alias("node"), (F.lit(spread) * (F.col("k") + F.col("s"))).alias("value"))
    if m == "coreness":
        ties = _arcs(edges.filter(F.col("from") != F.col("to")).select(*keys, "bin", "from", "to").distinct(), keys, net.directed, mode if net.directed else "all")
        return coreness(ties, at).select(*at, F.col("v").alias("node"), F.col("core").cast("double").alias("value"))
    if groups is None:
        raise BadInput("participation needs the name of a grouping column of the vertices")
    label = net.nodes.select(F.col("name").alias("w"), F.col(groups).cast("string").alias("grp"))
    counts = arcs.join(label, "w").groupBy(*at, "v", "grp").agg(F.count("*").cast("double").alias("c"))
    sums = counts.groupBy(*at, F.col("v").alias("node")).agg(F.sum("c").alias("k"), F.sum(F.col("c") * F.col("c")).alias("s"))
    return sums.select(*at, "node", (1 - ratio(F.col("s"), F.col("k") * F.col("k"))).alias("value"))
