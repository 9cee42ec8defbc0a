"""Comparison of windows: similarity, turnover, persistence, segregation, projection, phases."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kairograph.errors import BadInput, UnknownMeasure
from kairograph.operators.snapshots import ratio
from kairograph.plans.grid import eligible, make_grid, snapshot_edges
from kairograph.plans.network import Network


def _layers(net: Network, grid: dict) -> tuple[DataFrame, DataFrame, float]:
    g = make_grid(net, **grid)
    e = snapshot_edges(net, g).filter(F.col("from") != F.col("to")).select("bin", "from", "to")
    n = net.nodes.count()
    return g.frame(net.spells.sparkSession).select("bin", "time"), e, n * (n - 1) / (1 if net.directed else 2)


def _overlaps(bins: DataFrame, e: DataFrame) -> DataFrame:
    """``bin1, bin2, a, b, i``: sizes of two layers and of what they share, for all pairs of windows.

    Windows are few (a parameter); shared pairs come from a join on the pair.
    """
    size = bins.join(e.groupBy("bin").agg(F.count("*").cast("double").alias("a")), "bin", "left").select("bin", "time", F.coalesce("a", F.lit(0.0)).alias("a"))
    one, two = (e.withColumnRenamed("bin", f"bin{k}") for k in (1, 2))
    shared = one.join(two, ["from", "to"]).groupBy("bin1", "bin2").agg(F.count("*").cast("double").alias("i"))
    p = size.select(F.col("bin").alias("bin1"), F.col("time").alias("time1"), "a")
    q = size.select(F.col("bin").alias("bin2"), F.col("time").alias("time2"), F.col("a").alias("b"))
    return p.crossJoin(F.broadcast(q)).join(shared, ["bin1", "bin2"], "left").withColumn("i", F.coalesce("i", F.lit(0.0)))


def similarity(net: Network, method: str = "jaccard", **grid) -> DataFrame:
    """``time1, time2, value`` of every pair of windows, both ways and with themselves."""
    bins, e, size = _layers(net, grid)
    i, a, b, n = F.col("i"), F.col("a"), F.col("b"), F.lit(float(size))
    missing = F.lit(None).cast("double")
    safe = lambda num, den: F.when(den > 0, num / F.when(den > 0, den).otherwise(1.0)).otherwise(missing)
    values = {
        "jaccard": safe(i, a + b - i),
        "overlap": safe(i, F.least(a, b)),
        "hamming": a + b - 2 * i,
        "cosine": safe(i, F.sqrt(a * b)),
        "pearson": safe(n * i - a * b, F.sqrt(a * (n - a) * b * (n - b))),
    }
    if method not in values:
        raise UnknownMeasure(method)
    return _overlaps(bins, e).select("time1", "time2", values[method].alias("value"))


def turnover(net: Network, **grid) -> DataFrame:
    """``time, volatility``: share of pairs that change to the next window."""
    bins, e, size = _layers(net, grid)
    o = _overlaps(bins, e).filter("bin2 = bin1 + 1")
    return o.select(F.col("time1").alias("time"), ((F.col("a") + F.col("b") - 2 * F.col("i")) / F.lit(float(size))).alias("volatility"))


def fluctuability(net: Network, **grid) -> DataFrame:
    """``fluctuability``: distinct pairs over activations."""
    _, e, _ = _layers(net, grid)
    return e.agg(F.countDistinct("from", "to").alias("p"), F.count("*").alias("n")).select(F.when(F.col("n") > 0, F.col("p") / F.greatest(F.col("n"), F.lit(1))).alias("fluctuability"))


def persistence(net: Network, scope: str = "pertime", **grid) -> DataFrame:
    """Topological overlap of neighbourhoods in following windows, directions dropped."""
    bins, e, _ = _layers(net, grid)
    both = e.select("bin", F.col("from").alias("node"), F.col("to").alias("w")).unionByName(e.select("bin", F.col("to").alias("node"), F.col("from").alias("w"))).distinct()
    k = both.groupBy("bin", "node").agg(F.count("*").cast("double").alias("k"))
    later = both.select((F.col("bin") - 1).alias("bin"), "node", "w")
    shared = both.join(later, ["bin", "node", "w"]).groupBy("bin", "node").agg(F.count("*").cast("double").alias("s"))
    now = k.join(k.select((F.col("bin") - 1).alias("bin"), "node", F.col("k").alias("k2")), ["bin", "node"])
    value = now.join(shared, ["bin", "node"], "left").select("bin", "node", (F.coalesce("s", F.lit(0.0)) / F.sqrt(F.col("k") * F.col("k2"))).alias("o"))
    last = bins.agg(F.max("bin").alias("m"))
    frame = net.nodes.select(F.col("name").alias("node")).crossJoin(F.broadcast(bins.crossJoin(last).filter("bin < m").drop("m")))
    rows = frame.join(value, ["bin", "node"], "left").select("time", "node", F.coalesce("o", F.lit(0.0)).alias("overlap"))
    if scope == "pertime":
        return rows
    if scope == "node":
        return rows.groupBy("node").agg(F.avg("overlap").alias("overlap"))
    if scope == "overall":
        return rows.agg(F.avg("overlap").alias("overlap"))
    raise BadInput(f"unknown scope {scope!r}")


def segregation(net: Network, membership: DataFrame | str, **grid) -> DataFrame:
    """``time, value``: ties inside groups against ties between them; missing if a group has one member."""
    bins, e, _ = _layers(net, grid)
    label = net.nodes.select(F.col("name").alias("node"), F.col(membership).cast("string").alias("c")) if isinstance(membership, str) else membership.select("node", F.col("community").cast("string").alias("c"))
    size = label.groupBy("c").agg(F.count("*").cast("double").alias("n"))
    und = e.select("bin", F.least("from", "to").alias("a"), F.greatest("from", "to").alias("b")).distinct()
    ends = und.join(label.select(F.col("node").alias("a"), F.col("c").alias("ca")), "a").join(label.select(F.col("node").alias("b"), F.col("c").alias("cb")), "b")
    ends = ends.join(F.broadcast(size.select(F.col("c").alias("ca"), F.col("n").alias("na"))), "ca").join(F.broadcast(size.select(F.col("c").alias("cb"), F.col("n").alias("nb"))), "cb")
    inside = F.col("ca") == F.col("cb")
    term = F.when(inside, 2.0 / F.when(F.col("na") > 1, F.col("na") * (F.col("na") - 1)).otherwise(1.0)).otherwise(-2.0 / (F.col("na") * F.col("nb")))
    sums = ends.groupBy("bin").agg(F.sum(term).alias("v"))
    single = size.agg((F.min("n") < 2).alias("single"))
    return bins.join(sums, "bin", "left").crossJoin(single).select("time", F.when(~F.col("single"), F.coalesce("v", F.lit(0.0))).alias("value"))


def projection(net: Network, coupling: str = "ordinal", omega: float = 1.0, **grid) -> tuple[DataFrame, DataFrame]:
    """The time-expanded graph: ``state, node, bin`` and ``from_state, to_state, kind, weight``."""
    g = make_grid(net, **grid)
    there = eligible(net, g).select("bin", "time", F.col("name").alias("node"))
    state = lambda v, b: F.concat(v, F.lit("@"), b.cast("string"))
    vertices = there.select(state(F.col("node"), F.col("bin")).alias("state"), "node", "bin", "time")
    e = snapshot_edges(net, g, loops=True)
    arcs = e.select("bin", "from", "to", "weight")
    if not net.directed:
        arcs = arcs.unionByName(e.filter(F.col("from") != F.col("to")).select("bin", F.col("to").alias("from"), F.col("from").alias("to"), "weight"))
    within = arcs.select(state(F.col("from"), F.col("bin")).alias("from_state"), state(F.col("to"), F.col("bin")).alias("to_state"), F.lit("within").alias("kind"), "weight")
    later = there.select("node", F.col("bin").alias("bin2"))
    step = F.col("bin2") == F.col("bin") + 1 if coupling == "ordinal" else F.col("bin2") > F.col("bin")
    if coupling not in ("ordinal", "categorical"):
        raise BadInput("coupling is ordinal or categorical")
    identity = there.join(later, "node").filter(step).select(state(F.col("node"), F.col("bin")).alias("from_state"), state(F.col("node"), F.col("bin2")).alias("to_state"), F.lit("identity").alias("kind"), F.lit(float(omega)).alias("weight"))
    return vertices, within.unionByName(identity)


def best_segments(d: np.ndarray, k: int) -> list[int]:
    """The contiguous split into ``k`` with the least scatter, by dynamic programming."""
    n = len(d)
    cost = np.full((n, n), 0.0)
    for i in range(n):
        for j in range(i + 1, n):
            block = d[i : j + 1, i : j + 1]
            cost[i, j] = (block**2).sum() / 2 / (j - i + 1)
    best = np.full((k + 1, n + 1), np.inf)
    cut = np.zeros((k + 1, n + 1), int)
    best[0, 0] = 0
    for p in range(1, k + 1):
        for j in range(p, n + 1):
            options = [best[p - 1, i] + cost[i, j - 1] for i in range(p - 1, j)]
            cut[p, j] = int(np.argmin(options)) + p - 1
            best[p, j] = options[cut[p, j] - p + 1]
    ends, j = [], n
    for p in range(k, 0, -1):
        ends.append(j)
        j = cut[p, j]
    label, start = [], 0
    for i, end in enumerate(reversed(ends)):
        label += [i + 1] * (end - start)
        start = end
    return label


def agglomerate(d: np.ndarray, k: int, linkage: str) -> list[int]:
    """Clusters by joining the nearest two until ``k`` are left."""
    groups = [[i] for i in range(len(d))]
    dist = {(i, j): float(d[i, j]) for i in range(len(d)) for j in range(i)}
    dist = {k2: v**2 if linkage == "ward" else v for k2, v in dist.items()}
    alive = set(range(len(d)))
    while len(alive) > k:
        i, j = min(((a, b) for a in alive for b in alive if b < a), key=lambda p: (dist[p], p[1], p[0]))
        ni, nj = len(groups[i]), len(groups[j])
        for m in alive - {i, j}:
            a, b = dist[max(i, m), min(i, m)], dist[max(j, m), min(j, m)]
            nm = len(groups[m])
            if linkage == "ward":
                v = ((ni + nm) * a + (nj + nm) * b - nm * dist[i, j]) / (ni + nj + nm)
            elif linkage == "average":
                v = (ni * a + nj * b) / (ni + nj)
            else:
                v = max(a, b)
            dist[max(j, m), min(j, m)] = v
        groups[j] += groups[i]
        alive.discard(i)
    label = [0] * len(d)
    for n, g in enumerate(sorted((groups[a] for a in alive), key=min)):
        for i in g:
            label[i] = n + 1
    return label


def silhouette(d: np.ndarray, label: list[int]) -> float:
    """Mean silhouette; singletons take no part."""
    lab, out = np.array(label), []
    for i in range(len(d)):
        own = (lab == lab[i]).sum()
        if own < 2:
            continue
        a = d[i, lab == lab[i]].sum() / (own - 1)
        b = min(d[i, lab == c].mean() for c in set(label) - {label[i]})
        out.append((b - a) / max(a, b) if max(a, b) > 0 else 0.0)
    return float(np.mean(out)) if out else float("nan")


def phase_profile(net: Network, method: str = "jaccard", cluster: str = "contiguous", k_max: int = 6, **grid) -> DataFrame:
    """``k, silhouette_mean, within_ss, n_singletons`` of the groupings that `phases` chooses from."""
    spark: SparkSession = net.spells.sparkSession
    _, d = _window_distances(net, method, grid)
    rows = []
    for k in range(2, min(k_max, len(d) - 1) + 1):
        label = np.array(best_segments(d, k) if cluster == "contiguous" else agglomerate(d, k, cluster))
        within = sum(float((d[np.ix_(label == c, label == c)] ** 2).sum()) / 2 / int((label == c).sum()) for c in set(label.tolist()))
        rows.append((k, silhouette(d, label.tolist()), within, int(sum((label == c).sum() == 1 for c in set(label.tolist())))))
    return spark.createDataFrame(rows, "k int, silhouette_mean double, within_ss double, n_singletons int")


def _window_distances(net: Network, method: str, grid: dict) -> tuple[list[float], np.ndarray]:
    """Times and unlikeness of windows, which are few, on the driver."""
    pdf = similarity(net, method, **grid).toPandas().sort_values(["time1", "time2"])
    times = sorted(pdf["time1"].unique())
    n = len(times)
    if n < 3:
        raise BadInput("phases need three windows or more")
    s = pdf["value"].fillna(0.0).to_numpy().reshape(n, n)
    d = s / max(s.max(), 1.0) if method == "hamming" else 1 - s
    np.fill_diagonal(d, 0)
    return times, d


def phases(net: Network, method: str = "jaccard", cluster: str = "contiguous", k: int | None = None, k_max: int = 6, **grid) -> DataFrame:
    """``time, phase``: windows grouped by likeness; windows are few and gathered on the driver."""
    spark: SparkSession = net.spells.sparkSession
    times, d = _window_distances(net, method, grid)
    n = len(times)
    split = (lambda c: best_segments(d, c)) if cluster == "contiguous" else (lambda c: agglomerate(d, c, cluster))
    counts = [k] if k else range(2, min(k_max, n - 1) + 1)
    label = max((split(c) for c in counts), key=lambda x: (v if (v := silhouette(d, x)) == v else -2.0))
    return spark.createDataFrame([(float(t), int(p)) for t, p in zip(times, label, strict=True)], "time double, phase int")


def multislice_modularity(net: Network, membership: DataFrame, omega: float = 1.0, gamma: float = 1.0, **grid) -> DataFrame:
    """``q, q_intra, q_inter, two_mu`` of ``membership(time, node, community)`` over windows."""
    g = make_grid(net, **grid)
    bins = g.frame(net.spells.sparkSession).select("bin", "time")
    e = snapshot_edges(net, g).filter(F.col("from") != F.col("to"))
    und = e.groupBy("bin", F.least("from", "to").alias("u"), F.greatest("from", "to").alias("v")).agg(F.sum("weight").alias("w"))
    arcs = und.select("bin", F.col("u").alias("node"), F.col("v").alias("other"), "w").unionByName(und.select("bin", F.col("v").alias("node"), F.col("u").alias("other"), "w"))
    c = membership.join(F.broadcast(bins), "time").select("bin", "node", F.col("community").cast("string").alias("c"))
    k = arcs.groupBy("bin", "node").agg(F.sum("w").alias("k"))
    two_m = k.groupBy("bin").agg(F.sum("k").alias("m"))
    inside = arcs.join(c, ["bin", "node"]).join(c.select("bin", F.col("node").alias("other"), F.col("c").alias("c2")), ["bin", "other"]).filter("c = c2").agg(F.coalesce(F.sum("w"), F.lit(0.0)).alias("inside"))
    null = k.join(c, ["bin", "node"]).groupBy("bin", "c").agg(F.sum("k").alias("k")).join(two_m, "bin").agg(F.coalesce(F.sum(F.col("k") * F.col("k") / F.col("m")), F.lit(0.0)).alias("null"))
    nxt = c.select((F.col("bin") - 1).alias("bin"), "node", F.col("c").alias("c2"))
    links = c.join(nxt, ["bin", "node"]).agg(F.count("*").cast("double").alias("links"), F.count(F.when(F.col("c") == F.col("c2"), 1)).cast("double").alias("same"))
    total = two_m.agg(F.coalesce(F.sum("m"), F.lit(0.0)).alias("m"))
    one = inside.crossJoin(null).crossJoin(links).crossJoin(total)  # one row each
    mu = F.col("m") + 2 * omega * F.col("links")
    intra, inter = F.col("inside") - gamma * F.col("null"), 2 * omega * F.col("same")
    return one.select(ratio(intra + inter, mu).alias("q"), ratio(intra, mu).alias("q_intra"), ratio(inter, mu).alias("q_inter"), mu.alias("two_mu"))
