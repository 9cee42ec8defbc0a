"""Communities over time: detection, matching, change and trajectories."""

from __future__ import annotations

import math
import warnings

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kairograph.errors import BadInput, BudgetExceeded, UnknownMeasure
from kairograph.operators.snapshots import ratio
from kairograph.plans.grid import eligible, make_grid, snapshot_edges
from kairograph.plans.network import Network

MAX_STATES = 5000


def modularity_matrix(slices: list[np.ndarray], gamma: float, omega: float) -> tuple[np.ndarray, float]:
    """The matrix whose sums inside groups give the quality of a grouping of all states."""
    n, k = len(slices[0]), len(slices)
    b = np.zeros((n * k, n * k))
    total = 0.0
    for s, a in enumerate(slices):
        degree, m2 = a.sum(1), a.sum()
        total += m2
        block = a - (gamma * np.outer(degree, degree) / m2 if m2 else 0)
        b[s * n : s * n + n, s * n : s * n + n] = block
        if s + 1 < k and omega:
            i = np.arange(n)
            b[s * n + i, (s + 1) * n + i] += omega
            b[(s + 1) * n + i, s * n + i] += omega
            total += 2 * omega * n
    return b, total


def louvain(b: np.ndarray, seed: int, most: int = 100, tolerance: float = 1e-10) -> np.ndarray:
    """Labels by local moves and merging on a quality matrix; the order of moves comes from the seed."""
    rng = np.random.default_rng(seed)
    label = np.arange(len(b))
    work, of = b, np.arange(len(b))
    for _ in range(most):
        n = len(work)
        lab, moved_any = np.arange(n), False
        for _ in range(most):
            moved = False
            for u in rng.permutation(n).tolist():
                row = work[u].copy()
                row[u] = 0
                pull = np.bincount(lab, weights=row, minlength=n)
                own = lab[u]
                best = int(pull.argmax())
                if pull[best] > pull[own] + tolerance:
                    lab[u] = best
                    moved = moved_any = True
            if not moved:
                break
        _, lab = np.unique(lab, return_inverse=True)
        label = lab[of] if len(of) == len(label) else label
        of = label
        if not moved_any:
            break
        h = np.zeros((lab.max() + 1, n))
        h[lab, np.arange(n)] = 1
        work = h @ work @ h.T
    _, first = np.unique(label, return_index=True)
    order = {int(label[i]): r for r, i in enumerate(sorted(first.tolist()))}
    return np.array([order[int(x)] for x in label])


def _slices(net: Network, grid: dict) -> tuple[list[str], list[float], list[np.ndarray]]:
    """Weighted matrices of all windows on the driver, within the limit of states."""
    g = make_grid(net, **grid)
    names = sorted(r["name"] for r in net.nodes.select("name").limit(MAX_STATES + 1).collect())
    if len(names) * len(g.bins) > MAX_STATES:
        raise BudgetExceeded(f"more than {MAX_STATES} states of vertex and window")
    where = {v: i for i, v in enumerate(names)}
    out = [np.zeros((len(names), len(names))) for _ in g.bins]
    for r in snapshot_edges(net, g).filter(F.col("from") != F.col("to")).collect():
        a = out[r["bin"] - 1]
        a[where[r["from"]], where[r["to"]]] += r["weight"]
        a[where[r["to"]], where[r["from"]]] += r["weight"]
    return names, [b.lo for b in g.bins], out


def temporal_communities(net: Network, seeds: list[int] | None = None, omega: float = 1.0, gamma: float = 1.0, **grid) -> tuple[DataFrame, DataFrame]:
    """Membership ``time, node, community`` of the best run, and ``seed, q, best`` of all; runs are parallel over seeds."""
    spark = net.spells.sparkSession
    seeds = list(seeds or range(1, 11))
    if len(seeds) == 1:
        warnings.warn("one seed tells nothing of stability", UserWarning, stacklevel=2)
    names, times, slices = _slices(net, grid)
    b, total = modularity_matrix(slices, gamma, omega)
    sent = spark.sparkContext.broadcast(b)  # MAX_STATES squared at most

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = []
        for s in pdf["seed"].tolist():
            lab = louvain(sent.value, int(s))
            q = float((sent.value * (lab[:, None] == lab[None, :])).sum() / total) if total else 0.0
            rows.append((int(s), q, lab.tolist()))
        return pd.DataFrame(rows, columns=["seed", "q", "label"])

    got = sorted(spark.createDataFrame([(s,) for s in seeds], "seed int").groupBy("seed").applyInPandas(run, "seed int, q double, label array<int>").collect(), key=lambda r: (-round(r["q"], 12), r["seed"]))
    best, n = got[0]["label"], len(names)
    rows = [(float(t), names[i], int(best[k * n + i])) for k, t in enumerate(times) for i in range(n)]
    runs = [(r["seed"], r["q"], r["seed"] == got[0]["seed"]) for r in got]
    return spark.createDataFrame(rows, "time double, node string, community int"), spark.createDataFrame(runs, "seed int, q double, best boolean")


def snapshot_communities(net: Network, seed: int = 1, gamma: float = 1.0, **grid) -> DataFrame:
    """``time, node, community`` of each window by itself, one window to a task."""
    g = make_grid(net, **grid)
    e = snapshot_edges(net, g).filter(F.col("from") != F.col("to")).select("bin", "time", "from", "to", "weight")
    people = eligible(net, g).select("bin", "time", F.col("name").alias("from"), F.lit(None).cast("string").alias("to"), F.lit(0.0).alias("weight"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        names = sorted(pdf.loc[pdf["to"].isna(), "from"])
        where = {v: i for i, v in enumerate(names)}
        a = np.zeros((len(names), len(names)))
        for u, v, w in pdf.loc[pdf["to"].notna(), ["from", "to", "weight"]].itertuples(index=False):
            a[where[u], where[v]] += w
            a[where[v], where[u]] += w
        lab = louvain(modularity_matrix([a], gamma, 0.0)[0], seed)
        return pd.DataFrame({"time": pdf["time"].iloc[0], "node": names, "community": lab.astype(int)})

    return people.unionByName(e).groupBy("bin").applyInPandas(run, "time double, node string, community int")


def assign(score: np.ndarray) -> list[tuple[int, int]]:
    """The assignment of rows to columns with the largest sum, by shortest augmenting ways."""
    n, m = score.shape
    if n > m:
        return [(i, j) for j, i in assign(score.T)]
    cost = score.max(initial=0) - score
    u, v, p, way = np.zeros(n + 1), np.zeros(m + 1), np.zeros(m + 1, int), np.zeros(m + 1, int)
    for i in range(1, n + 1):
        p[0], j0 = i, 0
        low, used = np.full(m + 1, np.inf), np.zeros(m + 1, bool)
        while True:
            used[j0] = True
            i0, delta, j1 = p[j0], np.inf, 0
            for j in range(1, m + 1):
                if not used[j]:
                    c = cost[i0 - 1, j - 1] - u[i0] - v[j]
                    if c < low[j]:
                        low[j], way[j] = c, j0
                    if low[j] < delta:
                        delta, j1 = low[j], j
            for j in range(m + 1):
                if used[j]:
                    u[p[j]] += delta
                    v[j] -= delta
                else:
                    low[j] -= delta
            j0 = j1
            if p[j0] == 0:
                break
        while j0:
            p[j0] = p[way[j0]]
            j0 = way[j0]
    return sorted((p[j] - 1, j - 1) for j in range(1, m + 1) if p[j])


def match_communities(membership: DataFrame, measure: str = "jaccard", threshold: float = 0.0) -> tuple[DataFrame, DataFrame]:
    """Labels that follow communities from window to window, and ``time, event, community`` of what became of them.

    Overlaps are joins; the registry of labels is one pass over windows on the
    driver with one row for each pair of communities that share a vertex.
    """
    spark = membership.sparkSession
    m = membership.select("time", "node", F.col("community").cast("string").alias("c"))
    times = [r["time"] for r in m.select("time").distinct().orderBy("time").collect()]
    order = spark.createDataFrame([(t, i) for i, t in enumerate(times)], "time double, k int")
    m = m.join(F.broadcast(order), "time")
    size = {(r["k"], r["c"]): r["n"] for r in m.groupBy("k", "c").agg(F.count("*").alias("n")).collect()}
    nxt = m.select((F.col("k") - 1).alias("k"), "node", F.col("c").alias("c2"))
    shared = {}
    for r in m.join(nxt, ["k", "node"]).groupBy("k", "c", "c2").agg(F.count("*").alias("n")).collect():
        shared.setdefault(r["k"], {})[r["c"], r["c2"]] = r["n"]
    fresh = 0
    label: dict[tuple[int, str], int] = {}
    happened: list[tuple[float, str, int]] = []
    for k, t in enumerate(times):
        now = sorted(c for kk, c in size if kk == k)
        if k == 0:
            for c in now:
                label[0, c] = fresh
                happened.append((t, "born", fresh))
                fresh += 1
            continue
        before = sorted(c for kk, c in size if kk == k - 1)
        over = shared.get(k - 1, {})
        value = lambda a, b: over.get((a, b), 0) / (1 if measure == "intersection" else size[k - 1, a] + size[k, b] - over.get((a, b), 0))  # noqa: E731, B023
        score = np.array([[value(a, b) for b in now] for a in before]).reshape(len(before), len(now))
        taken = {now[j]: before[i] for i, j in assign(score) if score[i, j] > threshold} if score.size else {}
        out_n = {a: sum((a, b) in over for b in now) for a in before}
        in_n = {b: sum((a, b) in over for a in before) for b in now}
        for b in now:
            if b in taken:
                label[k, b] = label[k - 1, taken[b]]
                kind = "split" if out_n[taken[b]] > 1 else "merge" if in_n[b] > 1 else "persist"
            else:
                label[k, b] = fresh
                fresh += 1
                kind = "split" if in_n[b] else "born"
            happened.append((t, kind, label[k, b]))
        for a in before:
            if a not in taken.values():
                happened.append((t, "dissolve", label[k - 1, a]))
    names = spark.createDataFrame([(k, c, v) for (k, c), v in label.items()], "k int, c string, label int")
    return m.join(F.broadcast(names), ["k", "c"]).select("time", "node", F.col("label").alias("community")), spark.createDataFrame(happened, "time double, event string, community int")


def _entropy(n: np.ndarray) -> float:
    p = n[n > 0] / n.sum()
    return float(-(p * np.log(p)).sum())


def expected_information(a: np.ndarray, b: np.ndarray) -> float:
    """Mean mutual information of two groupings with these sizes under random labels."""
    n = int(a.sum())
    lf = [math.lgamma(i + 1) for i in range(n + 1)]
    out = 0.0
    for x in a.astype(int).tolist():
        for y in b.astype(int).tolist():
            for k in range(max(1, x + y - n), min(x, y) + 1):
                w = lf[x] + lf[y] + lf[n - x] + lf[n - y] - lf[n] - lf[k] - lf[x - k] - lf[y - k] - lf[n - x - y + k]
                out += k / n * math.log(n * k / (x * y)) * math.exp(w)
    return out


def compare_groupings(t: np.ndarray) -> dict[str, float]:
    """Likeness of two groupings from their contingency table."""
    n, a, b = t.sum(), t.sum(1), t.sum(0)
    ha, hb = _entropy(a), _entropy(b)
    hit = t > 0
    mi = float((t[hit] / n * np.log(t[hit] * n / np.outer(a, b)[hit])).sum())
    pairs = lambda x: float((x * (x - 1) / 2).sum())
    same, pa, pb, whole = pairs(t), pairs(a), pairs(b), n * (n - 1) / 2
    mean = pa * pb / whole if whole else 0.0
    emi = expected_information(a, b)
    mid = (ha + hb) / 2
    return {
        "nmi": mi / mid if mid > 0 else 1.0,
        "ami": (mi - emi) / (mid - emi) if abs(mid - emi) > 1e-15 else 1.0,
        "vi": ha + hb - 2 * mi,
        "ari": (same - mean) / ((pa + pb) / 2 - mean) if abs((pa + pb) / 2 - mean) > 1e-15 else 1.0,
        "jaccard": same / (pa + pb - same) if pa + pb - same > 0 else 1.0,
        "split_join": float(2 * n - t.max(1).sum() - t.max(0).sum()),
        "iami": (mi - emi) / (mid - emi) if abs(mid - emi) > 1e-15 else 1.0,
        "omega_index": _omega(same, pa, pb, whole),
    }


def _omega(same: float, pa: float, pb: float, whole: float) -> float:
    """Agreement of pairs beyond chance."""
    if not whole:
        return 1.0
    seen, chance = (whole - pa - pb + 2 * same) / whole, (pa * pb + (whole - pa) * (whole - pb)) / whole**2
    return (seen - chance) / (1 - chance) if abs(1 - chance) > 1e-15 else 1.0


def community_change(membership: DataFrame, measures: list[str] | None = None, against: str = "previous") -> DataFrame:
    """``time, [other,] measure, value``: how groupings differ from the previous, the first, or all windows.

    Compared are the vertices that both windows have (``ami`` and ``iami`` are one
    number); ``uami`` takes all that either has, those that are missing being a group
    of their own.  With fewer than two vertices the value is null.
    """
    asked = list(measures or ("nmi", "ami", "vi", "ari", "jaccard", "split_join"))
    m = membership.select("time", "node", F.col("community").cast("string").alias("c"))
    times = m.select("time").distinct()
    w = Window.orderBy("time")
    if against not in ("previous", "first", "all"):
        raise BadInput("against is previous, first or all")
    if against == "all":
        step = times.crossJoin(times.withColumnRenamed("time", "base"))  # pairs of windows are the result
    else:
        step = times.withColumn("base", F.lag("time").over(w) if against == "previous" else F.first("time").over(w))  # one row for each window
    step = step.filter("base is not null and base <> time")
    now = m.join(F.broadcast(step), "time").select("time", "base", "node", "c")
    old = m.withColumnsRenamed({"time": "base", "c": "c0"}).join(F.broadcast(step), "base").select("time", "base", "node", "c0")
    t = now.join(old, ["time", "base", "node"], "full").groupBy("time", "base", "c0", "c").agg(F.count("*").alias("n"))
    if bad := [x for x in asked if x not in ("uami", *compare_groupings(np.eye(2)))]:
        raise UnknownMeasure(str(bad))

    def table(pdf: pd.DataFrame) -> np.ndarray:
        return pdf.pivot(index="c0", columns="c", values="n").fillna(0).to_numpy(float)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        both = pdf.dropna(subset=["c0", "c"])
        got = compare_groupings(table(both)) if both["n"].sum() > 1 else dict.fromkeys(asked)
        if "uami" in asked:
            got["uami"] = compare_groupings(table(pdf.fillna({"c0": "(absent)", "c": "(absent)"})))["ami"] if pdf["n"].sum() > 1 else None
        return pd.DataFrame({"time": pdf["time"].iloc[0], "other": pdf["base"].iloc[0], "measure": asked, "value": pd.Series([got[x] for x in asked], dtype=float)})

    out = t.groupBy("time", "base").applyInPandas(run, "time double, other double, measure string, value double")
    return out if against == "all" else out.drop("other")


def community_trajectory(membership: DataFrame) -> DataFrame:
    """``node, flexibility, promiscuity, persistence`` of vertices through labelled windows."""
    m = membership.select("time", "node", F.col("community").cast("string").alias("c"))
    total = m.agg(F.countDistinct("c").alias("all"))
    w = Window.partitionBy("node").orderBy("time")
    rows = m.withColumn("old", F.lag("c").over(w))
    g = rows.groupBy("node").agg(F.count("old").alias("steps"), F.count(F.when(F.col("old") != F.col("c"), 1)).alias("moves"), F.countDistinct("c").alias("labels"))
    return g.crossJoin(total).select("node", ratio(F.col("moves"), F.col("steps"), float("nan")).alias("flexibility"), ratio(F.col("labels"), F.col("all"), float("nan")).alias("promiscuity"), (1 - ratio(F.col("moves"), F.col("steps"), float("nan"))).alias("persistence"))


def allegiance(membership: DataFrame) -> DataFrame:
    """``node1, node2, value`` of all ordered pairs: share of windows in which two vertices have one label.

    Pairs that never meet have 0; a vertex with itself has null.
    """
    m = membership.select("time", "node", F.col("community").cast("string").alias("c"))
    n = m.agg(F.countDistinct("time").alias("n"))
    a, b = m.withColumnRenamed("node", "node1"), m.withColumnRenamed("node", "node2")
    met = a.join(b, ["time", "c"]).filter("node1 <> node2").groupBy("node1", "node2").agg(F.count("*").alias("k"))
    names = m.select("node").distinct()
    every = names.withColumnRenamed("node", "node1").crossJoin(names.withColumnRenamed("node", "node2"))  # all pairs are the result
    return every.join(met, ["node1", "node2"], "left").crossJoin(n).select("node1", "node2", F.when(F.col("node1") != F.col("node2"), F.coalesce("k", F.lit(0)) / F.col("n")).alias("value"))
