"""Measures of snapshots by ways, from lists of arcs: no matrix of a window is formed.

A window's vertices are dealt into parts, and a task takes the window's arcs (two numbers
each, compressed to one value on their way) and one part of the ends of ways, or of their
beginnings; what the parts find is added up by Spark.  A task's memory is that of a
window's arcs and of a block of bits.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kairograph.functions.packing import packed, unpacked
from kairograph.plans.grid import Grid, eligible
from kairograph.plans.network import Network
from kairograph.plans.storage import keep

#: Ends of ways that are searched side by side, one bit each.
BLOCK = 4096
#: Most parts of a window.
PARTS = 48
#: Arcs of one vertex that are followed side by side with those of others.
RANKS = 64
#: Vertices whose bits are joined side by side: few enough to stay in a processor's cache.
ROWS = 512
#: Arcs of a task, counted once for each part, where windows are many.
ARCS = 100_000
#: Vertices of a window, once for each beginning that is searched beside others.
STATES = 1 << 16
#: Vertices up to which a system of equations is solved as a whole.
WHOLE = 1024


class Arcs:
    """Numbered arcs of all windows; ``at`` names what tells windows apart."""

    def __init__(self, net: Network, g: Grid, e: DataFrame, keys: list[str]) -> None:
        self.at, self.spark = [*keys, "bin"], net.spells.sparkSession
        self.names = keep(net.nodes.select("name", F.monotonically_increasing_id().alias("id")), "numbers")
        pairs = e.filter(F.col("from") != F.col("to")).select(*self.at, "from", "to").distinct()
        end = lambda c, i: self.names.select(F.col("name").alias(c), F.col("id").alias(i))
        arcs = pairs.join(end("from", "a"), "from").join(end("to", "b"), "to").select(*self.at, "a", "b")
        if not net.directed:
            arcs = arcs.unionByName(arcs.select(*self.at, F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
        self.arcs = keep(arcs, "arcs")
        people = eligible(net, g).groupBy("bin").agg(F.count("*").cast("double").alias("n"))
        self.population = keep(people.crossJoin(net.spells.select("session").distinct()) if keys else people, "population")
        self.parts = max(1, min(PARTS, -(-self.names.count() // BLOCK)))

    @cached_property
    def windows(self) -> DataFrame:
        """``at, n, arcs``: each window's arcs as one compressed value."""
        at = self.at
        rows = self.arcs.join(F.broadcast(self.population), at)  # a row for each window
        kinds = ", ".join(f"{k} {'int' if k == 'bin' else 'string'}" for k in at)

        def pack(t: pa.Table) -> pa.Table:
            return pa.table({**{k: t[k].slice(0, 1) for k in [*at, "n"]}, "arcs": pa.array([packed(t, ["a", "b"])], pa.binary())})

        return keep(rows.groupBy(*at).applyInArrow(pack, f"{kinds}, n double, arcs binary"), "windows")

    def dealt(self, fn, schema: str, parts: int) -> DataFrame:
        """``at`` and what ``fn(a, b, part, parts, n)`` finds in each window and part."""
        at, kinds = self.at, ", ".join(f"{k} {'int' if k == 'bin' else 'string'}" for k in self.at)
        least = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        tasks = max(least, min(self.windows.count() * parts, self.arcs.count() * parts // ARCS))
        rows = self.windows.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))).repartition(tasks)

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                for row in pdf.to_dict("records"):
                    arcs = unpacked([row["arcs"]], ["a", "b"])
                    out = fn(arcs["a"].to_numpy(), arcs["b"].to_numpy(), row["part"], parts, row["n"])
                    for k in at:
                        out[k] = row[k]
                    yield out

        return rows.mapInPandas(run, f"{kinds}, {schema}")

    def named(self, df: DataFrame) -> DataFrame:
        return df.join(self.names, "id").select(*self.at, F.col("name").alias("node"), "value")

    def reach(self, turned: bool = False) -> DataFrame:
        """``at, id, reached, total, far``: vertices that one reaches, the sum of steps to them, and the most steps."""

        def fn(a, b, part, parts, n):
            return reached(*((b, a) if turned else (a, b)), part, parts)

        found = self.dealt(fn, "id long, reached double, total double, far double", self.parts)
        return found.groupBy(*self.at, "id").agg(F.sum("reached").alias("reached"), F.sum("total").alias("total"), F.max("far").alias("far"))

    def between(self, directed: bool) -> DataFrame:
        """``at, id, value``: shares of shortest ways."""
        half = 1.0 if directed else 0.5

        def fn(a, b, part, parts, n):
            return between(a, b, part, parts, half)

        return self.dealt(fn, "id long, value double", max(self.parts, min(PARTS, self.names.count() // 256))).groupBy(*self.at, "id").agg(F.sum("value").alias("value"))

    def strong(self) -> DataFrame:
        """``at, inside, strong, mutual``: vertices with arcs, the strong components they form, and pairs within these."""

        def fn(a, b, part, parts, n):
            sizes = strong_sizes(a, b)
            return pd.DataFrame({"inside": [float(sizes.sum())], "strong": [float(len(sizes))], "mutual": [float((sizes * (sizes - 1)).sum() / 2)]})

        return self.dealt(fn, "inside double, strong double, mutual double", 1)


def _dense(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    ids, codes = np.unique(np.concatenate([a, b]), return_inverse=True)
    return ids, codes[: len(a)], codes[len(a) :]


def _groups(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Beginnings and lengths of the runs of equal numbers, the longest first."""
    first = np.concatenate([[0], np.flatnonzero(np.diff(x)) + 1])
    size = np.diff(np.append(first, len(x)))
    order = np.argsort(-size, kind="stable")
    return first[order], size[order]


def _joined(front: np.ndarray, w: np.ndarray, first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """For each group of arcs, the longest first, the bits at their ends."""
    bits = front[w[first]]
    top = np.searchsorted(-size, -RANKS)  # longer groups go one by one
    for j, (f, s) in enumerate(zip(first[:top].tolist(), size[:top].tolist(), strict=True)):
        for k in range(f, f + s, ROWS):
            bits[j] |= np.bitwise_or.reduce(front[w[k : min(k + ROWS, f + s)]], axis=0)
    for r in range(1, int(size[top]) if top < len(size) else 0):
        longer = np.searchsorted(-size, -r)
        bits[top:longer] |= front[w[first[top:longer] + r]]
    return bits


def reached(a: np.ndarray, b: np.ndarray, part: int, parts: int) -> pd.DataFrame:
    """Who reaches the ends of this part, in how many steps: every end is a bit that goes back along arcs."""
    ids, a, b = _dense(a, b)
    n = len(ids)
    order = np.argsort(a, kind="stable")
    a, b = a[order], b[order]
    every = (a, b, *_groups(a))
    count, total, far = np.zeros(n), np.zeros(n), np.zeros(n)
    ends = np.unique(b)[part::parts]
    for at in range(0, len(ends), BLOCK):
        some = ends[at : at + BLOCK]
        i = np.arange(len(some))
        front = np.zeros((n, -(-len(some) // 64)), np.uint64)
        front[some, i // 64] = np.uint64(1) << (i % 64).astype(np.uint64)
        seen, nxt, live, was, steps = front.copy(), np.zeros_like(front), np.zeros(n, bool), some[:0], 0
        live[some] = True
        while (hot := live[b]).any():
            steps += 1
            # Arcs to ends without bits add nothing; they are sorted out where they are most.
            few = 2 * np.count_nonzero(hot) < len(b)
            u, w, first, size = (a[hot], b[hot], *_groups(a[hot])) if few else every
            nxt[was] = 0
            new = np.zeros(n, np.int64)
            for k in range(0, len(first), ROWS):
                v = u[first[k : k + ROWS]]
                bits = _joined(front, w, first[k : k + ROWS], size[k : k + ROWS]) & ~seen[v]
                seen[v] |= bits
                nxt[v] = bits
                new[v] = np.bitwise_count(bits).sum(1, dtype=np.int64)
            was, live = np.flatnonzero(live), new > 0
            front, nxt = nxt, front
            count += new
            total += new * steps
            far[live] = np.maximum(far[live], steps)
    hit = count > 0
    return pd.DataFrame({"id": ids[hit], "reached": count[hit], "total": total[hit], "far": far[hit]})


def between(a: np.ndarray, b: np.ndarray, part: int, parts: int, half: float) -> pd.DataFrame:
    """Shares of shortest ways from the beginnings of this part, counted out and carried back step by step."""
    ids, a, b = _dense(a, b)
    n = len(ids)
    order = np.argsort(a, kind="stable")
    a, b = a[order], b[order]
    start = np.searchsorted(a, np.arange(n + 1))
    degree = np.diff(start)
    out = np.zeros(n)
    begins = np.flatnonzero(degree)[part::parts]
    if 2 * n > STATES:
        for s in begins:
            _from_one(a, b, start, int(s), out)
        hit = out > 0
        return pd.DataFrame({"id": ids[hit], "value": out[hit] * half})
    # A vertex met from the i-th beginning is number i * n and up, so many beginnings go side by side.
    side = max(1, min(len(begins), STATES // n))
    seen, slot = np.zeros(side * n, bool), np.zeros(side * n, np.int64)
    ways, more, pull = np.zeros(side * n), np.zeros(side * n), np.zeros(side * n)
    for at in range(0, len(begins), side):
        some = begins[at : at + side]
        front = some + np.arange(len(some)) * n
        seen[front], ways[front] = True, 1.0
        layers, met = [], [front]
        while len(front):
            v = front % n
            d = degree[v]
            u = np.repeat(front, d)
            w = b[np.arange(len(u)) + np.repeat(start[v] - (np.cumsum(d) - d), d)] + np.repeat(front - v, d)
            fresh = ~seen[w]
            u, w = u[fresh], w[fresh]
            # All new ends of a step lie one step further, however many arcs lead to them; one arc of each stands for it.
            turn = np.arange(len(w))
            slot[w] = turn
            front = w[slot[w] == turn]
            seen[front] = True
            np.add.at(ways, w, ways[u])
            layers.append((u, w))
            met.append(front)
        for (u, w), far in zip(reversed(layers), reversed(met[1:]), strict=True):
            pull[far] = 1 / ways[far] + more[far]
            np.add.at(more, u, pull[w])
        more[met[0]] = 0
        every = np.concatenate(met)
        np.add.at(out, every % n, ways[every] * more[every])
        seen[every], ways[every], more[every] = False, 0, 0
    hit = out > 0
    return pd.DataFrame({"id": ids[hit], "value": out[hit] * half})


def _from_one(a: np.ndarray, b: np.ndarray, start: np.ndarray, s: int, out: np.ndarray) -> None:
    """Adds the shares of shortest ways from one vertex; steps that meet much of a large window go through its arcs in order."""
    n, degree = len(out), np.diff(start)
    seen, fresh, ways, more = np.zeros(n, bool), np.zeros(n, bool), np.zeros(n), np.zeros(n)
    front = np.array([s])
    seen[s], ways[s] = True, 1.0
    layers = []
    while len(front):
        d = degree[front]
        total = int(d.sum())
        if 6 * total > len(a):
            fresh[front] = True
            sel = np.flatnonzero(fresh[a] & ~seen[b])
            fresh[front] = False
            u, w = a[sel], b[sel]
        else:
            u = np.repeat(front, d)
            w = b[np.arange(total) + np.repeat(start[front] - (np.cumsum(d) - d), d)]
            sel = ~seen[w]
            u, w = u[sel], w[sel]
        # All new ends lie one step further, however many arcs lead to them; a large step finds them in order.
        if wide := 6 * len(w) > n:
            fresh[w] = True
            front = np.flatnonzero(fresh)
            fresh[front] = False
            ways += np.bincount(w, ways[u], n)
        else:
            turn = np.arange(len(w))
            slot = np.empty(n, np.int64)
            slot[w] = turn
            front = w[slot[w] == turn]
            np.add.at(ways, w, ways[u])
        seen[front] = True
        layers.append((u, w, front, wide))
    pull = np.zeros(n)
    for u, w, far, wide in reversed(layers):
        pull[far] = 1 / ways[far] + more[far]
        if wide:
            more += np.bincount(u, pull[w], n)
        else:
            np.add.at(more, u, pull[w])
    more[s] = 0
    out += ways * more


def strong_sizes(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Sizes of strong components, by Tarjan's search without recursion."""
    ids, a, b = _dense(a, b)
    n = len(ids)
    order = np.argsort(a, kind="stable")
    near, start = b[order].tolist(), np.searchsorted(a[order], np.arange(n + 1)).tolist()
    number, low, on, stack, sizes, turn = [-1] * n, [0] * n, [False] * n, [], [], 0
    todo = start[:]
    for root in range(n):
        if number[root] >= 0:
            continue
        way = [root]
        while way:
            v = way[-1]
            if number[v] < 0:
                number[v] = low[v] = turn
                turn += 1
                stack.append(v)
                on[v] = True
            if todo[v] < start[v + 1]:
                w = near[todo[v]]
                todo[v] += 1
                if number[w] < 0:
                    way.append(w)
                elif on[w]:
                    low[v] = min(low[v], number[w])
                continue
            way.pop()
            if way:
                low[way[-1]] = min(low[way[-1]], low[v])
            if low[v] == number[v]:
                size = 0
                while True:
                    w = stack.pop()
                    on[w] = False
                    size += 1
                    if w == v:
                        break
                sizes.append(size)
    return np.array(sizes, np.int64)


def closeness(x: Arcs, turned: bool) -> DataFrame:
    r = x.reach(turned)
    return x.named(r.select(*x.at, "id", (F.col("reached") / F.col("total")).alias("value")))


def harary(x: Arcs, turned: bool) -> DataFrame:
    r = x.reach(turned).join(F.broadcast(x.population), x.at)
    return x.named(r.select(*x.at, "id", F.when(F.col("reached") == F.col("n") - 1, 1 / F.col("far")).otherwise(0.0).alias("value")))


def betweenness(x: Arcs, directed: bool) -> DataFrame:
    return x.named(x.between(directed))


def metrics(x: Arcs, asked: list[str], directed: bool) -> DataFrame:
    """``at, measure, value`` of the windows in which there are vertices."""
    rows, n = x.population, F.col("n")
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    nan = F.lit(float("nan"))
    over = lambda num, den, empty=nan: F.when(den > 0, num / F.when(den > 0, den)).otherwise(empty)
    value = {}
    if {"mean_distance", "diameter", "hierarchy", "centralization_closeness"}.intersection(asked):
        r = x.reach()
        r = keep(r, "reach") if "centralization_closeness" in asked else r
        close = F.col("reached") / F.col("total")
        rows = rows.join(r.groupBy(*x.at).agg(F.sum("reached").alias("pairs"), F.sum("total").alias("steps"), F.max("far").alias("far"), F.max(close).alias("cmax"), F.sum(close).alias("csum")), x.at, "left")
        value |= {"mean_distance": over(zero("steps"), zero("pairs")), "diameter": F.coalesce("far", nan)}
        value["centralization_closeness"] = F.when(n >= 3, (n * zero("cmax") - zero("csum")) / F.when(n >= 3, n - 1 if directed else n - 2)).otherwise(nan)
    if {"components_strong", "hierarchy"}.intersection(asked):
        rows = rows.join(x.strong(), x.at, "left")
        value["components_strong"] = n - zero("inside") + zero("strong")
        if "hierarchy" in asked:
            value["hierarchy"] = over(zero("pairs") - 2 * zero("mutual"), zero("pairs") - zero("mutual"))
    if "centralization_betweenness" in asked:
        b = x.between(directed).groupBy(*x.at).agg(F.max("value").alias("bmax"), F.sum("value").alias("bsum"))
        rows = rows.join(b, x.at, "left")
        most = (n - 1) ** 2 * (n - 2) / (1 if directed else 2)
        value["centralization_betweenness"] = F.when(n >= 3, (n * zero("bmax") - zero("bsum")) / F.when(n >= 3, most)).otherwise(nan)
    out = rows.select(*x.at, *(value[m].cast("double").alias(m) for m in asked))
    return out.unpivot(x.at, asked, "measure", "value")


def pagerank(x: Arcs, damping: float) -> DataFrame:
    """Ranks; vertices without arcs are alike, so one number stands for all of a window."""

    def fn(a, b, part, parts, n):
        ids, a, b = _dense(a, b)
        k = len(ids)
        alone = n - k
        out = np.bincount(a, minlength=k).astype(float)
        p, lone = np.full(k, 1 / n), 1 / n
        for _ in range(1000):
            spare = (p[out == 0].sum() + alone * lone) / n
            base = (1 - damping) / n + damping * spare
            q, other = base + damping * np.bincount(b, p[a] / out[a], k), base
            whole = q.sum() + alone * other
            q, other = q / whole, other / whole
            done = np.abs(q - p).sum() + alone * abs(other - lone) < 1e-12
            p, lone = q, other
            if done:
                break
        return pd.DataFrame({"id": np.append(ids, -1), "value": np.append(p, lone)})

    found = keep(x.dealt(fn, "id long, value double", 1), "ranks")
    others = x.population.join(found.filter("id < 0").select(*x.at, F.col("value").alias("lone")), x.at, "left").select(*x.at, F.coalesce("lone", 1 / F.col("n")).alias("lone"))
    every = x.names.crossJoin(F.broadcast(others)).join(found, [*x.at, "id"], "left")
    return every.select(*x.at, F.col("name").alias("node"), F.coalesce("value", "lone").alias("value"))


def power(x: Arcs, beta: float) -> DataFrame:
    """Bonacich's power; a vertex without arcs that leave has nought."""

    def fn(a, b, part, parts, n):
        ids, a, b = _dense(a, b)
        c = solved(a, b, len(ids), beta)
        size = (c * c).sum()
        return pd.DataFrame({"id": ids, "value": c * np.sqrt(n / size) if size > 0 else np.zeros(len(ids)) + size})

    return x.named(x.dealt(fn, "id long, value double", 1))


def solved(a: np.ndarray, b: np.ndarray, k: int, beta: float) -> np.ndarray:
    """``c`` with ``c = degree + beta * sum of c over the vertices that arcs lead to``, or nan where there is none.

    Larger systems by conjugate gradients of the squared error.
    """
    right = np.bincount(a, minlength=k).astype(float)
    if k <= WHOLE:
        m = np.eye(k)
        m[a, b] -= beta
        try:
            return np.linalg.solve(m, right)
        except np.linalg.LinAlgError:
            return np.full(k, np.nan)
    forth = lambda v: v - beta * np.bincount(a, v[b], k)
    back = lambda v: v - beta * np.bincount(b, v[a], k)
    c = right.copy()
    rest = right - forth(c)
    g = back(rest)
    way, now = g, g @ g
    least = 1e-13 * np.sqrt(right @ right)
    for _ in range(20 * k):
        if np.sqrt(rest @ rest) <= least:
            return c
        f = forth(way)
        step = now / (f @ f)
        c, rest = c + step * way, rest - step * f
        g = back(rest)
        was, now = now, g @ g
        way = g + now / was * way
    return np.full(k, np.nan)


def constraint(x: Arcs) -> DataFrame:
    """Burt's constraint: two-step shares matter between neighbours only, so they come from triangles, each listed once."""
    at = x.at
    ties = x.arcs.select(*at, F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).groupBy(*at, "a", "b").agg(F.count("*").cast("double").alias("s"))
    both = keep(ties.unionByName(ties.select(*at, F.col("b").alias("a"), F.col("a").alias("b"), "s")), "ties")
    whole = keep(both.groupBy(*at, "a").agg(F.sum("s").alias("t"), F.count("*").alias("deg")), "totals")
    end = lambda c: whole.select(*at, F.col("a").alias(c), F.col("t").alias(f"t{c}"), F.struct("deg", "a").alias(f"r{c}"))
    ranked = keep(both.join(end("a"), [*at, "a"]).join(end("b"), [*at, "b"]), "ranked")
    up = ranked.filter("ra < rb")
    one = up.select(*at, F.col("a").alias("v"), F.col("b").alias("x"), F.col("s").alias("vx"), F.col("ta").alias("tv"), F.col("tb").alias("tx"), F.col("rb").alias("rx"))
    two = up.select(*at, F.col("a").alias("v"), F.col("b").alias("y"), F.col("s").alias("vy"), F.col("tb").alias("ty"), F.col("rb").alias("ry"))
    third = up.select(*at, F.col("a").alias("x"), F.col("b").alias("y"), F.col("s").alias("xy"))
    tri = one.join(two, [*at, "v"]).filter("rx < ry").join(third, [*at, "x", "y"])
    through = lambda p, q, r, pq, qr: F.struct(F.col(p).alias("a"), F.col(r).alias("b"), (F.col(pq) / F.col(f"t{p}") * (F.col(qr) / F.col(f"t{q}"))).alias("p"))
    name = {frozenset("vx"): "vx", frozenset("vy"): "vy", frozenset("xy"): "xy"}
    six = [through(p, q, r, name[frozenset(p + q)], name[frozenset(q + r)]) for p, q, r in ("vxy", "vyx", "xvy", "xyv", "yvx", "yxv")]
    more = tri.select(*at, F.explode(F.array(*six)).alias("i")).groupBy(*at, "i.a", "i.b").agg(F.sum("i.p").alias("more"))
    square = (F.col("s") / F.col("ta") + F.coalesce("more", F.lit(0.0))) ** 2
    # Added up from the least, so that rounding does not hang on the order of rows; an array is as long as a vertex has neighbours.
    c = ranked.join(more, [*at, "a", "b"], "left").groupBy(*at, F.col("a").alias("id")).agg(F.array_sort(F.collect_list(square)).alias("_c"))
    return x.named(c.select(*at, "id", F.aggregate("_c", F.lit(0.0), lambda s, v: s + v).alias("value")))
