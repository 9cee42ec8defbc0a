"""Graph algorithms on one snapshot, as plain NumPy; no Spark in here.

``b`` is a 0/1 matrix without loops, rows pointing to columns.
"""

from __future__ import annotations

from collections import deque

import numpy as np

NAN = float("nan")


def distances(b: np.ndarray) -> np.ndarray:
    """Hop distances; infinity where there is no way."""
    n = len(b)
    out = np.full((n, n), np.inf)
    if not n:
        return out
    reach, front = np.eye(n, dtype=bool), np.eye(n, dtype=bool)
    adj, d = b.astype(np.float32), 0
    while front.any():
        out[front] = d
        front = (front.astype(np.float32) @ adj > 0) & ~reach
        reach |= front
        d += 1
    return out


def components(b: np.ndarray, strong: bool = False) -> np.ndarray:
    """Component number of every vertex, by first member."""
    n = len(b)
    near = np.isfinite(distances(b if strong else np.maximum(b, b.T)))
    both = near & near.T
    return np.array([int(np.flatnonzero(both[i])[0]) for i in range(n)], int)


def betweenness(b: np.ndarray, directed: bool) -> np.ndarray:
    """Shortest-path betweenness by accumulation, unscaled."""
    n = len(b)
    out = np.zeros(n)
    if n < 3:
        return out
    near = [np.flatnonzero(b[i]).tolist() for i in range(n)]
    for s in range(n):
        ways, dist, order, before = np.zeros(n), np.full(n, -1), [], [[] for _ in range(n)]
        ways[s], dist[s] = 1, 0
        queue = deque([s])
        while queue:
            v = queue.popleft()
            order.append(v)
            for w in near[v]:
                if dist[w] < 0:
                    dist[w] = dist[v] + 1
                    queue.append(w)
                if dist[w] == dist[v] + 1:
                    ways[w] += ways[v]
                    before[w].append(v)
        share = np.zeros(n)
        for w in reversed(order):
            for v in before[w]:
                share[v] += ways[v] / ways[w] * (1 + share[w])
            if w != s:
                out[w] += share[w]
    return out if directed else out / 2


def load(b: np.ndarray, directed: bool) -> np.ndarray:
    """Packets from everyone to everyone, split equally at each step; only what is relayed counts."""
    n = len(b)
    out = np.zeros(n)
    d = distances(b)
    for t in range(n):
        into = d[:, t]
        amount = np.where(np.isfinite(into), 1.0, 0.0)
        for v in sorted(range(n), key=lambda i: -into[i] if np.isfinite(into[i]) else np.inf):
            if v == t or not np.isfinite(into[v]):
                continue
            closer = np.flatnonzero((b[v] > 0) & (into == into[v] - 1))
            amount[closer] += amount[v] / len(closer)
        relayed = amount - 1
        relayed[t] = 0
        out += np.where(np.isfinite(into), relayed, 0)
    return out if directed else out / 2


def closeness(b: np.ndarray) -> np.ndarray:
    """Reached vertices over their total distance; 0 where none is reached."""
    d = distances(b)
    np.fill_diagonal(d, np.inf)
    fine = np.isfinite(d)
    total = np.where(fine, d, 0).sum(1)
    return np.divide(fine.sum(1), total, out=np.zeros(len(b)), where=total > 0)


def harary(b: np.ndarray) -> np.ndarray:
    d = distances(b)
    if len(b) < 2:
        return np.zeros(len(b))
    far = d.max(1)
    return np.where(np.isfinite(far) & (far > 0), 1 / np.maximum(far, 1), 0.0)


def perron(a: np.ndarray, tolerance: float = 1e-10) -> np.ndarray | None:
    """The leading vector of a matrix without negative entries, or None where it is not the only one."""
    if not len(a) or not a.any():
        return None
    values, vectors = np.linalg.eig(a.astype(float))
    size = np.abs(values)
    radius = size.max()
    scale = max(1.0, np.abs(a).sum(1).max())
    if radius <= tolerance * scale:
        return None
    lead = np.flatnonzero(np.abs(values - radius) <= 1e-7 * scale)
    if len(lead) != 1:
        return None
    v = vectors[:, lead[0]].real
    v = v * (1 if v.sum() >= 0 else -1)
    if v.min() < -1e-8 * np.abs(v).max():
        return None
    return np.maximum(v, 0)


def eigenvector(b: np.ndarray) -> np.ndarray:
    if not b.any():
        return np.zeros(len(b))
    v = perron(b.T.astype(float))
    return np.full(len(b), NAN) if v is None else v / v.max()


def hub(b: np.ndarray) -> np.ndarray:
    if not b.any():
        return np.zeros(len(b))
    v = perron((b @ b.T).astype(float))
    return np.full(len(b), NAN) if v is None else v / v.max()


def authority(b: np.ndarray) -> np.ndarray:
    return hub(b.T)


def pagerank(b: np.ndarray, damping: float = 0.85, tolerance: float = 1e-12, most: int = 1000) -> np.ndarray:
    n = len(b)
    if not n:
        return np.zeros(0)
    out = b.sum(1)
    p, step = np.full(n, 1 / n), np.divide(b, out[:, None], out=np.zeros((n, n)), where=out[:, None] > 0)
    for _ in range(most):
        q = (1 - damping) / n + damping * (p @ step + p[out == 0].sum() / n)
        q /= q.sum()
        if np.abs(q - p).sum() < tolerance:
            return q
        p = q
    return p


def coreness(b: np.ndarray, mode: str = "all") -> np.ndarray:
    a = b + b.T if mode == "all" else b.T if mode == "in" else b
    n = len(a)
    out, left, k = np.zeros(n, int), np.ones(n, bool), 0
    while left.any():
        degree = (a * left[None, :]).sum(1)
        degree[~left] = np.iinfo(int).max // 2
        v = int(degree.argmin())
        k = max(k, int(degree[v]))
        out[v], left[v] = k, False
    return out


def constraint(a: np.ndarray) -> np.ndarray:
    s = (a + a.T).astype(float)
    np.fill_diagonal(s, 0)
    total = s.sum(1)
    p = np.divide(s, total[:, None], out=np.zeros_like(s), where=total[:, None] > 0)
    value = (((p + p @ p) ** 2) * (s > 0)).sum(1)
    return np.where(total > 0, value, NAN)


def power(b: np.ndarray, beta: float = 0.1) -> np.ndarray:
    n = len(b)
    try:
        c = np.linalg.solve(np.eye(n) - beta * b, b.sum(1).astype(float))
    except np.linalg.LinAlgError:
        return np.full(n, NAN)
    size = (c * c).sum()
    return c * np.sqrt(n / size) if size > 0 else np.zeros(n)


def information(b: np.ndarray) -> np.ndarray:
    s = np.maximum(b, b.T).astype(float)
    out, live = np.zeros(len(b)), np.flatnonzero(s.sum(1) > 0)
    if not len(live):
        return out
    s = s[np.ix_(live, live)]
    n = len(live)
    m = 1 - s
    np.fill_diagonal(m, 1 + s.sum(1))
    try:
        c = np.linalg.inv(m)
    except np.linalg.LinAlgError:
        return np.where(np.isin(np.arange(len(b)), live), NAN, 0.0)
    trace, row = np.trace(c), c.sum(1)
    out[live] = 1 / (np.diag(c) + (trace - 2 * row) / n)
    return out


def max_flow(cap: np.ndarray, s: int, t: int) -> float:
    """Flow by shortest augmenting ways."""
    rest, total, n = cap.astype(float).copy(), 0.0, len(cap)
    while True:
        before = np.full(n, -1)
        before[s] = s
        queue = deque([s])
        while queue and before[t] < 0:
            v = queue.popleft()
            for w in np.flatnonzero((rest[v] > 1e-12) & (before < 0)).tolist():
                before[w] = v
                queue.append(w)
        if before[t] < 0:
            return total
        w, least = t, np.inf
        while w != s:
            least, w = min(least, rest[before[w], w]), before[w]
        w = t
        while w != s:
            rest[before[w], w] -= least
            rest[w, before[w]] += least
            w = before[w]
        total += least


def flow_betweenness(b: np.ndarray, directed: bool) -> np.ndarray:
    n = len(b)
    out = np.zeros(n)
    for s in range(n):
        for t in range(n):
            if s == t or (not directed and s > t):
                continue
            whole = max_flow(b, s, t)
            if whole:
                for v in range(n):
                    if v not in (s, t):
                        cut = b.copy()
                        cut[v], cut[:, v] = 0, 0
                        out[v] += whole - max_flow(cut, s, t)
    return out


def balance(b: np.ndarray, sweeps: int = 10_000, tolerance: float = 1e-12) -> np.ndarray | None:
    """Rows and columns scaled to one, or None where no scaling exists."""
    n = len(b)
    if not n or not total_support(b):
        return None
    a = b.astype(float)
    for _ in range(sweeps):
        a = a / a.sum(1, keepdims=True)
        a = a / a.sum(0, keepdims=True)
        if np.abs(a.sum(1) - 1).max() < tolerance:
            return a
    return None


def matching(b: np.ndarray) -> list[int]:
    """A largest matching: the row of each column, or -1."""
    n = len(b)
    row_of = [-1] * n

    def seek(i: int, seen: set[int]) -> bool:
        for j in np.flatnonzero(b[i]).tolist():
            if j not in seen:
                seen.add(j)
                if row_of[j] < 0 or seek(row_of[j], seen):
                    row_of[j] = i
                    return True
        return False

    for i in range(n):
        seek(i, set())
    return row_of


def total_support(b: np.ndarray) -> bool:
    """Whether every entry lies in some perfect matching."""
    row_of = matching(b)
    if min(row_of, default=-1) < 0:
        return False
    n = len(b)
    col_of = np.argsort(row_of)
    step = np.zeros((n, n))
    for i in range(n):
        for j in np.flatnonzero(b[i]).tolist():
            if col_of[i] != j:
                step[i, row_of[j]] = 1
    near = np.isfinite(distances(step))
    return all(col_of[i] == j or near[row_of[j], i] for i in range(n) for j in np.flatnonzero(b[i]).tolist())


def prestige(b: np.ndarray, kind: str) -> np.ndarray:
    n = len(b)
    rows = b.sum(1, keepdims=True)
    by_row = np.divide(b, rows, out=np.zeros((n, n)), where=rows > 0)
    if kind == "indegree":
        return b.sum(0).astype(float)
    if kind == "indegree.rownorm":
        return by_row.sum(0)
    if kind == "indegree.rowcolnorm":
        a = balance(b)
        return np.full(n, NAN) if a is None else a.sum(0)
    near = distances(b)
    np.fill_diagonal(near, np.inf)
    reach = np.isfinite(near).sum(0)
    if kind == "domain":
        return reach.astype(float)
    if kind == "domain.proximity":
        total = np.where(np.isfinite(near), near, 0).sum(0)
        return np.divide(reach**2, (n - 1) * total, out=np.zeros(n), where=total > 0) if n > 1 else np.zeros(n)
    if kind.startswith("eigenvector"):
        cols = b.sum(0, keepdims=True)
        a = {"eigenvector": b, "eigenvector.rownorm": by_row, "eigenvector.colnorm": np.divide(b, cols, out=np.zeros((n, n)), where=cols > 0)}.get(kind)
        if kind == "eigenvector.rowcolnorm":
            a = balance(b)
        v = None if a is None else perron(np.asarray(a, float).T)
        return np.full(n, NAN) if v is None else v / np.sqrt((v * v).sum())
    raise ValueError(kind)


#: Classes of triads, and the class of each code of six arcs.
TRIADS = ("003", "012", "102", "021D", "021U", "021C", "111D", "111U", "030T", "030C", "201", "120D", "120U", "120C", "210", "300")
TRIAD_OF = (1, 2, 2, 3, 2, 4, 6, 8, 2, 6, 5, 7, 3, 8, 7, 11, 2, 6, 4, 8, 5, 9, 9, 13, 6, 10, 9, 14, 7, 14, 12, 15, 2, 5, 6, 7, 6, 9, 10, 14, 4, 9, 9, 12, 8, 13, 14, 15, 3, 7, 8, 11, 7, 12, 14, 15, 8, 14, 13, 15, 11, 15, 15, 16)


def triads(b: np.ndarray) -> np.ndarray:
    """Counts of the sixteen classes, one vertex at a time over pairs of the others."""
    n, out = len(b), np.zeros(16, np.int64)
    b, kinds = b.astype(np.int64), np.array(TRIAD_OF) - 1
    for i in range(n - 2):
        j, k = np.triu_indices(n - i - 1, 1)
        j, k = j + i + 1, k + i + 1
        code = b[i, j] + 2 * b[j, i] + 4 * b[i, k] + 8 * b[k, i] + 16 * b[j, k] + 32 * b[k, j]
        out += np.bincount(kinds[code], minlength=16)
    return out


def graph_measures(b: np.ndarray, directed: bool) -> dict[str, float]:
    """Measures of one snapshot that need whole ways or components."""
    n = len(b)
    if not n:
        empty = {"components": 0.0, "components_strong": 0.0, "largest_component": 0.0, "connectedness": 1.0, "efficiency": 1.0, "hierarchy": NAN, "lubness": NAN}
        return empty | dict.fromkeys(("mean_distance", "diameter", "centralization_betweenness", "centralization_closeness"), NAN)
    d = distances(b)
    off = d.copy()
    np.fill_diagonal(off, np.inf)
    fine = off[np.isfinite(off)]
    weak = components(b)
    sizes = np.unique(weak, return_counts=True)[1]
    pairs = n * (n - 1)
    out = {
        "components": float(len(sizes)),
        "components_strong": float(len(np.unique(components(b, True)))),
        "largest_component": sizes.max() / n,
        "mean_distance": fine.mean() if len(fine) else NAN,
        "diameter": fine.max() if len(fine) else NAN,
        "connectedness": (sizes * (sizes - 1)).sum() / pairs if n > 1 else 1.0,
    }
    spare = ((sizes - 1) ** 2).sum()
    out["efficiency"] = 1 - (b.sum() - (sizes - 1).sum()) / spare if spare else NAN
    near = np.isfinite(d)
    np.fill_diagonal(near, False)
    some, mutual = (near | near.T).sum() / 2, (near & near.T).sum() / 2
    out["hierarchy"] = 1 - mutual / some if some else NAN
    out["lubness"] = lubness(d, weak)
    bw, cl = betweenness(b, directed), closeness(b)
    if n >= 3:
        most = (n - 1) ** 2 * (n - 2) / (1 if directed else 2)
        out["centralization_betweenness"] = (bw.max() - bw).sum() / most
        out["centralization_closeness"] = (cl.max() - cl).sum() / ((n - 1) if directed else (n - 2))
    else:
        out["centralization_betweenness"] = out["centralization_closeness"] = NAN
    return out


def lubness(d: np.ndarray, weak: np.ndarray) -> float:
    """Share of pairs in a component with a least upper bound."""
    near = np.isfinite(d)
    bad = most = 0
    for c in np.unique(weak):
        who = np.flatnonzero(weak == c)
        k = len(who)
        if k <= 2:
            continue
        most += (k - 1) * (k - 2) / 2
        r = near[np.ix_(who, who)]
        for i in range(k):
            for j in range(i + 1, k):
                above = np.flatnonzero(r[:, i] & r[:, j])
                if not len(above) or not any(r[np.ix_(above, [x])].all() for x in above):
                    bad += 1
    return 1 - bad / most if most else NAN
