"""Values that rows of a slice take of others, and swaps that mend them: what a task does with Arrow tables."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

from kairograph.functions.packing import array, packed, unpacked
from kairograph.functions.timeops import EPS

#: Proposals that are weighed side by side.
PROPOSALS = 1 << 20
#: Of a slice: rows outside, loops, and offending rows met while mending.
TALLY = ("_out", "_loops", "_met")


@dataclass(frozen=True)
class Rules:
    """What moves, and what a row may not be."""

    moved: tuple[str, ...]
    no_loops: bool
    watched: tuple[tuple[float, float], ...] | None
    present: bool
    most: int
    seed: int


def _sorted(t: pa.Table, *by: str) -> pa.Table:
    return t.sort_by([(c, "ascending") for c in by])


def _segments(codes: np.ndarray) -> np.ndarray:
    """Where runs of equal numbers begin, and the end."""
    return np.concatenate([[0], np.flatnonzero(np.diff(codes)) + 1, [len(codes)]]) if len(codes) else np.array([0])


def _codes(a: pa.Array) -> np.ndarray:
    return a.dictionary_encode().indices.to_numpy(zero_copy_only=False)


def _runs(t: pa.Table, carried: list[str], starts: dict[str, np.ndarray]) -> pa.Table:
    """A slice of values in order of digits, cut where the slices of rows begin; ``starts`` has these for scopes of several."""
    codes, d = _codes(array(t, "_scope")), array(t, "_d").cast(pa.binary(10))
    d = np.frombuffer(d.buffers()[1], np.uint8)[10 * d.offset : 10 * (d.offset + len(d))].reshape(-1, 10)
    high, low = (np.ascontiguousarray(x).view(kind).ravel() for x, kind in ((d[:, :8], ">u8"), (d[:, 8:], ">u2")))
    order = np.lexsort((low, high.astype(np.uint64), codes))
    t = t.take(pa.array(order))
    scope, ends = array(t, "_scope"), _segments(codes[order])
    cuts, slices, scopes, first = [], [], [], []
    for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True):
        name = scope[a].as_py()
        before = t["_before"][a].as_py() or 0
        if name in starts:
            at = np.searchsorted(starts[name], np.arange(before, before + b - a), "right") - 1
            parts = _segments(at)[:-1]
            slices += at[parts].tolist()
        else:
            parts = np.zeros(1, int)
            slices.append(0)
        cuts += (a + parts).tolist()
        scopes += [name] * len(parts)
        first += (before + parts).tolist()
    keys = {"replicate": pa.array([t["replicate"][0].as_py()] * len(slices), pa.int32()), "_bundle": pa.array([t["_bundle"][0].as_py()] * len(slices), pa.int32())}
    keys |= {"_slice": pa.array(slices, pa.int32()), "_scope": pa.array(scopes, pa.string()), "_first": pa.array(first, pa.int64())}
    cuts.append(t.num_rows)
    return pa.table(keys | {"_values": pa.array([packed(t.slice(a, b - a), carried) for a, b in zip(cuts[:-1], cuts[1:], strict=True)], pa.binary())})


def _replicates(draws: pa.Table, carried: list[str]) -> Iterator[tuple[int, dict[str, pa.Array]]]:
    """Each replicate's values in order of rows."""
    draws = _sorted(draws, "replicate", "_scope", "_first")
    of = draws["replicate"].to_numpy()
    ends = _segments(of)
    for a, b in zip(ends[:-1], ends[1:], strict=True):
        yield int(of[a]), unpacked(draws["_values"].slice(a, b - a).to_pylist(), carried)


def _dealt(rows: pa.Table, draws: pa.Table, carried: list[str], columns: list[str]) -> pa.Table:
    """Rows of each replicate with their values."""
    rows = _sorted(rows, "_scope", "_id")
    rows = rows.append_column("_row", pa.array(np.arange(rows.num_rows)))
    out = []
    for r, values in _replicates(draws, carried):
        own = {"replicate": pa.array(np.full(rows.num_rows, r, np.int32)), **values}
        out.append(pa.table({c: own.get(c, rows[c] if c in rows.column_names else None) for c in columns}))
    return pa.concat_tables(out)


def _leq(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    size = np.maximum(1.0, np.maximum(*(np.where(np.isfinite(x), np.abs(x), 0.0) for x in (a, b))))
    with np.errstate(invalid="ignore"):
        return (a <= b) | (np.abs(a - b) <= EPS * size)


def _judge(rows: dict[str, pa.Array], values: dict[str, pa.Array], rules: Rules) -> Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]:
    """Whether the i-th rows with the j-th values lie outside what is respected, and whether they are loops that may not be."""
    of = lambda c: values[c] if c in rules.moved else rows[c]
    n = len(rows["from"])
    codes = _codes(pa.concat_arrays([rows["from"], of("to")]))
    f, t = codes[:n], codes[n:]
    s, e = (of(c).to_numpy(zero_copy_only=False) for c in ("start", "end"))
    seen = np.ones(len(s), bool)
    if rules.watched is not None:
        inside = lambda x: np.any([(a <= x) & (x <= b) for a, b in rules.watched], axis=0)
        seen = inside(s) & inside(e)
    if rules.present:
        there = pa.concat_arrays([rows["_there_from"], (values if "to" in rules.moved else rows)["_there_to"]])
        there = there.take(pa.array(np.unique(codes, return_index=True)[1]))  # a list for each vertex
        free, size = there.is_null().to_numpy(zero_copy_only=False), there.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
        flat = there.flatten()
        a, b = (flat.field(i).to_numpy(zero_copy_only=False) for i in (0, 1))
        first = np.concatenate([[0], np.cumsum(size)])

    def present(v: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
        if not len(a):
            return free[v]
        begin, hi = first[v], first[v + 1]
        lo = begin.copy()
        while (more := lo < hi).any():  # to the last stretch that has begun by the start
            mid = (lo + hi) // 2
            fine = more & _leq(a[np.minimum(mid, len(a) - 1)], s)
            lo, hi = np.where(fine, mid + 1, lo), np.where(more & ~fine, mid, hi)
        hit = free[v]
        for j in (lo - 1, lo - 2):
            k = np.maximum(j, 0)
            hit = hit | (j >= begin) & _leq(a[k], s) & _leq(e, b[k])
        return hit

    def judge(i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        when, whom = (j, i) if "start" in rules.moved else (i, j)
        out = ~seen[when]
        if rules.present:
            out |= ~present(f[i], s[when], e[when]) | ~present(t[whom], s[when], e[when])
        return out, (f[i] == t[whom]) & rules.no_loops

    return judge


def mended(judge: Callable, ends: np.ndarray, rng: np.random.Generator, most: int, allowed: int) -> tuple[np.ndarray, dict[str, int]]:
    """Whose value each row has after swaps within scopes that begin at ``ends``, and the tally.

    In a round each offending row proposes swaps with rows of its scope at random: four in
    the first and twice as many in each further one, up to 256.  Those after which more of
    the two would offend fall away; of those that share a row, what mends most stands.
    """
    n = int(ends[-1])
    at = np.arange(n)
    first, count = (np.repeat(x, np.diff(ends)) for x in (ends[:-1], np.diff(ends)))
    out, loop = judge(at, at)
    met = 0
    for turn in range(most):
        x = np.flatnonzero(out | loop)
        if not loop.any() and out.sum() <= allowed:
            break
        met += len(x)
        x = np.repeat(x, max(1, min(256, 4 << min(turn, 6), PROPOSALS // len(x))))
        y = first[x] + (rng.random(len(x)) * count[x]).astype(np.int64)
        x, y = x[x != y], y[x != y]
        (ox, lx), (oy, ly) = judge(x, at[y]), judge(y, at[x])
        more = (ox | lx) * 1 + (oy | ly) - (out | loop)[x] - (out | loop)[y]
        order = np.argsort(more, kind="stable")
        order = order[more[order] <= 0]
        x, y, ox, lx, oy, ly = (v[order] for v in (x, y, ox, lx, oy, ly))
        row, where = np.unique(np.stack([x, y], 1).ravel(), return_index=True)
        own = np.zeros(n, np.int64)
        own[row] = where // 2
        turns = np.arange(len(x))
        fine = (own[x] == turns) & (own[y] == turns)
        x, y = x[fine], y[fine]
        at[x], at[y] = at[y], at[x]
        out[x], loop[x], out[y], loop[y] = ox[fine], lx[fine], oy[fine], ly[fine]
    return at, dict(zip(TALLY, (int(out.sum()), int(loop.sum()), met), strict=True))


def _mended(rows: pa.Table, draws: pa.Table, rules: Rules, carried: list[str]) -> pa.Table:
    """A slice's values after its swaps, one row for each replicate."""
    rows = _sorted(rows, "_scope", "_id")
    ends = _segments(_codes(array(rows, "_scope")))
    own = {c: array(rows, c) for c in rows.column_names if c not in ("_id", "_scope")}
    judge = _judge(own, own, rules)
    every = np.arange(rows.num_rows)
    allowed = int(judge(every, every)[0].sum())  # as many as the network has there
    key = [int(rows[c][0].as_py()) for c in ("_bundle", "_slice")]
    out = []
    for r, values in _replicates(draws, carried):
        at, tally = mended(_judge(own, values, rules), ends, np.random.default_rng([rules.seed, r, *key]), rules.most, allowed)
        values = pa.table({c: v.take(pa.array(at)) for c, v in values.items()})
        out.append(_list(r, key, values, carried, tally))
    return pa.concat_tables(out)


def _list(r: int, key: list[int], values: pa.Table, carried: list[str], tally: dict[str, int]) -> pa.Table:
    keys = {"replicate": pa.array([r], pa.int32()), "_bundle": pa.array([key[0]], pa.int32()), "_slice": pa.array([key[1]], pa.int32()), "_scope": pa.array([""], pa.string()), "_first": pa.array([0], pa.int64())}
    return pa.table(keys | {"_values": pa.array([packed(values, carried)], pa.binary())} | {c: pa.array([v], pa.int64()) for c, v in tally.items()})


def _mixed(rows: pa.Table, rules: Rules, carried: list[str], turn: int) -> pa.Table:
    """Rows of several slices after swaps among them; the tally is with the first one."""
    rows = _sorted(rows, "_scope", "_slice", "_row")
    own = {c: array(rows, c) for c in rows.column_names}
    key = [int(rows[c][0].as_py()) for c in ("replicate", "_bundle", "_mix")]
    at, tally = mended(_judge(own, own, rules), _segments(_codes(own["_scope"])), np.random.default_rng([rules.seed, *key, turn]), rules.most, 0)
    moved = {c: own[c].take(pa.array(at)) for c in carried}
    count = {c: pa.array([v] + [0] * (rows.num_rows - 1), pa.int64()) for c, v in tally.items()}
    return pa.table({c: own[c] for c in ("replicate", "_bundle", "_slice", "_row")} | moved | count)


def _packed(rows: pa.Table, carried: list[str]) -> pa.Table:
    """Values of a slice's rows in order."""
    rows = _sorted(rows, "_row")
    tally = {c: int(rows[c].to_numpy().sum()) for c in TALLY}
    r, *key = (int(rows[c][0].as_py()) for c in ("replicate", "_bundle", "_slice"))
    return _list(r, key, rows.select(carried), carried, tally)
