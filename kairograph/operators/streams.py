"""Katz and walk scores of contact streams, by blocks of contacts in order of time.

All contacts of an instant read what was there before it.  What waits at a vertex is
what has arrived, faded by ``decay``; it goes from one block of a session to the next,
so walks of any number of hops are summed in one pass and no session is one group.
Pairs of walks meet in stretches of time, and the totals of stretches before are carried
over, so a vertex with very many contacts is many groups.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kairograph.errors import BudgetExceeded
from kairograph.functions.timeops import EPS, c_leq
from kairograph.plans.network import Network
from kairograph.plans.storage import keep

AT = ["session", "node"]
#: Fading within one stretch stays within double precision; after two more nothing is left.
FADE = 300.0
#: Contacts of a session that one task takes in order of time.
BLOCK = 500_000


def contact_stream(net: Network, sessions: str = "bounded", start: float | None = None, end: float | None = None) -> DataFrame:
    """``session, from, to, t, n``: starts in observed time and between the bounds that are not censored.

    Times equal up to rounding are one instant, named by the first.
    """
    from kairograph.operators.dynamics import _observed
    from kairograph.operators.sequences import lagged

    t = F.col("start")
    s = net.spells.filter(~F.col("onset_censored") & _observed(net, t))
    if start is not None:
        s = s.filter(c_leq(F.lit(float(start)), t))
    if end is not None:
        s = s.filter(c_leq(t, F.lit(float(end))))
    s = s.select(F.coalesce(net.walls(sessions), F.lit("")).alias("session"), "from", "to", t.alias("t"))
    if not net.directed:
        s = s.unionByName(s.select("session", F.col("to").alias("from"), F.col("from").alias("to"), "t"))
    s = keep(s.groupBy("session", "from", "to", "t").agg(F.count("*").cast("double").alias("n")), "stream")
    lo, hi = net.span()
    while True:
        times = lagged(s.select("session", "t").distinct(), ["session"], ["t"], ["t"], (hi - lo) / 256 or 1.0)
        near = F.col("t") - F.col("_t") <= EPS * F.greatest(F.lit(1.0), F.abs("t"), F.abs("_t"))
        moved = keep(times.filter(F.col("_has") & near).select("session", "t", "_t"), "instants")
        if moved.isEmpty():
            return s
        s = s.join(moved, ["session", "t"], "left").withColumn("t", F.coalesce("_t", "t"))
        s = keep(s.groupBy("session", "from", "to", "t").agg(F.sum("n").alias("n")), "stream")


def waiting(arrived: DataFrame, points: DataFrame, decay: float, length: float) -> DataFrame:
    """``session, node, t, s`` at ``points``: what ``arrived (session, node, t, a)`` strictly before, faded."""
    length = FADE / decay if decay else length
    line = arrived.select(*AT, "t", "a", F.lit(1).alias("late")).unionByName(points.select(*AT, "t", F.lit(0.0).alias("a"), F.lit(0).alias("late")))
    line = line.withColumn("cut", F.floor(F.col("t") / length))
    since = lambda c: F.exp(decay * (F.col("t") - F.col(c) * length))
    own = Window.partitionBy(*AT, "cut").orderBy("t", "late").rowsBetween(Window.unboundedPreceding, 0)
    rows = line.withColumn("sum", F.sum(F.col("a") * since("cut")).over(own)).filter("late = 0")
    total = arrived.withColumn("cut", F.floor(F.col("t") / length)).groupBy(*AT, "cut").agg(F.sum(F.col("a") * since("cut")).alias("sum"))
    if decay:  # a stretch fades by e^-300: two of them are all that doubles can show
        carried = total.select(*AT, (F.col("cut") + 1).alias("cut"), (F.col("sum") * math.exp(-FADE)).alias("c")).unionByName(total.select(*AT, (F.col("cut") + 2).alias("cut"), (F.col("sum") * math.exp(-2 * FADE)).alias("c")))
        carried = carried.groupBy(*AT, "cut").agg(F.sum("c").alias("c"))
    else:
        cuts = total.select(*AT, "cut", "sum").unionByName(rows.select(*AT, "cut").distinct().withColumn("sum", F.lit(0.0)))
        cuts = cuts.groupBy(*AT, "cut").agg(F.sum("sum").alias("sum"))
        carried = cuts.select(*AT, "cut", F.sum("sum").over(Window.partitionBy(*AT).orderBy("cut").rowsBetween(Window.unboundedPreceding, -1)).alias("c"))
    out = rows.join(carried, [*AT, "cut"], "left")
    return out.select(*AT, "t", ((F.col("sum") + F.coalesce("c", F.lit(0.0))) / since("cut")).alias("s"))


def _dealt(stream: DataFrame, length: float) -> DataFrame:
    """``stream`` with ``block``: a session's contacts in order of time, ``BLOCK`` to a block; an instant is in one block."""
    count = stream.withColumn("cut", F.floor(F.col("t") / length)).groupBy("session", "cut", "t").agg(F.count("*").alias("c"))
    count = keep(count, "instants")
    ahead = Window.partitionBy("session").orderBy("cut").rowsBetween(Window.unboundedPreceding, -1)
    cuts = count.groupBy("session", "cut").agg(F.sum("c").alias("c")).select("session", "cut", F.coalesce(F.sum("c").over(ahead), F.lit(0)).alias("ahead"))
    here = Window.partitionBy("session", "cut").orderBy("t").rowsBetween(Window.unboundedPreceding, -1)
    place = count.select("session", "cut", "t", F.coalesce(F.sum("c").over(here), F.lit(0)).alias("here")).join(cuts, ["session", "cut"])
    place = place.select("session", "t", F.floor((F.col("ahead") + F.col("here")) / BLOCK).cast("int").alias("block"))
    return keep(stream.join(place, ["session", "t"]), "blocks", "block")


def passed(pdf: pd.DataFrame, beta: float, decay: float, first: float) -> pd.DataFrame:
    """``node, t, a, kind``: what arrives at each instant of a block (kind 1), and what then waits at its vertices (kind 0).

    ``pdf`` has contacts ``from, to, t, n`` and, without ``to``, what waited before.
    """
    old, new = pdf[pdf["to"].isna()], pdf[pdf["to"].notna()].sort_values("t", kind="stable")
    codes, names = pd.factorize(pd.concat([old["from"], new["from"], new["to"]], ignore_index=True))
    x, last = [0.0] * len(names), [0.0] * len(names)
    for v, t, y in zip(codes[: len(old)].tolist(), old["t"].tolist(), old["n"].tolist(), strict=True):
        x[v], last[v] = y, t
    ends, times, n = codes[len(old) :].tolist(), new["t"].tolist(), new["n"].tolist()
    m, i, got = len(new), 0, []
    there = lambda v, t: x[v] * math.exp(decay * (last[v] - t)) if decay and x[v] else x[v]
    while i < m:
        t, into = times[i], {}
        while i < m and times[i] == t:
            v = ends[m + i]
            into[v] = into.get(v, 0.0) + n[i] * (first + beta * there(ends[i], t))
            i += 1
        for v, a in into.items():
            x[v], last[v] = there(v, t) + a, t
            got.append((v, t, a))
    v, t, a = (np.array(c) for c in zip(*got, strict=True)) if got else (np.zeros(0, int), np.zeros(0), np.zeros(0))
    return pd.DataFrame({"node": np.append(names[v], names), "t": np.append(t, last), "a": np.append(a, x), "kind": np.append(np.ones(len(v), int), np.zeros(len(names), int))})


def _walks(stream: DataFrame, beta: float, decay: float, first: float, length: float) -> DataFrame:
    """``session, node, t, a``: weights of walks that arrive at each instant.

    A contact by itself weighs ``first``; one more contact multiplies by ``beta``.  Blocks
    follow each other, and what waits at vertices goes from one to the next.
    """
    stream = _dealt(stream, length)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        return passed(pdf, beta, decay, first).assign(session=pdf["session"].iloc[0])

    layers, waits = [], None
    for b in range((stream.agg(F.max("block")).first()[0] or 0) + 1):
        rows = stream.filter(F.col("block") == b).select("session", "from", "to", "t", "n")
        if waits is not None:
            touched = rows.select("session", F.explode(F.array("from", "to")).alias("node")).distinct()
            was = waits.join(touched, AT, "left_semi").select("session", F.col("node").alias("from"), F.lit(None).cast("string").alias("to"), "t", F.col("a").alias("n"))
            rows = rows.unionByName(was)
        got = keep(rows.groupBy("session").applyInPandas(run, "session string, node string, t double, a double, kind int"), "walks")
        most = got.agg(F.max("a")).first()[0]
        if most is not None and not math.isfinite(most):
            raise BudgetExceeded("scores are greater than doubles hold; take a smaller beta")
        layers.append(got.filter("kind = 1").drop("kind"))
        now = got.filter("kind = 0 and a > 0").select(*AT, "t", "a", F.lit(b).alias("b"))
        if waits is not None:
            now = waits.unionByName(now).groupBy(*AT).agg(F.max_by(F.struct("t", "a", "b"), "b").alias("w")).select(*AT, "w.*")
        waits = keep(now, "waits")
    out = layers[0]
    for x in layers[1:]:
        out = out.unionByName(x)
    return out


def _scores(net: Network, stream: DataFrame, got: DataFrame) -> DataFrame:
    """``session, node, value`` for every vertex that a session's stream touches."""
    base = stream.select("session", F.explode(F.array("from", "to")).alias("node")).distinct()
    return base.join(got, AT, "left").select(*AT, F.coalesce("value", F.lit(0.0)).alias("value"))


def katz(net: Network, beta: float = 0.1, decay: float = 0.0, sessions: str = "bounded", start: float | None = None, end: float | None = None) -> DataFrame:
    """``session, node, value``: walks that end at a vertex, ``beta`` for each contact, faded from their first contact to the end of the window."""
    stream = contact_stream(net, sessions, start, end)
    lo, hi = net.span()
    upper = hi if end is None else float(end)
    arrived = _walks(stream, beta, decay, beta, (hi - lo) / 64 or 1.0)
    got = arrived.groupBy(*AT).agg(F.sum(F.col("a") * F.exp(-decay * (F.lit(upper) - F.col("t")))).alias("value"))
    return _scores(net, stream, got)


def walks(net: Network, beta: float = 0.1, decay: float = 0.0, sessions: str = "bounded", start: float | None = None, end: float | None = None) -> DataFrame:
    """``session, node, value``: pairs of a walk that ends at a vertex and one that begins there later, faded by the time between."""
    stream = contact_stream(net, sessions, start, end)
    lo, hi = net.span()
    length = (hi - lo) / 64 or 1.0
    into = _walks(stream, beta, 0.0, 1.0, length)
    back = stream.select("session", F.col("to").alias("from"), F.col("from").alias("to"), (-F.col("t")).alias("t"), "n")
    out = _walks(back, beta, 0.0, 1.0, length).withColumn("t", -F.col("t"))
    s = waiting(into, out, decay, length)
    got = s.join(out, [*AT, "t"]).groupBy(*AT).agg(F.sum(F.col("s") * F.col("a")).alias("value"))
    return _scores(net, stream, got)
