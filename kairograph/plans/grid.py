"""Measurement grids and what is active in each window."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kairograph.errors import BadInput
from kairograph.functions.timeops import EPS, c_eq, c_leq, c_lt, eq, leq
from kairograph.plans.network import Network


@dataclass(frozen=True)
class Bin:
    bin: int
    lo: float
    hi: float
    closed: bool


@dataclass(frozen=True)
class Grid:
    """Windows in order; ``window`` 0 samples instants."""

    bins: tuple[Bin, ...]
    step: float
    window: float

    def frame(self, spark: SparkSession) -> DataFrame:
        """``bin, time, lo, hi, closed``, one row for each window."""
        return spark.createDataFrame([(b.bin, b.lo, b.lo, b.hi, b.closed) for b in self.bins], "bin int, time double, lo double, hi double, closed boolean")

    def explode(self, df: DataFrame) -> DataFrame:
        """Rows with each window they may touch: arithmetic on a regular grid, no join.

        Candidates reach one window further on either side; callers filter exactly.
        """
        lo, n = self.bins[0].lo, len(self.bins)
        regular = n > 1 and all(b.lo == lo + i * self.step for i, b in enumerate(self.bins))
        if not regular:
            windows = F.array(*[F.struct(F.lit(b.bin).alias("bin"), F.lit(b.lo).alias("lo"), F.lit(b.hi).alias("hi"), F.lit(b.closed).alias("closed")) for b in self.bins])
            return df.withColumn("_w", F.explode(windows)).select(*df.columns, F.col("_w.bin").alias("bin"), F.col("_w.lo").alias("time"), F.col("_w.lo").alias("lo"), F.col("_w.hi").alias("hi"), F.col("_w.closed").alias("closed"))
        first = F.greatest(F.lit(0), F.floor((F.col("start") - lo - self.window) / self.step).cast("int") - 1)
        last = F.least(F.lit(n - 1), F.ceil((F.col("end") - lo) / self.step).cast("int") + 1)
        df = df.withColumn("_k", F.explode(F.when(first <= last, F.sequence(first, last))))
        at = F.lit(lo) + F.col("_k") * F.lit(self.step)
        closed = (F.col("_k") == n - 1) & F.lit(self.bins[-1].closed)
        return df.withColumns({"bin": F.col("_k") + self.bins[0].bin, "time": at, "lo": at, "hi": at + self.window, "closed": closed}).drop("_k")


def n_bins(span: float, step: float) -> int:
    ratio = span / step
    near = round(ratio)
    if abs(ratio - near) <= EPS * max(1.0, abs(span)) / step:
        return max(1, near)
    return max(1, math.ceil(ratio))


def make_grid(net: Network, start: float | None = None, end: float | None = None, step: float | None = None, window: float | str | None = None) -> Grid:
    """Windows over observed time.

    By default the last one is closed on the right; an explicit ``end`` closes none.
    ``window="all"`` is one closed window; 0 samples instants through the end.
    """
    pieces = net.observed or (net.span(),)
    first, last = pieces[0][0], pieces[-1][1]
    step = net.interval if step is None else float(step)
    if step <= 0:
        raise BadInput("step must be positive")
    if window == "all":
        lo, hi = first if start is None else start, last if end is None else end
        return Grid((Bin(1, lo, hi, True),), step, hi - lo)
    window = step if window is None else float(window)
    if window < 0:
        raise BadInput("window must not be negative")
    bins: list[Bin] = []
    for a, b in pieces:
        lo = a if start is None else float(start)
        if len(pieces) > 1 and start is not None:
            lo = start + math.ceil((a - start) / step - EPS) * step
        if end is not None or window == 0:
            stop = b if end is None else float(end)
            count = math.floor((stop - lo) / step * (1 + EPS)) + 1 if stop >= lo else 0
            bins += [Bin(0, lo + k * step, lo + k * step + window, False) for k in range(count)]
        else:
            count = n_bins(b - lo, step) if leq(lo, b) else 0
            bins += [Bin(0, lo + k * step, lo + k * step + window, k == count - 1) for k in range(count)]
        if len(pieces) > 1:
            bins = [x if x.hi <= b or eq(x.hi, b) or x.lo < a else Bin(x.bin, x.lo, b, x.closed) for x in bins]
    if not bins:
        raise BadInput("the grid has no windows")
    return Grid(tuple(Bin(i + 1, x.lo, x.hi, x.closed) for i, x in enumerate(bins)), step, window)


def is_active(window: float) -> Column:
    """Whether a stretch or point is active in its window."""
    start, end, lo, hi = (F.col(c) for c in ("start", "end", "lo", "hi"))
    point = start == end
    if window == 0:
        return F.when(point, c_eq(start, lo)).otherwise(c_leq(start, lo) & c_lt(lo, end))
    inside = c_leq(lo, start) & (c_lt(start, hi) | (F.col("closed") & c_leq(start, hi)))
    return F.when(point, inside).otherwise(c_lt(start, hi) & c_lt(lo, end))


def active(net: Network, grid: Grid, mode: str = "bounded", loops: bool = False) -> DataFrame:
    """Fragments active in each window, ends eligible there: one row for each fragment and window."""
    keys = net.sessions(mode)
    df = net.fragments(loops).select(*keys, "raw_id", "from", "to", "start", "end", "weight", "raw_start", "raw_end", "onset_censored", "terminus_censored")
    out = grid.explode(df).filter(is_active(grid.window))
    if net.presence is not None:
        there = eligible(net, grid).select("bin", "name")
        for end in ("from", "to"):
            out = out.join(there.withColumnRenamed("name", end), ["bin", end], "left_semi")
    return out


def eligible(net: Network, grid: Grid) -> DataFrame:
    """``bin, time, name`` of the vertices that exist in each window."""
    spark = net.spells.sparkSession
    bins = grid.frame(spark)
    if net.presence is None:
        return net.nodes.select("name").crossJoin(F.broadcast(bins.select("bin", "time")))  # windows: a parameter's size
    undeclared = net.nodes.select("name").join(net.presence.select(F.col("node").alias("name")).distinct(), "name", "left_anti")
    there = grid.explode(net.presence).filter(is_active(grid.window)).select("bin", "time", F.col("node").alias("name")).distinct()
    return there.unionByName(undeclared.crossJoin(F.broadcast(bins.select("bin", "time"))).select("bin", "time", "name"))


def snapshot_edges(net: Network, grid: Grid, mode: str = "bounded", loops: bool = False) -> DataFrame:
    """``[session,] bin, time, from, to, weight, n_spells``: one row for each active pair and window."""
    keys = net.sessions(mode)
    once = active(net, grid, mode, loops)
    if net.observed is not None or net.presence is not None:  # else no spell has two fragments
        once = once.groupBy(*keys, "bin", "time", "raw_id", "from", "to").agg(F.first("weight").alias("weight"))
    return once.groupBy(*keys, "bin", "time", "from", "to").agg(F.sum("weight").alias("weight"), F.count("*").alias("n_spells"))
