"""Events, exact continuous-time quantities, durations, gaps and burstiness."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kairograph.errors import BadInput
from kairograph.functions.islands import islands, union_length
from kairograph.functions.timeops import c_leq, c_lt
from kairograph.plans.grid import is_active, make_grid
from kairograph.plans.network import Network

def null() -> Column:
    return F.lit(None).cast("double")


def _in_bin(window: float) -> Column:
    """Whether the time ``t`` of an event falls in its window."""
    if window == 0:
        return c_leq(F.col("t"), F.col("lo")) & c_leq(F.col("lo"), F.col("t"))
    return c_leq(F.col("lo"), F.col("t")) & (c_lt(F.col("t"), F.col("hi")) | (F.col("closed") & c_leq(F.col("t"), F.col("hi"))))


def events(net: Network, sessions: str = "bounded", **grid) -> DataFrame:
    """``[session,] time, formation, dissolution, active, new_pairs`` of every window.

    Formation and dissolution are uncensored starts and ends, seen in observed
    time; a pair is new where its first evidence is, unless that is censored.
    """
    g = make_grid(net, **grid)
    keys = net.sessions(sessions)
    raw = net.spells.filter(F.col("from") != F.col("to"))
    seen = _observed(net, F.col("t"))
    starts = raw.filter(~F.col("onset_censored")).select(*keys, F.col("start").alias("t")).filter(seen)
    ends = raw.filter(~F.col("terminus_censored")).select(*keys, F.col("end").alias("t")).filter(seen)
    first = raw.groupBy(*keys, "from", "to").agg(F.min(F.struct("start", (~F.col("onset_censored")).alias("known"))).alias("f"))
    fresh = first.filter("f.known").select(*keys, F.col("f.start").alias("t")).filter(seen)

    def per_bin(df: DataFrame, name: str) -> DataFrame:
        spread = g.explode(df.withColumns({"start": F.col("t"), "end": F.col("t")})).filter(_in_bin(g.window))
        return spread.groupBy(*keys, "bin").agg(F.count("*").alias(name))

    live = g.explode(net.fragments().select(*keys, "raw_id", "start", "end")).filter(is_active(g.window)).groupBy(*keys, "bin").agg(F.countDistinct("raw_id").alias("active"))
    frame = F.broadcast(g.frame(net.spells.sparkSession).select("bin", "time"))
    out = net.spells.select("session").distinct().crossJoin(frame) if keys else frame
    for part in (per_bin(starts, "formation"), per_bin(ends, "dissolution"), live, per_bin(fresh, "new_pairs")):
        out = out.join(part, [*keys, "bin"], "left")
    names = ("formation", "dissolution", "active", "new_pairs")
    return out.select(*keys, "time", *[F.coalesce(c, F.lit(0)).alias(c) for c in names])


def _observed(net: Network, t: Column) -> Column:
    if net.observed is None:
        return F.lit(True)
    out = F.lit(False)
    for a, b in net.observed:
        out = out | (c_leq(F.lit(a), t) & c_leq(t, F.lit(b)))
    return out


def vertex_time(net: Network, start: float, end: float) -> DataFrame:
    """``node, start, end`` of the stretches in which each vertex exists inside a window."""
    spark = net.spells.sparkSession
    pieces = [(max(a, start), min(b, end)) for a, b in (net.observed or ((start, end),)) if max(a, start) < min(b, end)]
    watched = spark.createDataFrame(pieces or [(start, start)], "wa double, wb double").filter("wa < wb")
    if net.presence is None:
        return net.nodes.select(F.col("name").alias("node")).crossJoin(F.broadcast(watched)).select("node", F.col("wa").alias("start"), F.col("wb").alias("end"))
    always = net.nodes.select(F.col("name").alias("node")).join(net.presence.select("node").distinct(), "node", "left_anti").crossJoin(F.broadcast(watched)).select("node", F.col("wa").alias("start"), F.col("wb").alias("end"))
    some = net.presence.crossJoin(F.broadcast(watched)).select("node", F.greatest("start", "wa").alias("start"), F.least("end", "wb").alias("end")).filter("start < end")
    return always.unionByName(some)


def exposure(net: Network, **grid) -> DataFrame:
    """``time, risk, occupied, cohort_risk, onsets`` and the densities and intensities made of them.

    Occupied pair-time is the length of unions of each pair's fragments; pair-time
    at risk comes from a sweep over how many vertices exist, never from pairs.
    """
    g = make_grid(net, **grid)
    spark = net.spells.sparkSession
    fragments = net.fragments().filter("start < end").select("raw_id", "from", "to", "start", "end")
    cut = g.explode(fragments).filter(is_active(g.window or 1e-300)).select("bin", "from", "to", F.greatest("start", "lo").alias("start"), F.least("end", "hi").alias("end")).filter("start < end")
    occupied = union_length(cut, ["bin", "from", "to"], "u").groupBy("bin").agg(F.sum("u").alias("occupied"))
    lo, hi = min(b.lo for b in g.bins), max(b.hi for b in g.bins)
    top = net.span()[1]
    alive = vertex_time(net, lo, min(hi, top) if net.observed is None else hi)
    stretches = g.explode(alive).filter(is_active(g.window or 1e-300)).select("bin", F.greatest("start", "lo").alias("a"), F.least("end", "hi").alias("b")).filter("a < b")
    steps = stretches.select("bin", F.col("a").alias("t"), F.lit(1).alias("d")).unionByName(stretches.select("bin", F.col("b").alias("t"), F.lit(-1).alias("d"))).groupBy("bin", "t").agg(F.sum("d").alias("d"))
    w = Window.partitionBy("bin").orderBy("t")
    swept = steps.withColumn("k", F.sum("d").over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("double")).withColumn("dt", F.lead("t").over(w) - F.col("t"))
    half = 1.0 if net.directed else 2.0
    risk = swept.groupBy("bin").agg(F.sum(F.coalesce("dt", F.lit(0.0)) * F.col("k") * (F.col("k") - 1) / half).alias("risk"))
    pairs = net.fragments().select("from", "to").distinct()
    cohort = g.explode(_pair_time(net, pairs, alive)).filter(is_active(g.window or 1e-300)).select("bin", "from", "to", F.greatest("start", "lo").alias("a"), F.least("end", "hi").alias("b")).filter("a < b").groupBy("bin").agg(F.sum(F.col("b") - F.col("a")).alias("cohort_risk"))
    onset = net.spells.filter((F.col("from") != F.col("to")) & ~F.col("onset_censored")).select(F.col("start").alias("t")).filter(_observed(net, F.col("t")))
    onsets = g.explode(onset.withColumns({"start": F.col("t"), "end": F.col("t")})).filter(_in_bin(g.window)).groupBy("bin").agg(F.count("*").cast("double").alias("onsets"))
    out = g.frame(spark).select("bin", "time")
    for part in (risk, occupied, cohort, onsets):
        out = out.join(part, "bin", "left")
    out = out.select("time", *[F.coalesce(c, F.lit(0.0)).alias(c) for c in ("risk", "occupied", "cohort_risk", "onsets")])
    div = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.when(F.col(b) > 0, F.col(b)).otherwise(1.0)).otherwise(null())
    return out.withColumns({"temporal_density": div("occupied", "risk"), "observed_pair_density": div("occupied", "cohort_risk"), "onset_intensity": div("onsets", "risk"), "observed_pair_onset_intensity": div("onsets", "cohort_risk")})


def _pair_time(net: Network, pairs: DataFrame, alive: DataFrame) -> DataFrame:
    """``from, to, start, end`` in which both ends of the given pairs exist."""
    a = alive.select(F.col("node").alias("from"), F.col("start").alias("sa"), F.col("end").alias("ea"))
    b = alive.select(F.col("node").alias("to"), F.col("start").alias("sb"), F.col("end").alias("eb"))
    return pairs.join(a, "from").join(b, "to").select("from", "to", F.greatest("sa", "sb").alias("start"), F.least("ea", "eb").alias("end")).filter("start < end")


def transitions(net: Network, at: list[float]) -> DataFrame:
    """``time, formation_fraction, dissolution_fraction`` at instants.

    Who could form a tie had none just before; who could end one had one.  Pairs in
    both come from vertices that exist on both sides of the instant.
    """
    spark = net.spells.sparkSession
    times = F.broadcast(spark.createDataFrame([(float(t),) for t in at], "t double"))  # instants: a parameter
    f = net.fragments().filter("start < end").crossJoin(times)
    before = (F.col("start") < F.col("t")) & (F.col("t") <= F.col("end"))
    after = (F.col("start") <= F.col("t")) & (F.col("t") < F.col("end"))
    state = f.filter(before | after).groupBy("t", "from", "to").agg(F.max(before).alias("b"), F.max(after).alias("a"), F.max((F.col("raw_start") == F.col("t")) & ~F.col("onset_censored")).alias("on"), F.max((F.col("raw_end") == F.col("t")) & ~F.col("terminus_censored")).alias("off"))
    sums = state.groupBy("t").agg(F.count(F.when(F.col("b"), 1)).cast("double").alias("ties"), F.count(F.when(~F.col("b") & F.col("a") & F.col("on"), 1)).cast("double").alias("made"), F.count(F.when(F.col("b") & ~F.col("a") & F.col("off"), 1)).cast("double").alias("ended"))
    lo, hi = net.span()
    alive = vertex_time(net, lo, hi).crossJoin(times).filter((F.col("start") < F.col("t")) & (F.col("t") < F.col("end")))
    n = alive.groupBy("t").agg(F.countDistinct("node").cast("double").alias("n"))
    pairs = F.col("n") * (F.col("n") - 1) / (1.0 if net.directed else 2.0)
    out = times.join(n, "t", "left").join(sums, "t", "left").fillna(0.0)
    risk = pairs - F.col("ties")
    return out.select(F.col("t").alias("time"), F.when(risk > 0, F.col("made") / F.when(risk > 0, risk).otherwise(1.0)).alias("formation_fraction"), F.when(F.col("ties") > 0, F.col("ended") / F.when(F.col("ties") > 0, F.col("ties")).otherwise(1.0)).alias("dissolution_fraction"))


def rates(net: Network, infinite: bool = False, **grid) -> DataFrame:
    """``time, formation_rate, dissolution_rate``: confirmed changes over pair-time that could change.

    Where no pair-time could change a rate is null; with ``infinite`` it is infinite if
    there were changes and nan if there were none.
    """
    e, x = events(net, **grid), exposure(net, **grid)
    idle = F.col("risk") - F.col("occupied")
    none = lambda n: F.when(F.col(n) > 0, float("inf")).otherwise(float("nan")) if infinite else null()
    per = lambda n, d: F.when(d > 0, F.col(n) / F.when(d > 0, d).otherwise(1.0)).otherwise(none(n))
    return e.join(x, "time").select("time", per("formation", idle).alias("formation_rate"), per("dissolution", F.col("occupied")).alias("dissolution_rate"))


def durations(net: Network, unit: str = "pair", mode: str = "all", sessions: str = "bounded") -> DataFrame:
    """How long pairs, spells, vertices or a vertex's ties last, in observed time."""
    keys = net.sessions(sessions)
    length = F.col("end") - F.col("start")
    whole = net.fragments().select(*keys, "raw_id", "from", "to", "start", "end")
    if unit == "spell":
        return whole.groupBy(*keys, "raw_id", "from", "to").agg(F.sum(length).alias("duration"), F.min("start").alias("first"), F.max("end").alias("last"))
    if unit == "pair":
        per = whole.groupBy(*keys, "raw_id", "from", "to").agg(F.sum(length).alias("d"), F.min("start").alias("s"), F.max("end").alias("e"))
        sums = per.groupBy(*keys, "from", "to").agg(F.count("*").alias("events"), F.sum("d").alias("total"), F.avg("d").alias("mean"), F.median("d").alias("median"), F.min("s").alias("first"), F.max("e").alias("last"))
        return _safe_join(sums, union_length(whole, [*keys, "from", "to"]), [*keys, "from", "to"])
    if unit == "node_ties":
        out, back = whole.withColumn("node", F.col("from")), whole.withColumn("node", F.col("to"))
        ties = out.unionByName(back) if mode == "all" or not net.directed else out if mode == "out" else back
        sums = ties.groupBy(*keys, "node").agg(F.countDistinct("raw_id").alias("events"), F.sum(length).alias("total"))
        return _safe_join(sums, union_length(ties, [*keys, "node"]), [*keys, "node"])
    if unit == "vertex_activity":
        lo, hi = net.span()
        return vertex_time(net, lo, hi).groupBy("node").agg(F.count("*").alias("events"), F.sum(length).alias("total"), F.min("start").alias("first"), F.max("end").alias("last"))
    if unit == "vertex_spell":
        lo, hi = net.span()
        return vertex_time(net, lo, hi).select("node", length.alias("duration"), F.col("start").alias("first"), F.col("end").alias("last"))
    raise BadInput(f"unknown unit {unit!r}")


def _safe_join(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """A join in which missing sessions are equal."""
    on = None
    for k in keys:
        c = a[k].eqNullSafe(b[k])
        on = c if on is None else on & c
    return a.join(b, on).select(*[a[c] for c in a.columns], *[b[c] for c in b.columns if c not in keys])


def clock(net: Network, t: Column) -> Column:
    """Observed time before ``t``: time that was not watched does not pass."""
    if net.observed is None:
        return t
    out, passed = F.lit(None).cast("double"), 0.0
    steps = []
    for a, b in net.observed:
        steps.append((a, passed - a))
        passed += b - a
    for a, shift in steps:
        out = F.when(c_leq(F.lit(a), t), F.greatest(t, F.lit(a)) + shift).otherwise(out)
    return out


def _stream(net: Network, unit: str, sessions: str, censored: str = "exclude") -> tuple[DataFrame, list[str]]:
    """One row for each event of each subject: starts inside observed time, on its clock as ``u``."""
    if censored not in ("exclude", "include"):
        raise BadInput("censored is exclude or include")
    s = net.spells if censored == "include" else net.spells.filter(~F.col("onset_censored"))
    s = s.select(net.walls(sessions).alias("wall"), "raw_id", "from", "to", F.col("start").alias("t")).filter(_observed(net, F.col("t"))).withColumn("u", clock(net, F.col("t")))
    if unit == "pair":
        return s.filter(F.col("from") != F.col("to")), ["wall", "from", "to"]
    if unit == "node":
        return s.withColumn("node", F.explode(F.array_distinct(F.array("from", "to")))).drop("from", "to"), ["wall", "node"]
    raise BadInput(f"unknown unit {unit!r}")


def gaps(net: Network, unit: str = "node", sessions: str = "bounded", censored: str = "exclude") -> DataFrame:
    """One row for each gap of observed time between an event and the one before, with the later event's time."""
    s, keys = _stream(net, unit, sessions, censored)
    w = Window.partitionBy(*keys).orderBy("t", "raw_id")
    rows = s.withColumn("gap", F.col("u") - F.lag("u").over(w)).withColumn("index", F.row_number().over(w) - 1)
    return rows.filter("gap is not null").select(F.col("wall").alias("session"), *keys[1:], F.col("t").alias("time"), "index", "gap")


def burstiness(net: Network, unit: str = "node", sessions: str = "bounded") -> DataFrame:
    """``events, mean_gap, burstiness, memory`` of every subject.

    Burstiness needs two gaps that are not all nought, memory two pairs of
    neighbouring gaps that vary.  Gaps never reach over sessions when bounded; they
    are lengths of observed time, and starts that are censored are no events.
    """
    s, keys = _stream(net, unit, sessions)
    who = keys[1:]
    w = Window.partitionBy(*keys).orderBy("t", "raw_id")
    g = s.withColumn("gap", F.col("u") - F.lag("u").over(w)).withColumn("before", F.lag("gap").over(w))
    x, y = F.col("before"), F.col("gap")
    both = x.isNotNull() & y.isNotNull()
    sums = g.groupBy(*who).agg(
        F.count("*").alias("events"), F.avg("gap").alias("mean_gap"), F.stddev_pop("gap").alias("sd"), F.count("gap").alias("n"), F.count(F.when(both, 1)).cast("double").alias("k"),
        F.sum(F.when(both, x)).alias("sx"), F.sum(F.when(both, y)).alias("sy"), F.sum(F.when(both, x * y)).alias("sxy"), F.sum(F.when(both, x * x)).alias("sxx"), F.sum(F.when(both, y * y)).alias("syy"),
    )
    size = F.col("sd") + F.col("mean_gap")
    burst = F.when((F.col("n") >= 2) & (size > 0), F.least(F.lit(1 - 2.0**-53), (F.col("sd") - F.col("mean_gap")) / F.when(size > 0, size).otherwise(1.0)))
    vx, vy = F.col("k") * F.col("sxx") - F.col("sx") ** 2, F.col("k") * F.col("syy") - F.col("sy") ** 2
    least = 1e-12 * F.greatest(F.lit(1.0), F.col("k") * F.col("sxx"))
    good = (F.col("k") >= 2) & (vx > least) & (vy > least)
    memory = F.when(good, (F.col("k") * F.col("sxy") - F.col("sx") * F.col("sy")) / F.sqrt(F.when(good, vx * vy).otherwise(1.0)))
    return sums.select(*who, "events", "mean_gap", burst.alias("burstiness"), memory.alias("memory"))


def collapse_network(net: Network) -> DataFrame:
    """One row for each pair: binary, durations, counts, weights, first and last contact."""
    f = net.fragments().select("raw_id", "from", "to", "start", "end", "weight")
    d = F.col("end") - F.col("start")
    per = f.groupBy("raw_id", "from", "to").agg(F.sum(d).alias("d"), F.min("start").alias("s"), F.max("end").alias("e"), F.first("weight").alias("w"))
    sums = per.groupBy("from", "to").agg(
        F.lit(1).alias("binary"), F.sum("d").alias("total_duration"), F.count("*").alias("spell_count"), F.sum("w").alias("weight_sum"), F.sum(F.col("w") * F.col("d")).alias("weighted_duration"),
        F.max_by("w", F.struct("e", "raw_id")).alias("latest_weight"), F.min("s").alias("first"), F.max("e").alias("last"),
    )
    runs = islands(f.select("from", "to", "start", "end"), ["from", "to"]).groupBy("from", "to").agg(F.sum(d).alias("union_duration"), F.count("*").alias("activity_count"))
    lo, hi = net.span()
    joint = _pair_time(net, sums.select("from", "to"), vertex_time(net, lo, hi)).groupBy("from", "to").agg(F.sum(d).alias("joint"))
    out = sums.join(runs, ["from", "to"]).join(joint, ["from", "to"], "left")
    return out.withColumn("duration_fraction", F.when(F.col("joint") > 0, F.col("union_duration") / F.when(F.col("joint") > 0, F.col("joint")).otherwise(1.0))).drop("joint")


def aggregate_network(net: Network) -> DataFrame:
    """``from, to, weight`` summed over all spells, positive ones only."""
    return net.spells.groupBy("from", "to").agg(F.sum("weight").alias("weight")).filter("weight > 0")


def network_summary(net: Network) -> DataFrame:
    """``property, value`` of the whole network."""
    lo, hi = net.span()
    s = net.spells.agg(F.count("*").cast("double").alias("spells"), F.countDistinct("from", "to").cast("double").alias("pairs"), F.count(F.when(F.col("start") == F.col("end"), 1)).cast("double").alias("points"), F.avg(F.col("end") - F.col("start")).alias("mean_duration"), F.sum("weight").alias("weight"), F.countDistinct("session").cast("double").alias("sessions"), F.count(F.when(F.col("onset_censored") | F.col("terminus_censored"), 1)).cast("double").alias("censored"))
    n = net.nodes.agg(F.count("*").cast("double").alias("nodes"))
    wide = s.crossJoin(n).withColumns({"start": F.lit(lo), "end": F.lit(hi), "bins": F.lit(float(len(make_grid(net).bins)))})  # one row each
    return wide.unpivot([], wide.columns, "property", "value")

