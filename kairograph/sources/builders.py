"""Networks from logs: intervals, contacts, threads, copresence, turns, broadcasts.

Every builder takes any Spark DataFrame (parquet, tables, JSON, ...), finds its
columns by name or alias, and keeps other columns as attributes of ties.
"""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kairograph.errors import BadInput
from kairograph.functions.timeops import UNIT_SECONDS, infer_unit, resolve, seconds
from kairograph.plans.network import Network, build
from kairograph.plans.storage import keep, spread


def _need(df: DataFrame, role: str, named: str | None) -> str:
    found = resolve(df.columns, role, named)
    if found is None:
        raise BadInput(f"no column for {role!r}")
    return found


def _clock(df: DataFrame, columns: list[str], unit: str | None) -> tuple[DataFrame, str, float]:
    """Time columns as offsets from the first one in a unit."""
    read = {c: seconds(df, c) for c in columns}
    if len({calendar for _, calendar in read.values()}) > 1:
        raise BadInput("start and end are on different clocks")
    out = df.withColumns({c: x for c, (x, _) in read.items()})
    if not read[columns[0]][1]:
        return out, unit or "step", 0.0
    ends = out.agg(F.min(columns[0]), F.max(F.greatest(*columns) if len(columns) > 1 else F.col(columns[0]))).first()
    if ends[0] is None:
        raise BadInput("no times")
    unit = unit or infer_unit(ends[1] - ends[0])
    return out.withColumns({c: (F.col(c) - F.lit(ends[0])) / F.lit(UNIT_SECONDS[unit]) for c in columns}), unit, ends[0]


def _finish(df: DataFrame, names: dict[str, str], roles: dict[str, str | None], **more: Any) -> Network:
    weight, session = resolve(df.columns, "weight", roles.get("weight")), roles.get("session")
    session = session or (resolve(df.columns, "session") if "session" not in names else None)
    picked = dict(names)
    if weight:
        picked["weight"] = weight
    if session and "session" not in picked:
        picked["session"] = session
    for flag in ("onset_censored", "terminus_censored"):
        if flag in df.columns:
            picked[flag] = flag
    used = set(picked.values()) | set(more.pop("drop", ()))
    taken = {*picked, "raw_id"}
    extra = [c for c in df.columns if c not in used and c not in taken and not c.startswith("_")]
    return build(df.select(*[F.col(v).alias(k) for k, v in picked.items()], *extra), **more)


def interval_network(df: DataFrame, source: str | None = None, target: str | None = None, start: str | None = None, end: str | None = None, duration: str | None = None, weight: str | None = None, session: str | None = None, unit: str | None = None, **more: Any) -> Network:
    """Spells ``[start, end)``, or ``start`` and a duration."""
    f, t, s = _need(df, "from", source), _need(df, "to", target), _need(df, "start", start)
    e = resolve(df.columns, "end", end)
    if e is None:
        d = _need(df, "duration", duration)
        df, unit, origin = _clock(df, [s], unit)
        df, e = df.withColumn("_end", F.col(s) + F.col(d).cast("double")), "_end"
        more["drop"] = (d,)
    else:
        df, unit, origin = _clock(df, [s, e], unit)
    return _finish(df, {"from": f, "to": t, "start": s, "end": e}, {"weight": weight, "session": session}, unit=unit, origin=origin, format="interval", **more)


def contact_network(df: DataFrame, source: str | None = None, target: str | None = None, time: str | None = None, weight: str | None = None, session: str | None = None, unit: str | None = None, **more: Any) -> Network:
    """Contacts at instants."""
    f, t, at = _need(df, "from", source), _need(df, "to", target), _need(df, "time", time)
    df, unit, origin = _clock(df, [at], unit)
    return _finish(df.withColumn("_end", F.col(at)), {"from": f, "to": t, "start": at, "end": "_end"}, {"weight": weight, "session": session}, unit=unit, origin=origin, format="contact", **more)


def threaded_network(df: DataFrame, source: str | None = None, target: str | None = None, time: str | None = None, thread: str | None = None, min_posts: int = 1, relative: bool = False, session: str | None = None, unit: str | None = None, **more: Any) -> Network:
    """Posts that last until their thread's last post; loops go before threads are measured."""
    f, t, at, th = _need(df, "from", source), _need(df, "to", target), _need(df, "time", time), _need(df, "thread", thread)
    df, unit, origin = _clock(df, [at], unit)
    if not more.get("loops", False):
        df = df.filter(F.col(f).cast("string") != F.col(t).cast("string"))
    w = Window.partitionBy(th)
    df = df.withColumn("_n", F.count("*").over(w)).filter(F.col("_n") >= min_posts).withColumn("_end", F.max(at).over(w))
    if relative:
        df = df.withColumn("_first", F.min(at).over(w)).withColumns({at: F.col(at) - F.col("_first"), "_end": F.col("_end") - F.col("_first")})
    return _finish(df, {"from": f, "to": t, "start": at, "end": "_end"}, {"session": session}, unit=unit, origin=origin, format="threaded", **more)


def copresence_network(df: DataFrame, actor: str | None = None, group: str | None = None, time: str | None = None, end: str | None = None, session: str | None = None, unit: str | None = None, **more: Any) -> Network:
    """Every unordered pair of members of a group, for as long as the group lasts.

    Without a clock the k-th group in order of its label lasts ``[k - 1, k)``.
    """
    a, g = _need(df, "actor", actor), _need(df, "group", group)
    at = resolve(df.columns, "time", time) or resolve(df.columns, "start", None)
    stop = resolve(df.columns, "end", end)
    keys = {"_g": F.col(g)}
    if session:
        keys["session"] = F.col(session).cast("string")
    if at:
        df, unit, origin = _clock(df, [at, stop] if stop else [at], unit)
        spans = df.groupBy(F.col(g).alias("_g")).agg(F.min(at).alias("start"), F.max(stop or at).alias("end"))
    else:
        unit, origin = unit or "step", 0.0
        ranked = df.select(F.col(g).alias("_g")).distinct().withColumn("k", F.row_number().over(Window.orderBy("_g")).cast("double"))
        spans = ranked.select("_g", (F.col("k") - 1).alias("start"), F.col("k").alias("end"))
    members = df.select(*[v.alias(k) for k, v in keys.items()], F.col(a).cast("string").alias("_a")).distinct()
    on = list(keys)
    members = spread(keep(members, "members"), *on)  # both sides of the pairs read this table
    one, two = members.withColumnRenamed("_a", "from"), members.withColumnRenamed("_a", "to")
    pairs = one.join(two, on).filter(F.col("from") < F.col("to")).join(spans, "_g")
    picked = pairs.select("from", "to", "start", "end", *(["session"] if session else []), F.col("_g").cast("string").alias("group"))
    return build(picked, directed=False, unit=unit, origin=origin, format="copresence", **more)


def turns_network(df: DataFrame, actor: str | None = None, group: str | None = None, order: list[str] | None = None, time: str | None = None, session: str | None = None, unit: str | None = None, **more: Any) -> Network:
    """A contact from each speaker to the next one of the group, at the next one's time.

    ``order`` names the columns that settle equal times.  The session is the group.
    """
    a, g, at = _need(df, "actor", actor), _need(df, "group", group), _need(df, "time", time)
    df, unit, origin = _clock(df, [at], unit)
    w = Window.partitionBy(g).orderBy(at, *(order or [a]))
    df = df.withColumn("_from", F.lag(F.col(a).cast("string")).over(w)).filter("_from is not null").withColumn("_end", F.col(at)).withColumn("_session", F.col(session or g).cast("string"))
    return _finish(df, {"from": "_from", "to": a, "start": at, "end": "_end", "session": "_session"}, {}, unit=unit, origin=origin, format="turns", drop=(g, *(order or ())), **more)


def broadcast_network(df: DataFrame, actor: str | None = None, group: str | None = None, time: str | None = None, session: str | None = None, unit: str | None = None, **more: Any) -> Network:
    """A contact from the actor to every other member of the group, for each action."""
    a, g, at = _need(df, "actor", actor), _need(df, "group", group), _need(df, "time", time)
    df, unit, origin = _clock(df, [at], unit)
    members = df.select(F.col(g).alias("_g"), F.col(a).cast("string").alias("to")).distinct()
    acts = df.select(F.col(g).alias("_g"), F.col(a).cast("string").alias("from"), F.col(at).alias("start"), F.col(session or g).cast("string").alias("session"))
    sent = acts.join(members, "_g").filter(F.col("from") != F.col("to")).drop("_g").withColumn("end", F.col("start"))
    return build(sent, unit=unit, origin=origin, format="broadcast", **more)


def network(df: DataFrame, format: str | None = None, **roles: Any) -> Network:
    """The network of a log; without ``format`` the columns decide."""
    cols = df.columns
    if format is None:
        has = lambda role: resolve(cols, role, roles.get(role)) is not None
        if has("actor") and has("group"):
            format = "copresence"
        elif has("thread"):
            format = "threaded"
        elif has("end") or has("duration"):
            format = "interval"
        else:
            format = "contact"
    makers = {"interval": interval_network, "contact": contact_network, "threaded": threaded_network, "copresence": copresence_network, "turns": turns_network, "broadcast": broadcast_network}
    if format not in makers:
        raise BadInput(f"unknown format {format!r}")
    return makers[format](df, **roles)


def from_tables(spells: DataFrame, nodes: DataFrame | None = None, presence: DataFrame | None = None, observed: Any = None, **more: Any) -> Network:
    """A network of ready-made tables."""
    return build(spells, nodes=nodes, presence=presence, observed=observed, **more)


def write_network(net: Network, path: str) -> None:
    """The tables of a network as parquet."""
    net.spells.write.mode("overwrite").parquet(f"{path}/spells")
    net.nodes.write.mode("overwrite").parquet(f"{path}/nodes")
    if net.presence is not None:
        net.presence.write.mode("overwrite").parquet(f"{path}/presence")


def read_network(spark: Any, path: str, directed: bool = True, presence: bool = False, **more: Any) -> Network:
    """A network that :func:`write_network` wrote."""
    return Network(spark.read.parquet(f"{path}/spells"), spark.read.parquet(f"{path}/nodes"), directed, spark.read.parquet(f"{path}/presence") if presence else None, **more)
