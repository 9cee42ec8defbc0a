"""Editing: every verb takes a network and returns a new one."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kairograph.errors import BadInput, NeedsDirected
from kairograph.functions.islands import islands
from kairograph.functions.timeops import c_eq, c_leq
from kairograph.plans.network import Network, canonical, merge_windows


def _redo(net: Network, spells: DataFrame) -> Network:
    out = canonical(spells.drop("raw_id"), net.directed, loops=True)
    if out.isEmpty():
        raise BadInput("no tie would be left")
    return net.with_(spells=out)


def _condition(where: str | Column) -> Column:
    return F.coalesce(F.expr(where) if isinstance(where, str) else where, F.lit(False))


def add_nodes(net: Network, data: DataFrame) -> Network:
    data = data.withColumn("name", F.col("name").cast("string"))
    if not data.join(net.nodes, "name", "left_semi").isEmpty() or data.count() != data.select("name").distinct().count():
        raise BadInput("a vertex is there already or named twice")
    return net.with_(nodes=net.nodes.unionByName(data, allowMissingColumns=True))


def remove_nodes(net: Network, names: list[str], cascade: bool = False) -> Network:
    gone = F.col("from").isin(names) | F.col("to").isin(names)
    if not cascade and not net.spells.filter(gone).isEmpty():
        raise BadInput("a vertex has ties; pass cascade=True")
    presence = net.presence.filter(~F.col("node").isin(names)) if net.presence is not None else None
    return _redo(net.with_(nodes=net.nodes.filter(~F.col("name").isin(names)), presence=presence), net.spells.filter(~gone))


def add_ties(net: Network, data: DataFrame, loops: bool = False) -> Network:
    """Ties with ``from, to, start, end``; both ends must be there."""
    if missing := {"from", "to", "start", "end"} - set(data.columns):
        raise BadInput(f"missing {sorted(missing)}")
    if {"duration", "raw_id"} & set(data.columns):
        raise BadInput("durations and ids are not given")
    ends = data.select(F.explode(F.array(F.col("from").cast("string"), F.col("to").cast("string"))).alias("name")).distinct()
    if not ends.join(net.nodes, "name", "left_anti").isEmpty():
        raise BadInput("a tie ends at an unknown vertex")
    if not loops and not data.filter(F.col("from") == F.col("to")).isEmpty():
        raise BadInput("a tie is a loop; pass loops=True")
    if not data.filter("end < start").isEmpty():
        raise BadInput("a tie ends before it starts")
    return _redo(net, net.spells.unionByName(canonical(data, net.directed, True), allowMissingColumns=True))


def add_arcs(net: Network, data: DataFrame, loops: bool = False) -> Network:
    if not net.directed:
        raise NeedsDirected("arcs need a directed network")
    return add_ties(net, data, loops)


def select_ties(where: str | Column | None = None, source: str | None = None, target: str | None = None, start: float | None = None, end: float | None = None, session: str | None = None) -> Column:
    """One condition of a predicate and of given values; times are compared up to rounding."""
    out = F.lit(True) if where is None else _condition(where)
    for c, v in (("from", source), ("to", target), ("session", session)):
        if v is not None:
            out = out & F.coalesce(F.col(c) == v, F.lit(False))
    for c, v in (("start", start), ("end", end)):
        if v is not None:
            out = out & c_eq(F.col(c), F.lit(float(v)))
    return out


def remove_ties(net: Network, where: str | Column | None = None, **values: Any) -> Network:
    hit = select_ties(where, **values)
    if net.spells.filter(hit).isEmpty():
        raise BadInput("no tie is selected")
    return _redo(net, net.spells.filter(~hit))


def remove_arcs(net: Network, where: str | Column | None = None, **values: Any) -> Network:
    if not net.directed:
        raise NeedsDirected("arcs need a directed network")
    return remove_ties(net, where, **values)


def update_ties(net: Network, where: str | Column, changes: dict[str, Any], loops: bool = False) -> Network:
    """New values, or expressions, of columns of the selected ties."""
    hit = select_ties(where)
    value = lambda v: v if isinstance(v, Column) else F.lit(v)
    if "raw_id" in changes:
        raise BadInput("ids are not given")
    marked = net.spells.withColumn("_hit", hit)
    spells = marked.withColumns({c: F.when(F.col("_hit"), value(v)).otherwise(F.col(c) if c in net.spells.columns else F.lit(None)) for c, v in changes.items()}).drop("_hit")
    if not loops and not spells.filter(F.col("from") == F.col("to")).isEmpty() and net.spells.filter(F.col("from") == F.col("to")).isEmpty():
        raise BadInput("a tie becomes a loop; pass loops=True")
    out = _redo(net, spells)
    return out.with_(format="interval") if {"start", "end"} & set(changes) else out


def update_nodes(net: Network, data: DataFrame) -> Network:
    """New or changed attributes by ``name``; other vertices keep theirs."""
    fresh = [c for c in data.columns if c != "name"]
    d = data.select("name", F.lit(True).alias("_hit"), *[F.col(c).alias(f"_{c}") for c in fresh])
    j = net.nodes.join(d, "name", "left")
    cols = {c: F.when(F.col("_hit"), F.col(f"_{c}")).otherwise(F.col(c) if c in net.nodes.columns else F.lit(None)) for c in fresh}
    return net.with_(nodes=j.withColumns(cols).drop("_hit", *[f"_{c}" for c in fresh]))


def rename_nodes(net: Network, mapping: dict[str, str]) -> Network:
    """One-to-one renaming; swaps are allowed, collisions with kept names are not."""
    if len(set(mapping.values())) != len(mapping):
        raise BadInput("two vertices would get one name")
    kept = net.nodes.filter(~F.col("name").isin(list(mapping)))
    if not kept.filter(F.col("name").isin(list(mapping.values()))).isEmpty():
        raise BadInput("a new name is taken")
    table = F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv])
    new = lambda c: F.coalesce(F.try_element_at(table, F.col(c)), F.col(c))
    presence = net.presence.withColumn("node", new("node")) if net.presence is not None else None
    return _redo(net.with_(nodes=net.nodes.withColumn("name", new("name")), presence=presence), net.spells.withColumns({"from": new("from"), "to": new("to")}))


def induce_subgraph(net: Network, nodes: str | Column | None = None, ties: str | Column | None = None, keep_isolates: bool = False) -> Network:
    """Ties that meet a condition between vertices that meet one."""
    spells = net.spells if ties is None else net.spells.filter(_condition(ties))
    wanted = net.nodes if nodes is None else net.nodes.filter(_condition(nodes))
    for end in ("from", "to"):
        spells = spells.join(wanted.select(F.col("name").alias(end)), end, "left_semi")
    if not keep_isolates:
        wanted = wanted.join(spells.select(F.explode(F.array("from", "to")).alias("name")).distinct(), "name", "left_semi")
    presence = net.presence.join(wanted.select(F.col("name").alias("node")), "node", "left_semi") if net.presence is not None else None
    return _redo(net.with_(nodes=wanted, presence=presence), spells.select(*net.spells.columns))


def _presence(net: Network, data: DataFrame) -> Network:
    typed = data.select(F.col("node").cast("string").alias("node"), F.col("start").cast("double").alias("start"), F.col("end").cast("double").alias("end"))
    return net.with_(presence=islands(typed, ["node"], tolerant=True))


def set_vertex_spells(net: Network, data: DataFrame | str | None = None) -> Network:
    """Presence from a table, from first and last ties (``"ties"``), or none."""
    if data is None:
        return net.with_(presence=None)
    if isinstance(data, str):
        if data != "ties":
            raise BadInput(f"unknown presence {data!r}")
        ends = net.spells.select("start", "end", F.explode(F.array("from", "to")).alias("node"))
        data = ends.groupBy("node").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    return _presence(net, data)


def add_vertex_spells(net: Network, data: DataFrame) -> Network:
    return _presence(net, data if net.presence is None else net.presence.unionByName(data.select("node", "start", "end")))


def remove_vertex_spells(net: Network, where: str | Column) -> Network:
    if net.presence is None:
        raise BadInput("no presence is declared")
    return _presence(net, net.presence.filter(~_condition(where)))


def update_vertex_spells(net: Network, where: str | Column, changes: dict[str, Any]) -> Network:
    if net.presence is None:
        raise BadInput("no presence is declared")
    hit = net.presence.withColumn("_hit", _condition(where))
    return _presence(net, hit.withColumns({c: F.when(F.col("_hit"), v if isinstance(v, Column) else F.lit(v)).otherwise(F.col(c)) for c, v in changes.items()}))


def set_observations(net: Network, windows: Any = None, start: float | None = None, end: float | None = None) -> Network:
    """Watched stretches, or one from ``start`` to ``end``."""
    if windows is None:
        lo, hi = net.span()
        windows = [(lo if start is None else start, hi if end is None else end)]
    return net.with_(observed=merge_windows(windows))


def clear_observations(net: Network) -> Network:
    return net.with_(observed=None)


def set_tie_sessions(net: Network, session: str | Column | None = None, breaks: list[float] | None = None, labels: list[str] | None = None) -> Network:
    """A label for all, an expression, or sessions between breaks; a start at a break opens the later one."""
    if breaks is not None:
        cuts = sorted(float(b) for b in breaks)
        names = labels or [str(i + 1) for i in range(len(cuts) + 1)]
        if len(names) != len(cuts) + 1:
            raise BadInput("one more label than breaks is needed")
        value = F.lit(names[0])
        for b, name in zip(cuts, names[1:], strict=True):
            value = F.when(c_leq(F.lit(b), F.col("start")), F.lit(name)).otherwise(value)
    elif session is None:
        value = F.lit(None).cast("string")
    else:
        value = session if isinstance(session, Column) else F.lit(session)
    return _redo(net, net.spells.withColumn("session", value.cast("string")))


def rename_sessions(net: Network, mapping: dict[str, str]) -> Network:
    table = F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv])
    return _redo(net, net.spells.withColumn("session", F.coalesce(F.try_element_at(table, F.col("session")), F.col("session"))))


