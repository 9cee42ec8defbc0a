"""The temporal network: edge spells, vertices, presence and observed time."""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kairograph.errors import BadInput, NoSessions
from kairograph.functions.islands import islands
from kairograph.functions.timeops import c_leq

CORE = ("raw_id", "from", "to", "start", "end", "weight", "session", "onset_censored", "terminus_censored")
MODES = ("bounded", "collapse", "separate")


@dataclass(frozen=True)
class Network:
    """Tables and clock of a temporal network; every change makes a new one.

    ``spells`` has the columns ``CORE`` and attributes of ties, ``nodes`` a unique
    ``name`` and attributes, ``presence`` stretches during which a vertex exists (a
    vertex without rows always exists), ``observed`` the watched stretches of time
    (None: from the first start to the last end).
    """

    spells: DataFrame
    nodes: DataFrame
    directed: bool = True
    presence: DataFrame | None = None
    observed: tuple[tuple[float, float], ...] | None = None
    interval: float = 1.0
    unit: str = "step"
    origin: float = 0.0
    format: str = "interval"
    meta: dict[str, Any] = field(default_factory=dict)

    def with_(self, **changes: Any) -> Network:
        return replace(self, **changes)

    @property
    def attributes(self) -> list[str]:
        return [c for c in self.spells.columns if c not in CORE]

    def span(self) -> tuple[float, float]:
        """First and last time of the network."""
        if self.observed:
            return self.observed[0][0], self.observed[-1][1]
        r = self.spells.agg(F.min("start"), F.max("end")).first()
        if r[0] is None:
            raise BadInput("the network has no ties")
        return float(r[0]), float(r[1])

    def fragments(self, loops: bool = False) -> DataFrame:
        """Spells cut to observed time and to the presence of both ends.

        Adds ``raw_start`` and ``raw_end``; points stay points and count on closed
        stretches.
        """
        df = self.spells.withColumn("raw_start", F.col("start")).withColumn("raw_end", F.col("end"))
        if not loops:
            df = df.filter(F.col("from") != F.col("to"))
        if self.observed is not None:
            windows = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in self.observed])
            df = _clip(df.withColumn("_w", F.explode(windows)), F.col("_w.a"), F.col("_w.b")).drop("_w")
        if self.presence is not None:
            for end in ("from", "to"):
                declared = self.presence.select(F.col("node").alias(end), F.struct(F.col("start").alias("a"), F.col("end").alias("b")).alias("_p"))
                some = declared.select(end).distinct().withColumn("_declared", F.lit(True))
                df = df.join(some, end, "left").join(declared, end, "left")
                df = _clip(df, F.coalesce("_p.a", F.lit(float("-inf"))), F.coalesce("_p.b", F.lit(float("inf")))).drop("_p", "_declared")
        return df

    def sessions(self, mode: str) -> list[str]:
        """Grouping columns that a session mode adds."""
        if mode not in MODES:
            raise BadInput(f"sessions must be one of {MODES}")
        if mode == "separate":
            if self.spells.filter("session is not null").isEmpty():
                raise NoSessions("the network has no sessions")
            return ["session"]
        return []

    def walls(self, mode: str) -> Column:
        """What keeps event sequences apart: the session, unless sessions are collapsed."""
        return F.lit(None).cast("string") if mode == "collapse" else F.col("session")


def _clip(df: DataFrame, a: Column, b: Column) -> DataFrame:
    start, end = F.greatest("start", a), F.least("end", b)
    point = F.col("start") == F.col("end")
    keep = F.when(point, c_leq(a, F.col("start")) & c_leq(F.col("start"), b)).otherwise(start < end)
    return df.filter(keep).withColumns({"start": F.when(point, F.col("start")).otherwise(start), "end": F.when(point, F.col("end")).otherwise(end)})


def canonical(spells: DataFrame, directed: bool, loops: bool = False) -> DataFrame:
    """Spells with ordered ends if undirected, typed columns and content-made ids.

    Ids come from the content and the number of the copy, so no global sort is
    needed and no partitioning shows in them.
    """
    have = set(spells.columns)
    defaults = {"weight": F.lit(1.0), "session": F.lit(None).cast("string"), "onset_censored": F.lit(False), "terminus_censored": F.lit(False)}
    df = spells.withColumns({k: v for k, v in defaults.items() if k not in have})
    df = df.withColumns({"from": F.col("from").cast("string"), "to": F.col("to").cast("string"), **{c: F.col(c).cast("double") for c in ("start", "end", "weight")}, "session": F.col("session").cast("string")})
    if not loops:
        df = df.filter(F.col("from") != F.col("to"))
    if not directed:
        df = df.withColumns({"from": F.least("from", "to"), "to": F.greatest("from", "to")})
    content = ["from", "to", "start", "end", "weight", "session"]
    copy = F.row_number().over(Window.partitionBy(*content).orderBy(*content))
    df = df.withColumn("raw_id", F.xxhash64(*content, copy))
    return df.select(*CORE, *[c for c in df.columns if c not in CORE])


def build(spells: DataFrame, directed: bool = True, nodes: DataFrame | None = None, loops: bool = False, keep_isolates: bool = False, presence: DataFrame | None = None, observed: tuple[tuple[float, float], ...] | None = None, check: bool = True, **more: Any) -> Network:
    """A network of a table with ``from, to, start, end`` and whatever else there is."""
    if check:
        bad = spells.agg(
            F.count(F.when(F.col("end") < F.col("start"), 1)).alias("backwards"),
            F.count(F.when(F.col("start").isNull() | F.col("end").isNull(), 1)).alias("untimed"),
            F.count(F.when(F.col("from").isNull() | F.col("to").isNull(), 1)).alias("unnamed"),
        ).first()
        for what, n in bad.asDict().items():
            if n:
                raise BadInput(f"{n} {what} ties")
        if "weight" in spells.columns and not spells.filter((F.col("weight") < 0) | F.isnan(F.col("weight").cast("double")) | F.col("weight").isNull()).isEmpty():
            raise BadInput("weights must be finite and not negative")
    spells = canonical(spells, directed, loops)
    seen = spells.select(F.explode(F.array("from", "to")).alias("name")).distinct()
    if nodes is None:
        vertices = seen
    else:
        key = "name" if "name" in nodes.columns else nodes.columns[0]
        table = nodes.withColumn("name", F.col(key).cast("string")).select("name", *[c for c in nodes.columns if c not in ("name", key)])
        vertices = seen.join(table, "name", "full" if keep_isolates else "left")
    if presence is not None:
        presence = islands(presence.select(F.col("node").cast("string").alias("node"), F.col("start").cast("double").alias("start"), F.col("end").cast("double").alias("end")), ["node"], tolerant=True)
    return Network(spells, vertices, directed, presence, merge_windows(observed), **more)


def merge_windows(windows: Any) -> tuple[tuple[float, float], ...] | None:
    """Observed stretches in order, joined where they overlap or touch."""
    from kairograph.functions.timeops import leq

    if windows is None:
        return None
    out: list[tuple[float, float]] = []
    for a, b in sorted((float(a), float(b)) for a, b in windows):
        if b < a:
            raise BadInput("an observed stretch ends before it starts")
        if out and leq(a, out[-1][1]):
            out[-1] = out[-1][0], max(b, out[-1][1])
        else:
            out.append((a, b))
    if not out:
        raise BadInput("no observed time")
    return tuple(out)
