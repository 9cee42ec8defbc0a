"""Comparison of times that differ by rounding, and reading of clocks."""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kairograph.errors import BadInput

#: 128 units of rounding in the larger of the two values and one.
EPS = 128 * 2.0**-52


def tol(a: float, b: float) -> float:
    size = max(1.0, *(abs(x) for x in (a, b) if math.isfinite(x)), 0.0)
    return EPS * size


def eq(a: float, b: float) -> bool:
    return a == b or abs(a - b) <= tol(a, b)


def lt(a: float, b: float) -> bool:
    return a < b and not eq(a, b)


def leq(a: float, b: float) -> bool:
    return a <= b or eq(a, b)


def c_tol(a: Column, b: Column) -> Column:
    size = lambda x: F.when(F.abs(x) < float("inf"), F.abs(x)).otherwise(0.0)
    return F.lit(EPS) * F.greatest(F.lit(1.0), size(a), size(b))


def c_eq(a: Column, b: Column) -> Column:
    return (a == b) | (F.abs(a - b) <= c_tol(a, b))


def c_lt(a: Column, b: Column) -> Column:
    return (a < b) & ~c_eq(a, b)


def c_leq(a: Column, b: Column) -> Column:
    return (a <= b) | c_eq(a, b)


#: Column names that stand for each role, in order of preference.
ALIASES = {
    "from": ("from", "source", "sender", "tail", "ego", "src", "i"),
    "to": ("to", "target", "receiver", "head", "alter", "dst", "j"),
    "start": ("start", "onset", "begin", "starttime", "startdate"),
    "end": ("end", "terminus", "stop", "finish", "endtime", "enddate"),
    "time": ("time", "timestamp", "date", "datetime", "when", "t"),
    "duration": ("duration", "length"),
    "weight": ("weight", "weights", "strength"),
    "session": ("session", "sessionid", "course"),
    "thread": ("thread", "discussion", "threadid", "conversation"),
    "actor": ("actor", "speaker", "user", "userid", "person", "student"),
    "group": ("group", "event", "meeting", "seminar", "groupid"),
}


def resolve(columns: list[str], role: str, named: str | None = None) -> str | None:
    """The column that plays a role: the named one, else the first alias present."""
    if named is not None:
        if named not in columns:
            raise BadInput(f"no column {named!r}")
        return named
    plain = {}
    for c in columns:
        plain.setdefault(re.sub("[^a-z0-9]", "", c.lower()), c)
    return next((plain[a] for a in ALIASES[role] if a in plain), None)


UNIT_SECONDS = {"seconds": 1.0, "minutes": 60.0, "hours": 3600.0, "days": 86400.0, "weeks": 604800.0}
FORMATS = ("yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd HH:mm", "yyyy/MM/dd HH:mm:ss", "yyyy/MM/dd HH:mm", "dd/MM/yyyy HH:mm:ss", "dd/MM/yyyy HH:mm", "MM/dd/yyyy HH:mm:ss", "dd.MM.yyyy HH:mm:ss", "dd-MM-yyyy HH:mm:ss", "yyyy-MM-dd", "yyyy/MM/dd", "dd/MM/yyyy", "MM/dd/yyyy", "dd.MM.yyyy", "dd-MM-yyyy", "yyyyMMdd", "HH:mm:ss", "HH:mm")


def micros(column: str) -> Column:
    """Microseconds of a time without zone, read as UTC whatever the session's zone."""
    c = F.col(column)
    clock = F.hour(c).cast("long") * 3_600_000_000 + F.minute(c).cast("long") * 60_000_000
    return F.unix_date(F.to_date(c)).cast("long") * 86_400_000_000 + clock + (F.extract(F.lit("SECOND"), c) * 1_000_000).cast("long")


def infer_unit(span_seconds: float) -> str:
    """A unit in which a span of this length reads well; never weeks."""
    for unit, below in (("seconds", 120.0), ("minutes", 3 * 3600.0), ("hours", 3 * 86400.0)):
        if span_seconds < below:
            return unit
    return "days"


def best_format(df: DataFrame, column: str) -> str:
    """The format that reads most values of a text column."""
    counts = df.agg(*[F.count(F.try_to_timestamp(column, F.lit(f))).alias(str(i)) for i, f in enumerate(FORMATS)]).first()
    best = max(range(len(FORMATS)), key=lambda i: (counts[i], -i))
    if not counts[best]:
        raise BadInput(f"no time format fits column {column!r}")
    return FORMATS[best]


def seconds(df: DataFrame, column: str) -> tuple[Column, bool]:
    """A column as doubles, and whether it is a calendar clock (then in seconds)."""
    kind = df.schema[column].dataType
    if isinstance(kind, T.NumericType):
        return F.col(column).cast("double"), False
    if isinstance(kind, T.DateType):
        return F.unix_date(column).cast("double") * 86400.0, True
    if isinstance(kind, T.StringType):
        stamp = F.try_to_timestamp(column, F.lit(best_format(df, column)))
    elif isinstance(kind, T.TimestampNTZType):
        return micros(column) / 1e6, True
    elif isinstance(kind, T.TimestampType):
        stamp = F.col(column)
    else:
        raise BadInput(f"column {column!r} of type {kind.simpleString()} is not a time")
    return F.unix_micros(stamp) / 1e6, True
