"""Unions of intervals by running maxima: no pairs of intervals are formed."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kairograph.functions.timeops import c_leq


def islands(df: DataFrame, keys: list[str], tolerant: bool = False, first: list[str] | None = None) -> DataFrame:
    """``keys, start, end`` of the maximal stretches that the intervals of a key cover.

    Intervals that touch are joined; with ``tolerant`` also those that touch up to
    rounding.  Columns named ``first`` come from a stretch's first interval.
    """
    w = Window.partitionBy(*keys).orderBy("start", "end")
    before = F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    joins = c_leq(F.col("start"), before) if tolerant else F.col("start") <= before
    marked = df.withColumn("_fresh", F.when(joins, 0).otherwise(1)).withColumn("_k", F.sum("_fresh").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return marked.groupBy(*keys, "_k").agg(F.min("start").alias("start"), F.max("end").alias("end"), *(F.min_by(c, F.struct("start", "end", c)).alias(c) for c in first or [])).drop("_k")


def union_length(df: DataFrame, keys: list[str], name: str = "union") -> DataFrame:
    """The length of the union of each key's intervals."""
    return islands(df, keys).groupBy(*keys).agg(F.sum(F.col("end") - F.col("start")).alias(name))
