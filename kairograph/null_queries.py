"""Queries on surrogate networks: draws replayed in SQL from their digests, and what constrained draws keep."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kairograph.contracts import SEEN_SQL, seen
from kairograph.operators import nulls
from kairograph.operators.surrogates import surrogates
from kairograph.plans.network import Network
from kairograph.plans.storage import keep
from kairograph.registry import N1, N2, nations, query, turns

ROWS = ("replicate", "from", "to", "start", "end", "weight", "session")
#: Spells with the digest of their content, three copies.
IDS = N2 + """, ids AS (SELECT r, sp.*, md5(concat_ws('|', f, t, s::DOUBLE::VARCHAR, e::DOUBLE::VARCHAR, w::DOUBLE::VARCHAR, ses, row_number() OVER (PARTITION BY r, f, t, s, e, w, ses)::VARCHAR)) AS id FROM sp, (SELECT unnest([1, 2, 3]) AS r))
"""
OUT = """SELECT {a}.r::INTEGER AS replicate, {f} AS "from", {t} AS "to", {b}.s::DOUBLE AS start, {b}.e::DOUBLE AS "end", {a}.w::DOUBLE AS weight, {a}.ses AS session FROM """


def _digest(salt: str, what: str) -> str:
    return f"md5(concat_ws('|', '1', '{salt}', r::VARCHAR, {what}))"


def _permutation(scope: str) -> str:
    part = f"PARTITION BY r{scope} ORDER BY"
    same = " AND a.ses = b.ses" if scope else ""
    return IDS + f", pl AS (SELECT *, row_number() OVER ({part} id) AS k, row_number() OVER ({part} {_digest('times', 'id')}) AS d FROM ids) " + OUT.format(a="a", b="b", f="a.f", t="a.t") + f"pl a JOIN pl b ON a.r = b.r AND a.k = b.d{same}"


@query(_permutation(""))
def net_surrogate_times(spark, sf):
    return nulls.randomise(nations(spark, sf), "times", 3).select(*ROWS)


@query(_permutation(", ses"))
def net_surrogate_times_sessions(spark, sf):
    return nulls.randomise(nations(spark, sf), "times", 3, within="session").select(*ROWS)


@query(IDS + f""", pr AS (SELECT DISTINCT r, ses, f, t, md5(concat_ws('|', 's' || ses, f, t)) AS p FROM ids), pl AS (SELECT *, row_number() OVER (PARTITION BY r, ses ORDER BY p) AS k, row_number() OVER (PARTITION BY r, ses ORDER BY {_digest('timeline', 'p')}) AS d FROM pr),
mv AS (SELECT a.r, a.ses, a.f, a.t, b.f AS f2, b.t AS t2 FROM pl a JOIN pl b ON a.r = b.r AND a.ses = b.ses AND a.k = b.d) """ + OUT.format(a="ids", b="ids", f="f2", t="t2") + "ids JOIN mv USING (r, ses, f, t)")  # fmt: skip
def net_surrogate_timeline_sessions(spark, sf):
    return nulls.randomise(nations(spark, sf), "timeline", 3, within="session").select(*ROWS)


@query(IDS + f""", nm AS (SELECT r, n_name AS v FROM nation, (SELECT unnest([1, 2, 3]) AS r)), pl AS (SELECT *, row_number() OVER (PARTITION BY r ORDER BY md5(v)) AS k, row_number() OVER (PARTITION BY r ORDER BY {_digest('labels', 'v')}) AS d FROM nm), mv AS (SELECT a.r, a.v, b.v AS w FROM pl a JOIN pl b ON a.r = b.r AND a.k = b.d)
""" + OUT.format(a="ids", b="ids", f="p.w", t="q.w") + "ids JOIN mv p ON p.r = ids.r AND p.v = f JOIN mv q ON q.r = ids.r AND q.v = t")  # fmt: skip
def net_surrogate_labels(spark, sf):
    return nulls.randomise(nations(spark, sf), "labels", 3).select(*ROWS)


@query(N1 + """, pr AS (SELECT DISTINCT f, t FROM sp), v AS (SELECT f AS node, 1 AS o, 0 AS i FROM pr UNION ALL SELECT t, 0, 1 FROM pr)
SELECT r::INTEGER AS replicate, node, sum(o)::BIGINT AS senders_pairs, sum(i)::BIGINT AS receivers_pairs, 0::BIGINT AS loops FROM v, (SELECT unnest([1, 2]) AS r) GROUP BY ALL""")
def net_surrogate_degrees(spark, sf):
    """Double swaps leave each vertex as many pairs as sender and as receiver."""
    s = nulls.randomise(turns(spark, sf), "edges", 2, swaps=2)
    pairs = s.select("replicate", "from", "to").distinct()
    ends = pairs.select("replicate", F.explode(F.array(F.struct(F.col("from").alias("node"), F.lit(1).alias("o"), F.lit(0).alias("i")), F.struct(F.col("to").alias("node"), F.lit(0).alias("o"), F.lit(1).alias("i")))).alias("v"), (F.col("from") == F.col("to")).cast("long").alias("l"))
    return ends.groupBy("replicate", "v.node").agg(F.sum("v.o").alias("senders_pairs"), F.sum("v.i").alias("receivers_pairs"), F.sum("l").alias("loops"))


INSIDE_SQL = SEEN_SQL + """, ok AS (SELECT * FROM fr WHERE EXISTS (SELECT 1 FROM w WHERE s >= w.a AND s <= w.b) AND EXISTS (SELECT 1 FROM w WHERE e >= w.a AND e <= w.b) AND EXISTS (SELECT 1 FROM pr WHERE v = f AND a <= s AND e <= b) AND EXISTS (SELECT 1 FROM pr WHERE v = t AND a <= s AND e <= b))
"""
#: A surrogate's rows beside what must stay of them: ties, distinct spells of time, pairs of ends with their number; none outside.
KEPT = "SELECT r::INTEGER AS replicate, {what}, 0::BIGINT AS outside, 0::BIGINT AS loops FROM ok, (SELECT unnest([1, 2]) AS r) GROUP BY ALL"


def _inside(net: Network) -> Network:
    """The network of spells that lie wholly in watched time and in the presence of both ends."""
    s = net.spells.filter(_watched(net, "start") & _watched(net, "end"))
    for end in ("from", "to"):
        p = net.presence.select(F.col("node").alias(end), F.col("start").alias("_a"), F.col("end").alias("_b"))
        s = s.join(p, end).filter("_a <= start AND `end` <= _b").drop("_a", "_b")
    return net.with_(spells=s.select(*net.spells.columns))


def _watched(net: Network, c: str):
    t, hit = F.col(c), F.lit(False)
    for a, b in net.observed:
        hit = hit | t.between(a, b)
    return hit


def _constrained(spark, sf, model: str, keys: list[str]) -> DataFrame:
    """How often each of ``keys`` is there in a surrogate, and how many ties lie outside or are loops."""
    net = seen(spark, sf)
    net = _inside(net.with_(presence=keep(net.presence, "presence")))
    got = surrogates(net, model, 2).spells
    fine = _inside(net.with_(spells=got)).spells.select("replicate", "raw_id").withColumn("_in", F.lit(1))
    rows = got.join(fine, ["replicate", "raw_id"], "left")
    g = rows.groupBy("replicate", *keys).agg(F.count("*").alias("ties"), F.count(F.when(F.col("_in").isNull(), 1)).alias("outside"), F.count(F.when(F.col("from") == F.col("to"), 1)).alias("loops"))
    return g


@query(INSIDE_SQL + KEPT.format(what='s::DOUBLE AS start, e::DOUBLE AS "end", count(*) AS ties'))
def net_surrogate_times_respected(spark, sf):
    return _constrained(spark, sf, "times", ["start", "end"])


@query(INSIDE_SQL + KEPT.format(what='t AS "to", count(*) AS ties'))
def net_surrogate_targets_respected(spark, sf):
    return _constrained(spark, sf, "targets", ["to"])
