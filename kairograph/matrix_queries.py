"""Queries on measures of whole snapshots, with SQL that keeps a window's matrix as a list of rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from kairograph.operators import centrality
from kairograph.registry import N2, nations, query

STEP = 720.0
#: Multiplications after which the leading vector of these windows has settled.
TURNS = 40

MATRICES = N2.replace("180", "720").replace("WITH", "WITH RECURSIVE", 1).rstrip() + """, nv AS (SELECT n_name AS v, row_number() OVER (ORDER BY n_name) AS i FROM nation),
mt AS MATERIALIZED (SELECT k, lo, list(r ORDER BY i) AS a FROM (SELECT b.k, b.lo, p.i, list(CASE WHEN e.f IS NULL THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END ORDER BY q.i) AS r FROM bins b CROSS JOIN nv p CROSS JOIN nv q LEFT JOIN edge e ON e.k = b.k AND e.f = p.v AND e.t = q.v GROUP BY b.k, b.lo, p.i) GROUP BY k, lo)
"""
_SCALE_ROWS = "list_transform({a}, lambda r: list_transform(r, lambda x: CASE WHEN list_sum(r) > 0 THEN x / list_sum(r) ELSE 0 END))"
_TURN = "list_transform(range(1, len({a}) + 1), lambda j: list_transform({a}, lambda r: r[j]))"


def _rows(a: str) -> str:
    return _SCALE_ROWS.format(a=a)


def _turn(a: str) -> str:
    return _TURN.format(a=a)


def _times(a: str, b: str) -> str:
    """The product of a matrix and the transpose of another."""
    return f"list_transform({a}, lambda p: list_transform({b}, lambda q: list_inner_product(p, q)))"


#: Rows and columns scaled in turn until both sum to one.
BALANCED = f""", bl AS (SELECT k, 0 AS n, a FROM mt UNION ALL SELECT k, n + 1, {_turn(_rows(_turn(_rows("a"))))} FROM bl WHERE n < 60), bd AS MATERIALIZED (SELECT k, a AS d FROM bl WHERE n = 60)
"""
#: Leading vectors by repeated multiplication; ``w`` is the matrix that multiplies a column.
LEADING = f""", ws AS (SELECT 'eigenvector' AS m, k, {_turn("a")} AS w FROM mt UNION ALL SELECT 'hub', k, {_times("a", "a")} FROM mt UNION ALL SELECT 'authority', k, {_times(_turn("a"), _turn("a"))} FROM mt
  UNION ALL SELECT 'prestige:eigenvector', k, {_turn("a")} FROM mt UNION ALL SELECT 'prestige:eigenvector.rownorm', k, {_turn(_rows("a"))} FROM mt UNION ALL SELECT 'prestige:eigenvector.colnorm', k, {_rows(_turn("a"))} FROM mt UNION ALL SELECT 'prestige:eigenvector.rowcolnorm', k, {_turn("d")} FROM bd),
ld AS (SELECT m, k, 0 AS n, w, list_transform(w, lambda r: 1.0::DOUBLE) AS x FROM ws UNION ALL SELECT m, k, n + 1, w, list_transform(y, lambda v: v / list_max(y)) FROM (SELECT m, k, n, w, list_transform(w, lambda r: list_inner_product(r, x)) AS y FROM ld WHERE n < {TURNS})),
lv AS (SELECT m, k, CASE WHEN m LIKE 'prestige%' THEN list_transform(x, lambda v: v / sqrt(list_inner_product(x, x))) ELSE x END AS x FROM ld WHERE n = {TURNS})
"""
#: Fewest steps between vertices, by rounds.
STEPS = """, d0 AS (SELECT k, p.i AS s, p.i AS t, 0 AS d FROM bins, nv p), ar AS (SELECT e.k, p.i AS f, q.i AS t FROM edge e JOIN nv p ON p.v = e.f JOIN nv q ON q.v = e.t),
ds AS (SELECT * FROM d0 UNION SELECT ds.k, s, ar.t, d + 1 FROM ds JOIN ar ON ar.k = ds.k AND ar.f = ds.t WHERE d < 6), dist AS MATERIALIZED (SELECT k, s, t, min(d) AS d FROM ds GROUP BY k, s, t)
"""


def _values(names: list[str]):
    def run(spark, sf):
        return centrality.centrality_series(nations(spark, sf), names, step=STEP).withColumn("value", F.round("value", 7))

    return run


@query(MATRICES + BALANCED + LEADING + "SELECT lo AS time, v AS node, m AS measure, round(x[i], 7) AS value FROM lv JOIN bins USING (k) CROSS JOIN nv WHERE m NOT LIKE 'prestige%'")
def net_spectra(spark, sf):
    return _values(["eigenvector", "hub", "authority"])(spark, sf)


@query(MATRICES + BALANCED + LEADING + STEPS + f""", rn AS (SELECT k, {_turn(_rows("a"))} AS c, {_turn("a")} AS t FROM mt),
dm AS (SELECT k, t AS i, count(*) AS reach, sum(d) AS total FROM dist WHERE s <> t GROUP BY k, t),
pv AS (SELECT k, 'prestige:indegree' AS m, list_transform(t, lambda r: list_sum(r)) AS x FROM rn UNION ALL SELECT k, 'prestige:indegree.rownorm', list_transform(c, lambda r: list_sum(r)) FROM rn
  UNION ALL SELECT k, 'prestige:indegree.rowcolnorm', list_transform({_turn("d")}, lambda r: list_sum(r)) FROM bd UNION ALL SELECT k, m, x FROM lv WHERE m LIKE 'prestige%'),
dv AS (SELECT k, 'prestige:domain' AS m, i, coalesce(reach, 0)::DOUBLE AS x FROM bins CROSS JOIN nv LEFT JOIN dm USING (k, i) UNION ALL SELECT k, 'prestige:domain.proximity', i, coalesce(reach * reach / (24 * total), 0) FROM bins CROSS JOIN nv LEFT JOIN dm USING (k, i))
SELECT lo AS time, v AS node, m AS measure, round(x, 7) AS value FROM (SELECT k, m, i, x[i] AS x FROM pv CROSS JOIN nv UNION ALL SELECT k, m, i, x FROM dv) JOIN bins USING (k) JOIN nv USING (i)""")
def net_prestige(spark, sf):
    return _values([f"prestige:{k}" for k in centrality.PRESTIGE])(spark, sf)


#: Gauss and Jordan: each turn clears a column of [M | I]; M is 1 off the ties, and 1 plus the degree on the diagonal.
INVERSE = f""", sy AS (SELECT k, list_transform(range(1, len(a) + 1), lambda i: list_transform(range(1, len(a) + 1), lambda j: greatest(a[i][j], a[j][i]))) AS s FROM mt),
gm AS (SELECT k, list_transform(range(1, len(s) + 1), lambda i: list_concat(list_transform(range(1, len(s) + 1), lambda j: CASE WHEN i = j THEN 1.0::DOUBLE + list_sum(s[i]) ELSE 1.0::DOUBLE - s[i][j] END), list_transform(range(1, len(s) + 1), lambda j: CASE WHEN i = j THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END))) AS g FROM sy),
gj AS (SELECT k, 0 AS n, g FROM gm UNION ALL SELECT k, n + 1, list_transform(range(1, len(g) + 1), lambda i: CASE WHEN i = n + 1 THEN list_transform(g[i], lambda x: x / g[i][i]) ELSE list_transform(range(1, len(g[i]) + 1), lambda j: g[i][j] - g[i][n + 1] * g[n + 1][j] / g[n + 1][n + 1]) END) FROM gj WHERE n < len(g)),
iv AS (SELECT k, list_transform(g, lambda r: r[len(r) // 2 + 1:]) AS c FROM gj WHERE n = len(g))
"""


@query(MATRICES + INVERSE + """, tr AS (SELECT k, c, list_sum(list_transform(range(1, len(c) + 1), lambda i: c[i][i])) AS tr FROM iv)
SELECT lo AS time, v AS node, 'information' AS measure, round(1 / (c[i][i] + (tr - 2 * list_sum(c[i])) / len(c)), 7) AS value FROM tr JOIN bins USING (k) CROSS JOIN nv""")
def net_information(spark, sf):
    return _values(["information"])(spark, sf)


def _load() -> str:
    """One packet from everyone to each vertex, split among the ways that are nearer by one; the farthest go first."""
    out = ", fx AS (SELECT x.k, x.t AS goal, x.s AS v, ar.t AS w, x.d FROM dist x JOIN ar ON ar.k = x.k AND ar.f = x.s JOIN dist y ON y.k = x.k AND y.t = x.t AND y.s = ar.t AND y.d = x.d - 1 WHERE x.d > 0), fs AS MATERIALIZED (SELECT *, 1 / count(*) OVER (PARTITION BY k, goal, v) AS p FROM fx)"
    for d in range(6, 0, -1):
        more = f" UNION ALL SELECT k, goal, w, x * p FROM l{d + 1} JOIN fs USING (k, goal, v)" if d < 6 else ""
        out += f", l{d} AS (SELECT k, goal, v, sum(x) AS x FROM (SELECT k, t AS goal, s AS v, 1.0::DOUBLE AS x FROM dist WHERE d = {d}{more}) WHERE v <> goal GROUP BY k, goal, v)"
        # What is passed on reaches vertices one step nearer.
    every = " UNION ALL ".join(f"SELECT l.k, l.goal, l.v, l.x - 1 AS x FROM l{d} l JOIN dist ON dist.k = l.k AND dist.s = l.v AND dist.t = l.goal AND dist.d = {d}" for d in range(1, 7))
    return out + f", rl AS (SELECT k, v AS i, sum(x) AS x FROM ({every}) GROUP BY k, v)\n"


@query(MATRICES + STEPS + _load() + "SELECT lo AS time, v AS node, 'load' AS measure, round(coalesce(x, 0), 7) AS value FROM bins CROSS JOIN nv LEFT JOIN rl USING (k, i)")
def net_load(spark, sf):
    return _values(["load"])(spark, sf)
