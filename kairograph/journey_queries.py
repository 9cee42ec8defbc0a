"""Queries on time-respecting ways between nations, with SQL that unrolls the rounds of the definition."""

from __future__ import annotations

from pyspark.sql import functions as F

from kairograph.operators import paths, summaries
from kairograph.registry import N2, nations, query

#: Rounds written out; the best ways of the tables have fewer hops, which a test confirms.
HOPS = 12


def _contacts(walls: str = "ses") -> str:
    """Maximal stretches of a pair in a session; their weight is that of the first spell."""
    return f""", o AS (SELECT {walls} AS ses, f, t, s, e, w, max(e) OVER (PARTITION BY {walls}, f, t ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pe FROM sp),
i AS (SELECT *, sum(CASE WHEN s <= pe THEN 0 ELSE 1 END) OVER (PARTITION BY ses, f, t ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS g FROM o),
a AS MATERIALIZED (SELECT ses, f, t, min(s) AS lo, max(e) AS hi, arg_min(w, (s, e, w)) AS w FROM i GROUP BY ses, f, t, g),
walls AS (SELECT DISTINCT ses FROM a)
"""


def _forward(begin: str = "SELECT n_name AS src, ses, n_name AS v, lo AS tm, 1.0::DOUBLE AS n FROM nation, walls, span", until: str = "true") -> str:
    """States by hops: ways that are no later than one with fewer hops are left out; counts add up over contacts."""
    out = f", x0 AS ({begin})"
    for k in range(1, HOPS + 1):
        known = " UNION ALL ".join(f"SELECT src, ses, v, tm FROM x{j}" for j in range(k))
        out += f""", b{k} AS (SELECT src, ses, v, min(tm) AS best FROM ({known}) GROUP BY ALL),
r{k} AS MATERIALIZED (SELECT x.src, x.ses, x.v AS u, x.tm AS tu, a.t AS v, greatest(x.tm, a.lo) AS tm, a.lo, a.hi, x.n
  FROM x{k - 1} x JOIN a ON a.ses = x.ses AND a.f = x.v AND greatest(x.tm, a.lo) < a.hi LEFT JOIN b{k} b ON b.src = x.src AND b.ses = x.ses AND b.v = a.t WHERE (best IS NULL OR greatest(x.tm, a.lo) < best) AND {until.format("greatest(x.tm, a.lo)", "x.src")}),
x{k} AS MATERIALIZED (SELECT src, ses, v, tm, sum(n) AS n FROM r{k} GROUP BY src, ses, v, tm)"""
    every = " UNION ALL ".join(f"SELECT {k} AS h, * FROM x{k}" for k in range(HOPS + 1))
    return out + f", st AS MATERIALIZED ({every})\n"


def _best(order: str = "tm, h") -> str:
    """The best states of each end, over all sessions, with how many ways they stand for."""
    return f""", bs AS MATERIALIZED (SELECT * FROM (SELECT *, rank() OVER (PARTITION BY src, v ORDER BY {order}) AS k, sum(n) OVER (PARTITION BY src, v, tm, h) AS ways FROM st WHERE src <> v) WHERE k = 1),
pt AS (SELECT src, v, any_value(tm) AS tm, any_value(h) AS h, any_value(ways) AS ways FROM bs GROUP BY ALL)
"""


def _shares() -> str:
    """Shares of ways carried back: what ends in a state, and what goes on from it."""
    out = ""
    for k in range(HOPS, 0, -1):
        onward = f"(SELECT src, ses, u AS v, tu AS tm, sum(total) AS inner_share FROM y{k + 1} GROUP BY ALL)" if k < HOPS else "(SELECT NULL::VARCHAR AS src, NULL::VARCHAR AS ses, NULL::VARCHAR AS v, NULL::DOUBLE AS tm, NULL::DOUBLE AS inner_share)"
        out += f""", z{k} AS MATERIALIZED (SELECT x.*, coalesce(inner_share, 0) AS goes_on, coalesce(inner_share, 0) + coalesce(1 / ways, 0) AS total FROM x{k} x LEFT JOIN {onward} q USING (src, ses, v, tm) LEFT JOIN bs ON bs.src = x.src AND bs.ses = x.ses AND bs.v = x.v AND bs.tm = x.tm AND bs.h = {k}),
y{k} AS MATERIALIZED (SELECT r.*, total, total * r.n AS share FROM r{k} r JOIN z{k} z USING (src, ses, v, tm))"""
    return out + "\n"


def _routes() -> str:
    """Ways written out from their ends to their beginnings."""
    out, last = "", None
    for k in range(HOPS, 0, -1):
        ends = f"SELECT src, ses, v AS goal, v, tm, [v] AS route, [tm] AS times FROM bs WHERE h = {k}"
        more = f" UNION ALL SELECT r.src, r.ses, goal, r.u, r.tu, list_prepend(r.u, route), list_prepend(r.tu, times) FROM q{k + 1} JOIN r{k + 1} r USING (src, ses, v, tm)" if last else ""
        out += f", q{k} AS ({ends}{more})"
        last = k
    return out + ", way AS MATERIALIZED (SELECT q1.src, goal AS v, list_prepend(r.u, route) AS route, list_prepend(r.tu, times) AS times FROM q1 JOIN r1 r USING (src, ses, v, tm))\n"


BASE = N2.rstrip() + _contacts() + _forward()
WAYS = BASE + _best()
ROUTES = WAYS + _routes()


@query(WAYS + "SELECT src AS source, v AS node, (SELECT lo FROM span) AS departure, tm AS arrival, tm - (SELECT lo FROM span) AS latency, h::BIGINT AS hops, ways AS n_paths, tm AS cost FROM pt UNION ALL SELECT n_name, n_name, lo, lo, 0, 0, 1, lo FROM nation, span")
def net_paths_sessions(spark, sf):
    return paths.paths(nations(spark, sf))


@query(BASE + _best("h, tm") + "SELECT src AS source, v AS node, tm AS arrival, h::BIGINT AS hops, ways AS n_paths FROM pt")
def net_paths_min_hops_counted(spark, sf):
    return paths.paths(nations(spark, sf), criterion="min_hops").filter("source <> node").select("source", "node", "arrival", "hops", "n_paths")


@query(WAYS + _shares() + """, cl AS (SELECT src AS node, 1 / avg(tm - lo) AS x FROM pt, span GROUP BY src), mh AS (SELECT src, v, min(h) AS h FROM st WHERE src <> v GROUP BY ALL), ef AS (SELECT src AS node, sum(1 / h) / 24 AS x FROM mh GROUP BY src),
bt AS (SELECT v AS node, sum(goes_on * n) AS x FROM ({}) GROUP BY v)
SELECT node, measure, round(value, 9) AS value FROM (SELECT n_name AS node, coalesce(cl.x, 0.0) AS closeness, coalesce(bt.x, 0.0) AS betweenness, coalesce(ef.x, 0.0) AS efficiency FROM nation LEFT JOIN cl ON cl.node = n_name LEFT JOIN bt ON bt.node = n_name LEFT JOIN ef ON ef.node = n_name) UNPIVOT (value FOR measure IN (closeness, betweenness, efficiency))""".format(" UNION ALL ".join(f"SELECT v, goes_on, n FROM z{k}" for k in range(1, HOPS + 1))))  # fmt: skip
def net_path_centrality(spark, sf):
    return paths.path_centrality(nations(spark, sf), ["closeness", "betweenness", "efficiency"]).withColumn("value", F.round("value", 9))


@query(WAYS + _shares() + """, us AS (SELECT u AS f, v AS t, lo, hi, sum(share) AS x FROM ({}) GROUP BY ALL)
SELECT f AS "from", t AS "to", lo AS start, hi AS "end", round(coalesce(x, 0), 9) AS value FROM (SELECT DISTINCT f, t, lo, hi FROM a) LEFT JOIN us USING (f, t, lo, hi)""".format(" UNION ALL ".join(f"SELECT u, v, lo, hi, share FROM y{k}" for k in range(1, HOPS + 1))))  # fmt: skip
def net_edge_centrality(spark, sf):
    return paths.edge_centrality(nations(spark, sf)).withColumn("value", F.round("value", 9))


@query(ROUTES + "SELECT src AS source, v AS node, array_to_string(route, '>') AS route, round(list_sum(times), 4) AS times FROM way")
def net_path_steps(spark, sf):
    s = paths.path_steps(nations(spark, sf))
    return s.select("source", "node", F.array_join("route", ">").alias("route"), F.round(F.aggregate("times", F.lit(0.0), lambda a, b: a + b), 4).alias("times"))


@query(ROUTES + """, q AS (SELECT array_to_string(route, ' -> ') AS route, len(route) - 1 AS h, times[-1] AS a FROM way)
SELECT route, any_value(h)::INTEGER AS n_hops, count(*) AS count, round(count(*) / (SELECT count(*) FROM q), 12) AS share, min(a) AS arrival FROM q GROUP BY route""")
def net_pathways(spark, sf):
    return paths.pathways(paths.path_steps(nations(spark, sf))).withColumn("share", F.round("share", 12))


PATH_EDGES = ROUTES + """, pe AS (SELECT f, t, count(*) AS w, min(tm) AS first, max(tm) AS last, count(DISTINCT v) AS ends FROM (SELECT v, route[k] AS f, route[k + 1] AS t, times[k + 1] AS tm FROM (SELECT *, unnest(range(1, len(route))) AS k FROM way)) GROUP BY ALL)
"""


@query(PATH_EDGES + """SELECT f AS "from", t AS "to", w AS weight, first, last, ends AS n_endpoints FROM pe""")
def net_path_network(spark, sf):
    return paths.path_network(paths.path_steps(nations(spark, sf)))


@query(PATH_EDGES + """SELECT v AS node, sum(o)::BIGINT AS out_weight, sum(i)::BIGINT AS in_weight, min(t) AS first FROM (SELECT f AS v, w AS o, 0 AS i, NULL AS t FROM pe UNION ALL SELECT t, 0, w, first FROM pe) GROUP BY v""")
def net_path_network_nodes(spark, sf):
    return summaries.path_network_nodes(paths.path_network(paths.path_steps(nations(spark, sf))))


@query(PATH_EDGES + """SELECT u.property, u.value FROM (SELECT count(*)::DOUBLE AS edges, sum(w)::DOUBLE AS traversals, max(w)::DOUBLE AS heaviest, min(first) AS first, max(last) AS last, (SELECT count(*)::DOUBLE FROM (SELECT f FROM pe UNION SELECT t FROM pe)) AS nodes FROM pe) UNPIVOT (value FOR property IN (edges, traversals, heaviest, first, last, nodes)) u""")
def net_path_network_summary(spark, sf):
    return summaries.path_network_summary(paths.path_network(paths.path_steps(nations(spark, sf))))


@query(WAYS + """SELECT n_name AS source, count(pt.v) AS reachable, count(pt.v) / 24 AS share, median(tm - lo) AS median_latency, max(tm - lo) AS max_latency, median(h)::DOUBLE AS median_hops, max(h)::DOUBLE AS max_hops FROM nation LEFT JOIN pt ON src = n_name, span GROUP BY n_name""")
def net_paths_summary(spark, sf):
    net = nations(spark, sf)
    return summaries.paths_summary(paths.paths(net), net.nodes).withColumn("max_hops", F.col("max_hops").cast("double"))


@query(ROUTES + """, q AS (SELECT v, array_to_string(route, ' -> ') AS route, len(route) - 1 AS h, times[-1] AS a FROM way) SELECT v AS node, count(DISTINCT route) AS routes, count(*) AS count, round(count(*) / (SELECT count(*) FROM q), 12) AS share, min(h)::INTEGER AS min_hops, min(a) AS first_arrival FROM q GROUP BY v""")
def net_pathway_endpoints(spark, sf):
    return summaries.pathway_endpoints(paths.path_steps(nations(spark, sf))).withColumn("share", F.round("share", 12))


TREE = ROUTES + """, k AS (SELECT list_transform(range(1, len(route) + 1), lambda i: route[i] || '@' || times[i]) AS k FROM way), pf AS (SELECT k[1:d] AS p, d FROM (SELECT k, unnest(range(1, len(k) + 1)) AS d FROM k)), tr AS (SELECT array_to_string(p, '>') AS prefix, CASE WHEN d > 1 THEN array_to_string(p[1:d - 1], '>') END AS parent, p[d] AS node, d::INTEGER AS depth, count(*) AS count FROM pf GROUP BY ALL)
"""


@query(TREE + "SELECT x.*, round(x.count / y.count, 12) AS probability FROM tr x LEFT JOIN tr y ON x.parent = y.prefix")
def net_path_trajectories(spark, sf):
    return paths.path_trajectories(paths.path_steps(nations(spark, sf))).withColumn("probability", F.round("probability", 12))


@query(TREE + """SELECT depth, count(*) AS branches, count(DISTINCT split_part(node, '@', 1)) AS vertices, sum(count)::BIGINT AS count, round(avg(kids), 9) AS mean_branching FROM tr LEFT JOIN (SELECT parent AS prefix, count(*) AS kids FROM tr WHERE parent IS NOT NULL GROUP BY parent) USING (prefix) GROUP BY depth""")
def net_trajectory_depths(spark, sf):
    return summaries.trajectory_depths(paths.path_trajectories(paths.path_steps(nations(spark, sf)))).withColumn("mean_branching", F.round("mean_branching", 9))


WINDOWS = N2.rstrip() + _contacts() + ", win AS (SELECT lo + 360 * k AS lo, lo + 360 * (k + 1) AS hi FROM (SELECT lo, unnest(range(0, CAST(ceil((hi - lo) / 360) AS INT))) AS k FROM span))" + _forward("SELECT (n_name, win.lo, win.hi) AS src, ses, n_name AS v, win.lo AS tm, 1.0::DOUBLE AS n FROM nation, walls, win", "{} <= struct_extract({}, 3)") + ", d AS (SELECT struct_extract(src, 2) AS lo, struct_extract(src, 1) AS src, v, min((tm, h)) AS m FROM st WHERE struct_extract(src, 1) <> v GROUP BY ALL)\n"


@query(WINDOWS + "SELECT lo AS time, src AS source, v AS node, struct_extract(m, 2)::DOUBLE AS distance FROM d")
def net_temporal_distances(spark, sf):
    return paths.temporal_distances(nations(spark, sf), step=360.0)


@query(WINDOWS + "SELECT win.lo AS time, round(coalesce(sum(CASE WHEN struct_extract(m, 1) > win.lo THEN 1 / (struct_extract(m, 1) - win.lo) ELSE 'inf'::DOUBLE END) FILTER (m IS NOT NULL), 0) / 600, 9) AS temporal_efficiency, max(struct_extract(m, 1) - win.lo) AS temporal_diameter, count(m) = 600 AS connected FROM win LEFT JOIN d ON d.lo = win.lo GROUP BY win.lo")
def net_window_efficiency(spark, sf):
    return paths.window_efficiency(nations(spark, sf), basis="latency", step=360.0).withColumn("temporal_efficiency", F.round("temporal_efficiency", 9))


def _cheapest() -> str:
    """Labels of time and cost by hops; one that is dearer than another that is there no later is left out."""
    out = ", x0 AS (SELECT n_name AS src, n_name AS v, lo AS tm, 0.0::DOUBLE AS c, 1.0::DOUBLE AS n FROM nation, span)"
    for k in range(1, HOPS + 1):
        known = " UNION ALL ".join(f"SELECT src, v, tm, c, n, 0 AS fresh FROM x{j}" for j in range(k))
        out += f""", m{k} AS (SELECT x.src, a.t AS v, greatest(x.tm, a.lo) AS tm, x.c + a.w AS c, x.n, 1 AS fresh FROM x{k - 1} x JOIN a ON a.f = x.v AND greatest(x.tm, a.lo) < a.hi),
x{k} AS MATERIALIZED (SELECT src, v, tm, min(c) AS c, sum(n) AS n FROM (SELECT *, min(c) OVER (PARTITION BY src, v ORDER BY tm RANGE UNBOUNDED PRECEDING) AS low FROM (SELECT * FROM m{k} UNION ALL {known})) WHERE fresh = 1 AND c = low GROUP BY src, v, tm)"""
    every = " UNION ALL ".join(f"SELECT {k} AS h, * FROM x{k}" for k in range(HOPS + 1))
    return out + f""", st AS ({every}), lw AS (SELECT *, min(c) OVER (PARTITION BY src, v) AS low FROM st), ft AS (SELECT *, min(tm) OVER (PARTITION BY src, v) AS ftm FROM lw WHERE c = low)
"""


@query(N2.rstrip() + _contacts("''") + _cheapest() + """SELECT src AS source, v AS node, min((SELECT lo FROM span)) AS departure, min(tm) AS arrival, min(tm - (SELECT lo FROM span)) AS latency, CASE WHEN min(h) = max(h) THEN min(h)::BIGINT END AS hops, sum(n) AS n_paths, min(c) AS cost FROM ft WHERE tm = ftm GROUP BY src, v""")
def net_paths_shortest(spark, sf):
    return paths.paths(nations(spark, sf), criterion="shortest", sessions="collapse")


def _backward() -> str:
    """Latest departures by hops: (time, whether it is attained), of which the greater is better."""
    out = ", x0 AS (SELECT n_name AS src, ses, n_name AS v, hi AS tm, 1 AS ex, 1.0::DOUBLE AS n FROM nation, walls, span)"
    for k in range(1, HOPS + 1):
        known = " UNION ALL ".join(f"SELECT src, ses, v, tm, ex FROM x{j}" for j in range(k))
        out += f""", b{k} AS (SELECT src, ses, v, max((tm, ex)) AS best FROM ({known}) GROUP BY ALL),
r{k} AS (SELECT x.src, x.ses, a.f AS v, least(a.hi, x.tm) AS tm, CASE WHEN x.tm < a.hi AND x.ex = 1 THEN 1 ELSE 0 END AS ex, x.n, a.lo FROM x{k - 1} x JOIN a ON a.ses = x.ses AND a.t = x.v AND (a.lo < x.tm OR a.lo = x.tm AND x.ex = 1)),
x{k} AS MATERIALIZED (SELECT r.src, r.ses, r.v, tm, ex, sum(n) AS n FROM r{k} r LEFT JOIN b{k} b USING (src, ses, v) WHERE best IS NULL OR (tm, ex) > best GROUP BY ALL)"""
    every = " UNION ALL ".join(f"SELECT {k} AS h, * FROM x{k}" for k in range(HOPS + 1))
    return out + f", st AS ({every}), bs AS (SELECT *, rank() OVER (PARTITION BY src, v ORDER BY tm DESC, ex DESC, h) AS k FROM st)\n"


BACK = N2.rstrip() + _contacts() + _backward()


@query(BACK + "SELECT src AS target, v AS node, any_value(tm) AS departure, any_value(ex) = 1 AS attained, any_value(h)::BIGINT AS hops, CASE WHEN src = v THEN 1 ELSE sum(n) END AS n_paths FROM bs WHERE k = 1 GROUP BY src, v")
def net_backward_paths(spark, sf):
    return paths.backward_paths(nations(spark, sf))


@query(BACK.replace(", bs AS (SELECT *, rank()", ", bs AS MATERIALIZED (SELECT *, rank()") + "SELECT v AS source, src AS node, any_value(tm) AS departure FROM bs WHERE k = 1 GROUP BY src, v")
def net_paths_latest_departure(spark, sf):
    return paths.paths(nations(spark, sf), criterion="latest_departure").select("source", "node", "departure")


@query()
def net_paths_fastest(spark, sf):
    return paths.paths(nations(spark, sf), criterion="fastest", sessions="collapse")
