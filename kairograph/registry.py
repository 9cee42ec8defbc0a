"""Queries over the test-data tables for the network operators, with equivalent SQL.

Networks: N1 turns of users by event type, N2 orders between nations as
intervals, N3 customers and suppliers as contacts, N4 suppliers of one order as
copresence, N5 turns of roles in conversations.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kairograph.functions.timeops import micros
from kairograph.operators import centrality, communities, crossbin, dynamics, edit, nulls, paths, results, sequences, snapshots
from kairograph.plans.network import Network
from kairograph.plans.storage import keep, spread
from kairograph.sources import builders

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
STEP = 180.0


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _t(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _days(c: str):
    return micros(c) / 86400e6


def nations(spark: SparkSession, sf: str) -> Network:
    """N2."""
    o = _t(spark, sf, "orders").select("o_orderkey", "o_custkey", _days("o_orderdate").alias("start"), "o_orderpriority")
    nation = _t(spark, sf, "nation").select("n_nationkey", "n_name", "n_regionkey")
    c = _t(spark, sf, "customer").join(F.broadcast(nation), F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", F.col("n_name").alias("from"))
    s = _t(spark, sf, "supplier").join(F.broadcast(nation), F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", F.col("n_name").alias("to"))
    li = _t(spark, sf, "lineitem").select("l_orderkey", "l_suppkey", "l_quantity")
    # Orders and customers are merged at any size: what a join costs grows as the tables, and none of their rows goes through the driver.
    o = o.join(c.hint("merge"), F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "start", "o_orderpriority", "from")
    rows = li.join(o.hint("merge"), F.col("l_orderkey") == F.col("o_orderkey")).join(s, F.col("l_suppkey") == F.col("s_suppkey"))
    rows = rows.select("from", "to", "start", (F.col("start") + F.col("l_quantity")).alias("end"), F.col("l_quantity").alias("weight"), F.col("o_orderpriority").alias("session"))
    rows = keep(rows, "nations")  # joined once: every step of a query reads this table
    nodes = nation.select(F.col("n_name").alias("name"), F.col("n_regionkey").alias("region"))
    return builders.from_tables(rows, nodes=nodes, check=False, interval=STEP, unit="days")


def turns(spark: SparkSession, sf: str) -> Network:
    """N1."""
    ev = _t(spark, sf, "events").select(F.col("user_id").cast("string").alias("actor"), F.col("event_type").alias("group"), _days("ts").alias("time"), "event_id")
    return builders.turns_network(ev, order=["event_id"], check=False, interval=1.0)


N2 = """
WITH sp AS (
  SELECT a.n_name AS f, b.n_name AS t, epoch_us(o_orderdate) / 86400e6 AS s, epoch_us(o_orderdate) / 86400e6 + l_quantity AS e, l_quantity AS w, o_orderpriority AS ses
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey
  JOIN nation a ON c_nationkey = a.n_nationkey JOIN nation b ON s_nationkey = b.n_nationkey WHERE a.n_name <> b.n_name),
span AS (SELECT min(s) AS lo, max(e) AS hi FROM sp),
bins AS (SELECT k, lo + 180 * k AS lo, lo + 180 * (k + 1) AS hi, k = n - 1 AS closed FROM (SELECT lo, CAST(ceil((hi - lo) / 180) AS INT) AS n, unnest(range(0, CAST(ceil((hi - lo) / 180) AS INT))) AS k FROM span)),
act AS (SELECT k, lo, hi, sp.* FROM sp JOIN bins ON CASE WHEN s = e THEN lo <= s AND (s < hi OR closed AND s <= hi) ELSE s < hi AND e > lo END),
edge AS (SELECT k, lo AS time, f, t, sum(w) AS weight, count(*) AS n_spells FROM act GROUP BY ALL),
n AS (SELECT count(*) AS n FROM nation)
"""

N1 = """
WITH tr AS (
  SELECT event_type AS ses, lag(CAST(user_id AS VARCHAR)) OVER (PARTITION BY event_type ORDER BY ts, event_id) AS f, CAST(user_id AS VARCHAR) AS t, epoch_us(ts) / 86400e6 AS s
  FROM events),
sp AS (SELECT * FROM tr WHERE f IS NOT NULL AND f <> t)
"""


@query(N2 + "SELECT time, f AS \"from\", t AS \"to\", weight, n_spells FROM edge")
def net_snapshots(spark, sf):
    return snapshots.snapshots(nations(spark, sf))


@query(N2 + """, en AS (SELECT k, f AS v FROM edge UNION SELECT k, t FROM edge)
SELECT bins.lo AS time, coalesce(ties, 0) AS ties, coalesce(nodes, 0) AS nodes, coalesce(weight, 0.0) AS weight
FROM bins LEFT JOIN (SELECT k, count(*) AS ties, sum(weight) AS weight FROM edge GROUP BY k) USING (k) LEFT JOIN (SELECT k, count(*) AS nodes FROM en GROUP BY k) USING (k)""")  # fmt: skip
def net_snapshot_summary(spark, sf):
    return snapshots.snapshot_summary(nations(spark, sf))


DEG = """, dg AS (SELECT k, v, sum(o) AS o, sum(i) AS i, sum(o) + sum(i) AS d FROM (SELECT k, f AS v, 1 AS o, 0 AS i FROM edge UNION ALL SELECT k, t, 0, 1 FROM edge) GROUP BY ALL),
m AS (SELECT k, count(*) AS m FROM edge GROUP BY k),
rec AS (SELECT a.k, count(*) AS rec FROM edge a JOIN edge b ON a.k = b.k AND a.f = b.t AND a.t = b.f GROUP BY a.k),
ds AS (SELECT k, count(*) AS act, sum(d) AS d1, sum(d * d) AS d2, max(d) AS dmax, sum(i * (i - 1) / 2) AS i2, sum(o * (o - 1) / 2) AS o2, sum(i * o) AS io, sum(pow(i, 1.5)) AS i15, sum(pow(o, 1.5)) AS o15 FROM dg GROUP BY k)
"""


@query(N2 + DEG + """SELECT lo AS time, u.measure, round(u.value, 9) AS value FROM (
  SELECT lo, m / (n * (n - 1)) AS density, CAST(m AS DOUBLE) AS edges, CAST(act AS DOUBLE) AS active_nodes, CAST(n - act AS DOUBLE) AS isolates, coalesce(rec, 0) / m AS reciprocity,
    coalesce(rec, 0) / 2 AS mutual, m - coalesce(rec, 0.0) AS "asymmetric", n * (n - 1) / 2 - coalesce(rec, 0) / 2 - (m - coalesce(rec, 0)) AS "null",
    d1 / n AS degree_mean, (d2 - d1 * d1 / n) / (n - 1) AS degree_variance, CAST(dmax AS DOUBLE) AS degree_max, m / n AS mean_degree, i15 AS indegree_1_5, o15 AS outdegree_1_5,
    CAST(i2 AS DOUBLE) AS in_2stars, CAST(o2 AS DOUBLE) AS out_2stars, CAST(io - coalesce(rec, 0) AS DOUBLE) AS two_paths, (n * dmax - d1) / ((n - 1) * (2 * n - 4)) AS centralization_degree
  FROM bins JOIN m USING (k) JOIN ds USING (k) LEFT JOIN rec USING (k), n) x UNPIVOT (value FOR measure IN (density, edges, active_nodes, isolates, reciprocity, mutual, "asymmetric", "null", degree_mean, degree_variance, degree_max, mean_degree, indegree_1_5, outdegree_1_5, in_2stars, out_2stars, two_paths, centralization_degree)) u""")  # fmt: skip
def net_metrics_degrees(spark, sf):
    names = ["density", "edges", "active_nodes", "isolates", "reciprocity", "mutual", "asymmetric", "null", "degree_mean", "degree_variance", "degree_max", "mean_degree", "indegree_1_5", "outdegree_1_5", "in_2stars", "out_2stars", "two_paths", "centralization_degree"]
    return snapshots.metrics(nations(spark, sf), names).withColumn("value", F.round("value", 9))


@query(N2 + """, way AS (SELECT a.k, a.f AS x, b.t AS z FROM edge a JOIN edge b ON a.k = b.k AND a.t = b.f AND a.f <> b.t),
c AS (SELECT way.k, count(*) AS ways, count(e.f) AS closed, count(r.f) AS cyc FROM way LEFT JOIN edge e ON e.k = way.k AND e.f = x AND e.t = z LEFT JOIN edge r ON r.k = way.k AND r.f = z AND r.t = x GROUP BY way.k)
SELECT lo AS time, u.measure, round(u.value, 9) AS value FROM (SELECT lo, coalesce(c.closed / ways, 1.0) AS transitivity, coalesce(cyc / 3 + c.closed, 0.0) AS triangles FROM bins LEFT JOIN c USING (k)) UNPIVOT (value FOR measure IN (transitivity, triangles)) u""")  # fmt: skip
def net_metrics_triangles(spark, sf):
    return snapshots.metrics(nations(spark, sf), ["transitivity", "triangles"]).withColumn("value", F.round("value", 9))


@query(N2 + DEG + """SELECT bins.lo AS time, 'assortativity' AS measure, round(value, 9) AS value FROM bins LEFT JOIN (
  SELECT edge.k, CASE WHEN count(*) * sum(p.d * p.d) - sum(p.d) * sum(p.d) > 0 AND count(*) * sum(q.d * q.d) - sum(q.d) * sum(q.d) > 0 THEN (count(*) * sum(p.d * q.d) - sum(p.d) * sum(q.d)) / sqrt((count(*) * sum(p.d * p.d) - sum(p.d) * sum(p.d))::DOUBLE * (count(*) * sum(q.d * q.d) - sum(q.d) * sum(q.d))::DOUBLE) END AS value
  FROM edge JOIN dg p ON p.k = edge.k AND p.v = f JOIN dg q ON q.k = edge.k AND q.v = t GROUP BY edge.k) USING (k)""")  # fmt: skip
def net_metrics_assortativity(spark, sf):
    return snapshots.metrics(nations(spark, sf), ["assortativity"]).withColumn("value", F.round("value", 9))


@query()
def net_metrics_ways(spark, sf):
    return snapshots.metrics(nations(spark, sf), list(snapshots.KERNEL))


@query(N2 + """, g AS (SELECT n_name AS v, CAST(n_regionkey AS VARCHAR) AS g FROM nation), cells AS (SELECT a.g AS x, b.g AS y FROM (SELECT DISTINCT g FROM g) a, (SELECT DISTINCT g FROM g) b),
c AS (SELECT k, p.g AS x, q.g AS y, count(*) AS c FROM edge JOIN g p ON p.v = f JOIN g q ON q.v = t GROUP BY ALL)
SELECT lo AS time, x || ' -> ' || y AS cell, x AS from_group, y AS to_group, coalesce(c, 0) AS ties FROM bins CROSS JOIN cells LEFT JOIN c USING (k, x, y)""")  # fmt: skip
def net_mixing(spark, sf):
    return snapshots.mixing(nations(spark, sf), "region")


BASE = ", base AS (SELECT k, lo AS time, n_name AS node FROM bins, nation)"


@query(N2 + DEG + BASE + "SELECT time, node, 'degree' AS measure, CAST(coalesce(d, 0) AS DOUBLE) AS value FROM base LEFT JOIN dg ON dg.k = base.k AND dg.v = node")
def net_degree_series(spark, sf):
    return centrality.centrality_series(nations(spark, sf), ["degree"])


@query(N2 + BASE + """, st AS (SELECT k, f AS v, sum(w * CASE WHEN s = e THEN 1 ELSE least(1, (least(e, hi) - greatest(s, lo)) / (e - s)) END) AS x FROM act GROUP BY ALL)
SELECT time, node, 'strength' AS measure, round(coalesce(x, 0), 6) AS value FROM base LEFT JOIN st ON st.k = base.k AND v = node""")  # fmt: skip
def net_strength_series(spark, sf):
    return centrality.centrality_series(nations(spark, sf), ["strength"], mode="out").withColumn("value", F.round("value", 6))


@query(N2 + DEG + BASE + """, ar AS (SELECT k, f AS v, t AS w FROM edge UNION SELECT k, t, f FROM edge), nb AS (SELECT ar.k, ar.v, sum(dg.d) AS s FROM ar JOIN dg ON dg.k = ar.k AND dg.v = ar.w GROUP BY ALL)
SELECT time, node, 'diffusion' AS measure, CAST(coalesce(d + s, 0) AS DOUBLE) AS value FROM base LEFT JOIN dg ON dg.k = base.k AND dg.v = node LEFT JOIN nb ON nb.k = base.k AND nb.v = node""")  # fmt: skip
def net_diffusion_series(spark, sf):
    return centrality.centrality_series(nations(spark, sf), ["diffusion"])


@query(N2 + BASE + """, ar AS (SELECT k, f AS v, t AS w FROM edge UNION ALL SELECT k, t, f FROM edge), c AS (SELECT k, v, n_regionkey AS g, count(*) AS c FROM ar JOIN nation ON n_name = w GROUP BY ALL),
p AS (SELECT k, v, 1 - sum(c * c) / (sum(c) * sum(c)) AS x FROM c GROUP BY ALL)
SELECT time, node, 'participation' AS measure, round(coalesce(x, 'nan'::DOUBLE), 9) AS value FROM base LEFT JOIN p ON p.k = base.k AND v = node""")  # fmt: skip
def net_participation_series(spark, sf):
    return centrality.centrality_series(nations(spark, sf), ["participation"], groups="region").withColumn("value", F.round("value", 9))


@query()
def net_centrality_kernels(spark, sf):
    names = ["closeness", "betweenness", "eigenvector", "pagerank", "hub", "authority", "coreness", "constraint", "power", "harary", "information", "load"]
    return centrality.centrality_series(nations(spark, sf), names, step=720.0)


@query()
def net_flow_betweenness(spark, sf):
    return centrality.centrality_series(nations(spark, sf), ["flow_betweenness"], window="all")


@query(N2 + """, fs AS (SELECT f, t, min(s) AS s FROM sp GROUP BY ALL)
SELECT lo AS time, (SELECT count(*) FROM sp WHERE s >= lo AND (s < hi OR closed AND s <= hi)) AS formation, (SELECT count(*) FROM sp WHERE e >= lo AND (e < hi OR closed AND e <= hi)) AS dissolution,
  (SELECT count(*) FROM act WHERE act.k = bins.k) AS active, (SELECT count(*) FROM fs WHERE s >= lo AND (s < hi OR closed AND s <= hi)) AS new_pairs FROM bins""")  # fmt: skip
def net_events(spark, sf):
    return dynamics.events(nations(spark, sf))


ISLE = """, o AS (SELECT *, max(e) OVER (PARTITION BY f, t ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pe FROM sp),
i AS (SELECT *, sum(CASE WHEN s <= pe THEN 0 ELSE 1 END) OVER (PARTITION BY f, t ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS g FROM o),
isle AS (SELECT f, t, g, min(s) AS s, max(e) AS e FROM i GROUP BY ALL)
"""


@query(N2 + ISLE + """SELECT f AS "from", t AS "to", events, round(total, 6) AS total, round(mean, 6) AS mean, median, first, last, round("union", 6) AS "union" FROM
  (SELECT f, t, count(*) AS events, sum(e - s) AS total, avg(e - s) AS mean, median(e - s) AS median, min(s) AS first, max(e) AS last FROM sp GROUP BY ALL) JOIN (SELECT f, t, sum(e - s) AS "union" FROM isle GROUP BY ALL) USING (f, t)""")  # fmt: skip
def net_durations_pair(spark, sf):
    d = dynamics.durations(nations(spark, sf))
    return d.withColumns({c: F.round(c, 6) for c in ("total", "mean", "union")})


ENDS = """, ev AS (SELECT f AS v, s, e FROM sp UNION ALL SELECT t, s, e FROM sp), ov AS (SELECT *, max(e) OVER (PARTITION BY v ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pe FROM ev),
iv AS (SELECT *, sum(CASE WHEN s <= pe THEN 0 ELSE 1 END) OVER (PARTITION BY v ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS g FROM ov), uv AS (SELECT v, sum(e - s) AS u FROM (SELECT v, g, min(s) AS s, max(e) AS e FROM iv GROUP BY ALL) GROUP BY v)
"""


@query(N2 + ENDS + """SELECT v AS node, count(*) AS events, round(sum(e - s), 6) AS total, round(any_value(u), 6) AS "union" FROM ev JOIN uv USING (v) GROUP BY v""")
def net_durations_node_ties(spark, sf):
    return dynamics.durations(nations(spark, sf), "node_ties").withColumns({c: F.round(c, 6) for c in ("total", "union")})


@query(N2 + """SELECT f AS "from", t AS "to", e - s AS duration, s AS first, e AS last FROM sp""")
def net_durations_spell(spark, sf):
    return dynamics.durations(nations(spark, sf), "spell").drop("raw_id")


@query(N2 + ISLE + """, occ AS (SELECT k, sum(least(e, hi) - greatest(s, lo)) AS o FROM (SELECT bins.k, bins.lo, bins.hi, isle.s, isle.e FROM isle JOIN bins ON s < hi AND e > lo) GROUP BY k)
SELECT time, round(risk, 4) AS risk, round(o, 4) AS occupied, round(cr, 4) AS cohort_risk, made AS onsets, round(o / risk, 9) AS temporal_density, round(o / cr, 9) AS observed_pair_density, round(made / risk, 9) AS onset_intensity, round(made / cr, 9) AS observed_pair_onset_intensity FROM
  (SELECT bins.lo AS time, o, (least(bins.hi, span.hi) - bins.lo) * 600 AS risk, (least(bins.hi, span.hi) - bins.lo) * (SELECT count(DISTINCT (f, t)) FROM sp) AS cr, (SELECT count(*)::DOUBLE FROM sp WHERE s >= bins.lo AND (s < bins.hi OR closed AND s <= bins.hi)) AS made FROM bins JOIN occ USING (k), span)""")  # fmt: skip
def net_temporal_density(spark, sf):
    x = dynamics.exposure(nations(spark, sf))
    return x.withColumns({c: F.round(c, 4 if c in ("risk", "occupied", "cohort_risk") else 9) for c in x.columns if c not in ("time", "onsets")})


@query(N2 + ISLE + """, occ AS (SELECT k, sum(least(e, hi) - greatest(s, lo)) AS o FROM (SELECT bins.k, bins.lo, bins.hi, isle.s, isle.e FROM isle JOIN bins ON s < hi AND e > lo) GROUP BY k),
c AS (SELECT bins.k, (SELECT count(*) FROM sp WHERE s >= lo AND (s < hi OR closed AND s <= hi)) AS made, (SELECT count(*) FROM sp WHERE e >= lo AND (e < hi OR closed AND e <= hi)) AS ended FROM bins)
SELECT bins.lo AS time, round(made / ((least(bins.hi, span.hi) - bins.lo) * 25 * 24 - o), 9) AS formation_rate, round(ended / o, 9) AS dissolution_rate FROM bins JOIN occ USING (k) JOIN c USING (k), span""")  # fmt: skip
def net_rates(spark, sf):
    r = dynamics.rates(nations(spark, sf), infinite=True)
    return r.select("time", *[F.round(c, 9).alias(c) for c in ("formation_rate", "dissolution_rate")])


@query()
def net_transitions(spark, sf):
    net = nations(spark, sf)
    lo, hi = net.span()
    return dynamics.transitions(net, [float(int(lo)) + k * STEP for k in range(1, int((hi - lo) / STEP))])


@query(N1 + """, st AS (SELECT ses, f AS v, s FROM sp UNION ALL SELECT ses, t, s FROM sp), g AS (SELECT *, s - lag(s) OVER (PARTITION BY ses, v ORDER BY s) AS gap, row_number() OVER (PARTITION BY ses, v ORDER BY s) - 1 AS i FROM st)
SELECT ses AS session, v AS node, s AS time, CAST(i AS INTEGER) AS index, gap FROM g WHERE gap IS NOT NULL""")  # fmt: skip
def net_gaps(spark, sf):
    return dynamics.gaps(turns(spark, sf))


@query(N1 + """, st AS (SELECT ses, f AS v, s FROM sp UNION ALL SELECT ses, t, s FROM sp), g AS (SELECT *, s - lag(s) OVER (PARTITION BY ses, v ORDER BY s) AS y FROM st), h AS (SELECT *, lag(y) OVER (PARTITION BY ses, v ORDER BY s) AS x FROM g)
SELECT v AS node, count(*) AS events, round(avg(y), 9) AS mean_gap, round(CASE WHEN count(y) >= 2 AND stddev_pop(y) + avg(y) > 0 THEN (stddev_pop(y) - avg(y)) / (stddev_pop(y) + avg(y)) END, 9) AS burstiness, round(CASE WHEN count(x) >= 2 AND var_pop(CASE WHEN x IS NOT NULL THEN y END) > 0 AND var_pop(x) > 0 THEN corr(x, y) END, 7) AS memory FROM h GROUP BY v""")  # fmt: skip
def net_burstiness(spark, sf):
    b = dynamics.burstiness(turns(spark, sf))
    return b.select("node", "events", F.round("mean_gap", 9).alias("mean_gap"), F.round("burstiness", 9).alias("burstiness"), F.round("memory", 7).alias("memory"))


@query(N2 + ISLE + """SELECT f AS "from", t AS "to", 1 AS "binary", total_duration, spell_count, weight_sum, weighted_duration, first, last, union_duration, activity_count, round(union_duration / (hi - lo), 9) AS duration_fraction FROM span,
  (SELECT f, t, sum(e - s) AS total_duration, count(*) AS spell_count, sum(w) AS weight_sum, sum(w * (e - s)) AS weighted_duration, min(s) AS first, max(e) AS last FROM sp GROUP BY ALL) JOIN (SELECT f, t, sum(e - s) AS union_duration, count(*) AS activity_count FROM isle GROUP BY ALL) USING (f, t)""")  # fmt: skip
def net_collapse(spark, sf):
    return dynamics.collapse_network(nations(spark, sf)).drop("latest_weight").withColumn("duration_fraction", F.round("duration_fraction", 9))  # equal last ends: any of their weights


@query(N2 + """SELECT f AS "from", t AS "to", sum(w) AS weight FROM sp GROUP BY ALL""")
def net_aggregate(spark, sf):
    return dynamics.aggregate_network(nations(spark, sf))


@query(N2 + """SELECT u.property, round(u.value, 6) AS value FROM (SELECT (SELECT count(*)::DOUBLE FROM sp) AS spells, (SELECT count(DISTINCT (f, t))::DOUBLE FROM sp) AS pairs, (SELECT sum(w)::DOUBLE FROM sp) AS weight, n::DOUBLE AS nodes, lo AS start, hi AS "end", (SELECT count(*)::DOUBLE FROM bins) AS bins FROM n, span) UNPIVOT (value FOR property IN (spells, pairs, weight, nodes, start, "end", bins)) u""")
def net_summary(spark, sf):
    s = dynamics.network_summary(nations(spark, sf))
    return s.filter(F.col("property").isin("spells", "pairs", "weight", "nodes", "start", "end", "bins")).withColumn("value", F.round("value", 6))


@query(N1 + """SELECT ses AS session, f AS "from", t AS "to", s AS start FROM sp""")
def net_turns(spark, sf):
    return turns(spark, sf).spells.select("session", "from", "to", "start")


@query("""WITH m AS (SELECT DISTINCT l_orderkey AS g, l_suppkey AS a FROM lineitem)
SELECT CAST(least(CAST(x.a AS VARCHAR), CAST(y.a AS VARCHAR)) AS VARCHAR) AS "from", CAST(greatest(CAST(x.a AS VARCHAR), CAST(y.a AS VARCHAR)) AS VARCHAR) AS "to", epoch_us(o_orderdate) / 86400e6 AS start, CAST(x.g AS VARCHAR) AS "group"
FROM m x JOIN m y ON x.g = y.g AND x.a < y.a JOIN orders ON o_orderkey = x.g""")
def net_copresence(spark, sf):
    li = spread(_t(spark, sf, "lineitem").select("l_orderkey", F.col("l_suppkey").alias("actor")), "l_orderkey").join(_t(spark, sf, "orders").select(F.col("o_orderkey").alias("l_orderkey"), _days("o_orderdate").alias("time")), "l_orderkey")
    net = builders.copresence_network(li.withColumnRenamed("l_orderkey", "group"), check=False)
    return net.spells.select("from", "to", "start", "group")


@query("""WITH e AS (SELECT event_type AS th, CAST(user_id AS VARCHAR) AS f, CAST(user_id % 7 AS VARCHAR) AS t, epoch_us(ts) / 86400e6 AS s FROM events), k AS (SELECT * FROM e WHERE f <> t)
SELECT f AS "from", t AS "to", s AS start, max(s) OVER (PARTITION BY th) AS "end" FROM k""")
def net_threaded(spark, sf):
    ev = _t(spark, sf, "events").select(F.col("event_type").alias("thread"), F.col("user_id").cast("string").alias("from"), (F.col("user_id") % 7).cast("string").alias("to"), _days("ts").alias("time"))
    return builders.threaded_network(ev, check=False).spells.select("from", "to", "start", "end")


@query("""WITH m AS (SELECT DISTINCT conv_id AS g, role AS a FROM conversations)
SELECT role AS "from", m.a AS "to", CAST(turn AS DOUBLE) AS start, CAST(conv_id AS VARCHAR) AS session FROM conversations JOIN m ON g = conv_id AND a <> role""")
def net_broadcast(spark, sf):
    c = _t(spark, sf, "conversations").select(F.col("role").alias("actor"), F.col("conv_id").alias("group"), F.col("turn").alias("time"))
    return builders.broadcast_network(c, check=False).spells.select("from", "to", "start", "session")


@query(N1 + """, q AS (SELECT ses, s, lag(f) OVER w AS a, lag(t) OVER w AS b, f AS c, t AS d FROM sp WINDOW w AS (PARTITION BY ses ORDER BY s, f, t)),
x AS (SELECT CASE WHEN c = b THEN CASE WHEN d = a THEN 'AB-BA' ELSE 'AB-BY' END WHEN c <> a THEN CASE WHEN d = a THEN 'AB-XA' WHEN d = b THEN 'AB-XB' ELSE 'AB-XY' END WHEN d <> b THEN 'AB-AY' END AS shift FROM q WHERE a IS NOT NULL)
SELECT v.shift, v.family, coalesce(c, 0) AS count, round(coalesce(c, 0) / (SELECT count(*) FROM x WHERE shift IS NOT NULL), 9) AS share FROM (VALUES ('AB-BA', 'receiving'), ('AB-B0', 'receiving'), ('AB-BY', 'receiving'), ('A0-X0', 'claiming'), ('A0-XA', 'claiming'), ('A0-XY', 'claiming'), ('AB-X0', 'usurping'), ('AB-XA', 'usurping'), ('AB-XB', 'usurping'), ('AB-XY', 'usurping'), ('A0-AY', 'continuing'), ('AB-A0', 'continuing'), ('AB-AY', 'continuing')) v(shift, family)
LEFT JOIN (SELECT shift, count(*) AS c FROM x GROUP BY shift) USING (shift)""")  # fmt: skip
def net_pshifts(spark, sf):
    return sequences.pshifts(turns(spark, sf)).withColumn("share", F.round("share", 9))


@query(N1 + """SELECT a.t AS via, a.s AS s1, b.s - a.s AS wait FROM sp a JOIN sp b ON a.ses = b.ses AND a.t = b.f AND b.s > a.s + 1e-9 AND b.s <= a.s + 0.05""")
def net_event_graph(spark, sf):
    net = turns(spark, sf)
    g = sequences.event_graph(net, delta=0.05, after=1e-9)
    return g.join(net.spells.select(F.col("raw_id").alias("first"), F.col("start").alias("s1")), "first").select("via", "s1", "wait")


@query(N1 + """, o AS (SELECT *, row_number() OVER (ORDER BY ses, s, f, t) AS r FROM sp),
tri AS (SELECT [a.f, a.t, b.f, b.t, c.f, c.t] AS l FROM o a JOIN o b ON a.ses = b.ses AND a.r < b.r AND b.s <= a.s + 0.02 JOIN o c ON a.ses = c.ses AND b.r < c.r AND c.s <= a.s + 0.02),
q AS (SELECT l, list_reduce(l[2:], lambda acc, x: CASE WHEN list_contains(string_split(acc, '|'), x) THEN acc ELSE acc || '|' || x END, l[1]) AS u FROM tri),
kk AS (SELECT list_reduce(list_transform(l, lambda x: CAST(list_position(string_split(u, '|'), x) - 1 AS VARCHAR)), lambda p, y: p || y) AS key FROM q WHERE len(string_split(u, '|')) <= 3)
SELECT key, count(*) AS count FROM kk GROUP BY key""")  # fmt: skip
def net_motif_keys(spark, sf):
    return sequences.motif_instances(turns(spark, sf), delta=0.02).groupBy("key").agg(F.count("*").alias("count"))


MOTIF_VALUES = ", ".join(f"('{k}', {c})" for k, cs in sequences.MOTIF_KEYS.items() for c in cs)


@query(ORACLE_SQL["net_motif_keys"].replace("SELECT key, count(*) AS count FROM kk GROUP BY key", f""", cl AS (SELECT m, ['star_pre', 'star_mid', 'star_post', 'two_node', 'triangle'][(m - 1) // 8 + 1] AS family, ['III', 'IIO', 'IOI', 'IOO', 'OII', 'OIO', 'OOI', 'OOO'][(m - 1) % 8 + 1] AS pattern FROM (SELECT unnest(range(1, 41)) AS m)),
mp(key, m) AS (VALUES {MOTIF_VALUES})
SELECT CAST(cl.m AS INTEGER) AS motif, family, pattern, count(kk.key) AS count FROM cl LEFT JOIN mp USING (m) LEFT JOIN kk USING (key) GROUP BY ALL"""))
def net_motifs(spark, sf):
    return sequences.motifs(turns(spark, sf), delta=0.02)


OVER = """, sz AS (SELECT bins.k, lo AS time, coalesce(c, 0) AS c FROM bins LEFT JOIN (SELECT k, count(*) AS c FROM edge GROUP BY k) USING (k)),
ov AS (SELECT p.k AS k1, q.k AS k2, p.time AS time1, q.time AS time2, p.c AS a, q.c AS b, (SELECT count(*) FROM edge x JOIN edge y ON x.f = y.f AND x.t = y.t WHERE x.k = p.k AND y.k = q.k) AS i FROM sz p, sz q)
"""


@query(N2 + OVER + "SELECT time1, time2, round(CASE WHEN a + b - i > 0 THEN i / (a + b - i) END, 9) AS value FROM ov")
def net_similarity(spark, sf):
    return crossbin.similarity(nations(spark, sf)).withColumn("value", F.round("value", 9))


@query(N2 + OVER + "SELECT time1, time2, round(CASE WHEN a * b > 0 THEN i / sqrt(a * b) END, 9) AS value FROM ov")
def net_similarity_cosine(spark, sf):
    return crossbin.similarity(nations(spark, sf), "cosine").withColumn("value", F.round("value", 9))


@query(N2 + OVER + "SELECT time1 AS time, round((a + b - 2 * i) / 600, 9) AS volatility FROM ov WHERE k2 = k1 + 1")
def net_turnover(spark, sf):
    return crossbin.turnover(nations(spark, sf)).withColumn("volatility", F.round("volatility", 9))


@query(N2 + "SELECT round(count(DISTINCT (f, t)) / count(*), 9) AS fluctuability FROM edge")
def net_fluctuability(spark, sf):
    return crossbin.fluctuability(nations(spark, sf)).withColumn("fluctuability", F.round("fluctuability", 9))


@query(N2 + """, ar AS (SELECT k, f AS v, t AS w FROM edge UNION SELECT k, t, f FROM edge), dg AS (SELECT k, v, count(*) AS d FROM ar GROUP BY ALL),
sh AS (SELECT x.k, x.v, count(*) AS s FROM ar x JOIN ar y ON y.k = x.k + 1 AND x.v = y.v AND x.w = y.w GROUP BY ALL)
SELECT lo AS time, n_name AS node, round(coalesce(s / sqrt(p.d * q.d), 0), 9) AS overlap FROM bins CROSS JOIN nation LEFT JOIN dg p ON p.k = bins.k AND p.v = n_name LEFT JOIN dg q ON q.k = bins.k + 1 AND q.v = n_name LEFT JOIN sh ON sh.k = bins.k AND sh.v = n_name WHERE NOT closed""")  # fmt: skip
def net_persistence(spark, sf):
    return crossbin.persistence(nations(spark, sf)).withColumn("overlap", F.round("overlap", 9))


@query(N2 + """, u AS (SELECT DISTINCT k, least(f, t) AS a, greatest(f, t) AS b FROM edge), z AS (SELECT n_regionkey AS g, count(*) AS n FROM nation GROUP BY ALL),
x AS (SELECT k, sum(CASE WHEN p.n_regionkey = q.n_regionkey THEN 2.0 / (zp.n * (zp.n - 1)) ELSE -2.0 / (zp.n * zq.n) END) AS v FROM u JOIN nation p ON p.n_name = a JOIN nation q ON q.n_name = b JOIN z zp ON zp.g = p.n_regionkey JOIN z zq ON zq.g = q.n_regionkey GROUP BY k)
SELECT lo AS time, round(coalesce(v, 0), 9) AS value FROM bins LEFT JOIN x USING (k)""")  # fmt: skip
def net_segregation(spark, sf):
    return crossbin.segregation(nations(spark, sf), "region").withColumn("value", F.round("value", 9))


@query(N2 + """SELECT f || '@' || (k + 1) AS from_state, t || '@' || (k + 1) AS to_state, 'within' AS kind, weight FROM edge
UNION ALL SELECT n_name || '@' || (k + 1), n_name || '@' || (k + 2), 'identity', 1.0 FROM bins, nation WHERE NOT closed""")
def net_projection(spark, sf):
    return crossbin.projection(nations(spark, sf))[1]


@query()
def net_phases(spark, sf):
    return crossbin.phases(nations(spark, sf))


@query(N2 + """, u AS (SELECT k, least(f, t) AS a, greatest(f, t) AS b, sum(weight) AS w FROM edge GROUP BY ALL), ar AS (SELECT k, a AS v, b AS o, w FROM u UNION ALL SELECT k, b, a, w FROM u),
dg AS (SELECT k, v, sum(w) AS d FROM ar GROUP BY ALL), m AS (SELECT k, sum(d) AS m FROM dg GROUP BY k),
ins AS (SELECT sum(w) AS x FROM ar JOIN nation p ON p.n_name = v JOIN nation q ON q.n_name = o WHERE p.n_regionkey = q.n_regionkey),
nul AS (SELECT sum(d * d / m) AS y FROM (SELECT k, n_regionkey, sum(d) AS d FROM dg JOIN nation ON n_name = v GROUP BY ALL) JOIN m USING (k)), tot AS (SELECT sum(m) AS tm FROM m), nb AS (SELECT count(*) AS nb FROM bins)
SELECT round((x - y + 2 * 25 * (nb - 1)) / (tm + 2 * 25 * (nb - 1)), 9) AS q, round((x - y) / (tm + 2 * 25 * (nb - 1)), 9) AS q_intra, round(2 * 25 * (nb - 1) / (tm + 2 * 25 * (nb - 1)), 9) AS q_inter, CAST(tm + 2 * 25 * (nb - 1) AS DOUBLE) AS two_mu FROM ins, nul, tot, nb""")  # fmt: skip
def net_multislice_modularity(spark, sf):
    net = nations(spark, sf)
    bins = results.tidy(net, "bins")
    member = net.nodes.crossJoin(F.broadcast(bins)).select("time", F.col("name").alias("node"), F.col("region").alias("community"))
    q = crossbin.multislice_modularity(net, member)
    return q.select(*[F.round(c, 9).alias(c) for c in ("q", "q_intra", "q_inter")], "two_mu")


#: Rounds of the SQL below: ways with the earliest arrivals have fewer hops on these tables.
ROUNDS = 8


def _rounds() -> str:
    """Earliest arrivals by at most k hops, k = 0, 1, ...: each round joins what the last one knows with all spells."""
    out = ", r0 AS (SELECT n_name AS src, n_name AS v, lo AS a FROM nation, span)"
    for k in range(1, ROUNDS + 1):
        out += f""", r{k} AS (SELECT src, v, min(a) AS a FROM (SELECT * FROM r{k - 1} UNION ALL SELECT src, t, greatest(a, s) FROM r{k - 1} JOIN sp ON f = v AND (greatest(a, s) = s OR greatest(a, s) < e)) GROUP BY ALL)"""
    every = " UNION ALL ".join(f"SELECT {k} AS h, * FROM r{k}" for k in range(ROUNDS + 1))
    return out + f", st AS ({every}), ar AS (SELECT src, v, a FROM r{ROUNDS})"


WAYS = N2.rstrip() + _rounds() + "\n"


@query(WAYS + "SELECT src AS source, v AS node, a AS arrival FROM ar")
def net_arrivals(spark, sf):
    return paths.arrivals(nations(spark, sf))


@query(WAYS + """SELECT n_name AS node, coalesce(o, 0) AS reach_out, coalesce(i, 0) AS reach_in, round(coalesce(o, 0) / 24, 9) AS share_out, round(coalesce(i, 0) / 24, 9) AS share_in, round(l, 6) AS latency
FROM nation LEFT JOIN (SELECT src AS n_name, count(*) AS o, avg(a - lo) AS l FROM ar, span WHERE src <> v GROUP BY ALL) USING (n_name) LEFT JOIN (SELECT v AS n_name, count(*) AS i FROM ar WHERE src <> v GROUP BY ALL) USING (n_name)""")  # fmt: skip
def net_reachability(spark, sf):
    r = paths.reachability(nations(spark, sf))
    return r.withColumns({c: F.round(c, 9) for c in ("share_out", "share_in")}).withColumn("latency", F.round("latency", 6))


@query(WAYS + "SELECT src AS source, v AS node, lo AS departure, a AS arrival, a - lo AS latency, CAST(min(h) AS BIGINT) AS hops FROM st JOIN ar USING (src, v, a), span GROUP BY ALL")
def net_paths(spark, sf):
    return paths.paths(nations(spark, sf), sessions="collapse").select("source", "node", "departure", "arrival", "latency", "hops")


@query(WAYS + ", mh AS (SELECT src, v, min(h) AS h FROM st GROUP BY ALL) SELECT src AS source, v AS node, min(a) AS arrival, CAST(h AS BIGINT) AS hops FROM st JOIN mh USING (src, v, h) GROUP BY ALL")
def net_paths_min_hops(spark, sf):
    return paths.paths(nations(spark, sf), criterion="min_hops", sessions="collapse").select("source", "node", "arrival", "hops")


@query(WAYS + ", mh AS (SELECT src, v, min(h) AS h FROM st WHERE src <> v GROUP BY ALL) SELECT round(coalesce(sum(1 / h), 0) / 600, 9) AS temporal_efficiency, CAST(max(h) AS BIGINT) AS temporal_diameter, count(*) = 600 AS connected FROM mh")
def net_distance_summary(spark, sf):
    return paths.distance_summary(nations(spark, sf)).withColumn("temporal_efficiency", F.round("temporal_efficiency", 9))


#: Instants of each session in order, with their contacts by number of vertex.
INSTANTS = N1.replace("WITH", "WITH RECURSIVE", 1).rstrip() + """, st AS (SELECT ses, f, t, s FROM sp), nm AS (SELECT v, row_number() OVER (ORDER BY v) AS i FROM (SELECT f AS v FROM st UNION SELECT t FROM st)), m AS (SELECT count(*) AS m FROM nm), z AS (SELECT max(s) AS hi FROM st),
c AS (SELECT ses, s, p.i AS f, q.i AS t, dense_rank() OVER (PARTITION BY ses ORDER BY s) AS b FROM st JOIN nm p ON p.v = f JOIN nm q ON q.v = t),
bt AS MATERIALIZED (SELECT ses, b, any_value(s) AS s, list({'f': f, 't': t}) AS cs, max(b) OVER (PARTITION BY ses) AS last FROM c GROUP BY ses, b),
nd AS (SELECT DISTINCT ses, i FROM (SELECT ses, f AS i FROM c UNION ALL SELECT ses, t FROM c))
"""


def _into(each: str) -> str:
    """The sum of ``each`` over an instant's contacts that end at vertex i."""
    return f"coalesce(list_sum(list_transform(list_filter(cs, lambda e: e.t = i), lambda e: {each})), 0)"


KATZ = INSTANTS + f""", g AS (SELECT ses, 0::BIGINT AS b, 0.0::DOUBLE AS tm, list_transform(range(1, m + 1), lambda i: 0.0::DOUBLE) AS x FROM (SELECT DISTINCT ses FROM c), m
  UNION ALL SELECT g.ses, bt.b, bt.s, list_transform(range(1, len(x) + 1), lambda i: exp(tm - s) * x[i] + 0.05::DOUBLE * {_into("exp(tm - s) * x[e.f] + 1.0::DOUBLE")}) FROM g JOIN bt ON bt.ses = g.ses AND bt.b = g.b + 1)
SELECT g.ses AS session, v AS node, round(x[nm.i] * exp(tm - hi), 9) AS value FROM g JOIN (SELECT ses, max(b) AS b FROM bt GROUP BY ses) l USING (ses, b) JOIN nd USING (ses) JOIN nm USING (i), z"""

_PAGERANK = INSTANTS + f""", g AS (SELECT ses, 0::BIGINT AS b, list_transform(range(1, m + 1), lambda i: 0.0::DOUBLE) AS r, list_transform(range(1, m + 1), lambda i: 0.0::DOUBLE) AS a FROM (SELECT DISTINCT ses FROM c), m
  UNION ALL SELECT g.ses, bt.b, list_transform(range(1, len(r) + 1), lambda i: r[i] + 0.15::DOUBLE * len(list_filter(cs, lambda e: e.f = i)) + {_into("0.85::DOUBLE * (a[e.f] + 0.15::DOUBLE)")}),
    list_transform(range(1, len(r) + 1), lambda i: CASE WHEN len(list_filter(cs, lambda e: e.f = i)) > 0 THEN 0 ELSE a[i] END + {_into("0.85::DOUBLE * (a[e.f] + 0.15::DOUBLE)")}) FROM g JOIN bt ON bt.ses = g.ses AND bt.b = g.b + 1)
SELECT g.ses AS session, v AS node, round(r[nm.i] / list_sum(r), 12) AS value FROM g JOIN (SELECT ses, max(b) AS b FROM bt GROUP BY ses) l USING (ses, b) JOIN nd USING (ses) JOIN nm USING (i)"""

_WALK = INSTANTS + f""", g AS (SELECT ses, 0::BIGINT AS b, list_transform(range(1, m + 1), lambda i: 0.0::DOUBLE) AS x, CAST([] AS DOUBLE[]) AS w FROM (SELECT DISTINCT ses FROM c), m
  UNION ALL SELECT g.ses, bt.b, list_transform(range(1, len(x) + 1), lambda i: x[i] + {_into("1 + 0.05::DOUBLE * x[e.f]")}), list_transform(cs, lambda e: 1 + 0.05::DOUBLE * x[e.f]) FROM g JOIN bt ON bt.ses = g.ses AND bt.b = g.b + 1),
h AS (SELECT ses, last + 1 AS b, list_transform(range(1, m + 1), lambda i: 0.0::DOUBLE) AS x, CAST([] AS DOUBLE[]) AS w FROM (SELECT DISTINCT ses, last FROM bt), m
  UNION ALL SELECT h.ses, bt.b, list_transform(range(1, len(x) + 1), lambda i: x[i] + coalesce(list_sum(list_transform(list_filter(cs, lambda e: e.f = i), lambda e: 1 + 0.05::DOUBLE * x[e.t])), 0)), list_transform(cs, lambda e: 1 + 0.05::DOUBLE * x[e.t]) FROM h JOIN bt ON bt.ses = h.ses AND bt.b = h.b - 1),
wi AS (SELECT ses, s, e.t AS i, sum(w) AS w FROM (SELECT g.ses, s, unnest(cs) AS e, unnest(w) AS w FROM g JOIN bt USING (ses, b)) GROUP BY ALL), wo AS (SELECT ses, s, e.f AS i, sum(w) AS w FROM (SELECT h.ses, s, unnest(cs) AS e, unnest(w) AS w FROM h JOIN bt USING (ses, b)) GROUP BY ALL),
sc AS (SELECT wi.ses, wi.i, sum(wi.w * wo.w * exp(wi.s - wo.s)) AS x FROM wi JOIN wo ON wi.ses = wo.ses AND wi.i = wo.i AND wi.s < wo.s GROUP BY ALL)
SELECT nd.ses AS session, v AS node, round(coalesce(x, 0), 7) AS value FROM nd JOIN nm USING (i) LEFT JOIN sc ON sc.ses = nd.ses AND sc.i = nd.i"""

for _measure, _sql, _places in (("katz", KATZ, 9), ("pagerank", _PAGERANK, 12), ("walk", _WALK, 7)):

    def _stream(spark, sf, m=_measure, places=_places):
        return paths.stream_centrality(turns(spark, sf), m, beta=0.05, decay=1.0).withColumn("value", F.round("value", places))

    _stream.__name__ = f"net_stream_{_measure}"
    query(_sql)(_stream)


@query()
def net_temporal_communities(spark, sf):
    return communities.temporal_communities(nations(spark, sf), [1, 2, 3])[0]


@query()
def net_match_communities(spark, sf):
    return communities.match_communities(communities.snapshot_communities(nations(spark, sf)))[1]


@query()
def net_community_change(spark, sf):
    return communities.community_change(communities.snapshot_communities(nations(spark, sf)))


@query()
def net_community_trajectory(spark, sf):
    return communities.community_trajectory(communities.match_communities(communities.snapshot_communities(nations(spark, sf)))[0])


#: What each model must leave as it is: counts of ties, distinct pairs, senders and receivers, ties of the busiest of each, total length, and the span.
KEPT = {
    "ties": ("count(*)", lambda s: F.count("*")),
    "pairs": ("count(DISTINCT (f, t))", lambda s: F.countDistinct("from", "to")),
    "senders": ("count(DISTINCT f)", lambda s: F.countDistinct("from")),
    "receivers": ("count(DISTINCT t)", lambda s: F.countDistinct("to")),
    "length": ("round(sum(e - s), 3)", lambda s: F.round(F.sum(F.col("end") - F.col("start")), 3)),
    "first": ("min(s)", lambda s: F.min("start")),
    "last": ("max(e)", lambda s: F.max("end")),
}
CHANGES = {"targets": ("pairs",)}

for _model in nulls.MODELS:
    _kept = [k for k in KEPT if k not in CHANGES.get(_model, ())]

    def _null(spark, sf, m=_model, kept=_kept):
        s = nulls.randomise(nations(spark, sf), m, n=3)
        return s.groupBy("replicate").agg(*(KEPT[k][1](s).alias(k) for k in kept))

    _null.__name__ = f"net_randomise_{_model}"
    query(N2 + "SELECT replicate::INTEGER AS replicate, k.* FROM (SELECT unnest([1, 2, 3]) AS replicate), (SELECT " + ", ".join(f'{KEPT[k][0]} AS "{k}"' for k in _kept) + " FROM sp) k")(_null)


@query()
def net_significance(spark, sf):
    stat = lambda n: n.spells.groupBy("session").agg(F.countDistinct("from", "to").cast("double").alias("value"))
    return nulls.significance(nations(spark, sf), stat, ["session"], model="targets", n=9)


@query()
def net_random(spark, sf):
    return nulls.random_network(spark, 30, 10, 0.05, groups=3, p_between=0.01).spells.drop("raw_id")


@query()
def net_renewal(spark, sf):
    return nulls.renewal_network(spark, 10, 0.2, 20.0, "weibull", 0.7).spells.drop("raw_id")


@query(N2 + """SELECT f AS "from", t AS "to", s AS start, CASE WHEN s < (SELECT lo FROM span) + 365 THEN 'a' WHEN s < (SELECT lo FROM span) + 730 THEN 'b' ELSE 'c' END AS session FROM sp WHERE f <> 'NATION_6' AND t <> 'NATION_6'""")
def net_edit(spark, sf):
    net = nations(spark, sf)
    lo = net.span()[0]
    out = edit.set_tie_sessions(edit.remove_nodes(net, ["NATION_6"], cascade=True), breaks=[lo + 365, lo + 730], labels=["a", "b", "c"])
    return out.spells.select("from", "to", "start", "session")


@query(N2 + """SELECT f AS "from", t AS "to", s AS start, w AS weight FROM sp JOIN nation p ON p.n_name = f JOIN nation q ON q.n_name = t WHERE p.n_regionkey = 1 AND q.n_regionkey = 1 AND w > 10""")
def net_induce_subgraph(spark, sf):
    return edit.induce_subgraph(nations(spark, sf), nodes="region = 1", ties="weight > 10").spells.select("from", "to", "start", "weight")


@query(N2 + DEG + BASE + """SELECT node, count(*) AS n, round(avg(coalesce(d, 0)), 9) AS mean, round(stddev_samp(coalesce(d, 0)), 9) AS sd, min(coalesce(d, 0))::DOUBLE AS min, max(coalesce(d, 0))::DOUBLE AS max, arg_max(time, (coalesce(d, 0), -time)) AS peak_time, 'degree' AS measure FROM base LEFT JOIN dg ON dg.k = base.k AND dg.v = node GROUP BY node""")
def net_result_summary(spark, sf):
    r = results.summarise(centrality.centrality_series(nations(spark, sf), ["degree"]))
    return r.withColumns({c: F.round(c, 9) for c in ("mean", "sd")})


@query(N2 + """, g AS (SELECT *, lag(k) OVER (PARTITION BY f, t ORDER BY k) AS p, lead(k) OVER (PARTITION BY f, t ORDER BY k) AS q FROM edge), x AS (SELECT k, count(*) AS ties, count(*) FILTER (p IS NULL OR p <> k - 1) AS fo, count(*) FILTER (q IS NULL OR q <> k + 1) AS di FROM g GROUP BY k),
v AS (SELECT k, count(*) AS nodes FROM (SELECT k, f FROM edge UNION SELECT k, t FROM edge) GROUP BY k)
SELECT lo AS time, nodes, ties, CASE WHEN k > 0 THEN fo END AS forming, CASE WHEN NOT closed THEN di END AS dissolving FROM bins JOIN x USING (k) JOIN v USING (k)""")  # fmt: skip
def net_animation_bins(spark, sf):
    return results.animation_bins(nations(spark, sf))


import kairograph.contracts  # noqa: E402, F401  (adds its queries)
import kairograph.journey_queries  # noqa: E402, F401
import kairograph.matrix_queries  # noqa: E402, F401
import kairograph.null_queries  # noqa: E402, F401
