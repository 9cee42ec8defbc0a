"""Queries on whole networks against brute force."""

import math
import random

import pytest

from kairograph import journey_queries, registry
from kairograph.operators import journeys as J
from kairograph.sources import builders

SF = "/root/testdata/sf0.001"


@pytest.fixture
def late(spark, monkeypatch):
    """A network whose second contact is neither urgent nor early, in place of N2."""
    rows = [("A", "B", 0.0, 2.0, 1.0, "1-URGENT"), ("B", "C", 100.0, 103.0, 1.0, "5-LOW"), ("A", "C", 400.0, 401.0, 1.0, "5-LOW")]
    d = spark.createDataFrame(rows, "from string, to string, start double, end double, weight double, session string")
    for module in (registry, journey_queries):
        monkeypatch.setattr(module, "nations", lambda *_: builders.from_tables(d, check=False, interval=180.0, unit="days"))


def test_arrivals_of_all_orders(spark):
    got = {(r["source"], r["node"]): r["arrival"] for r in registry.QUERIES["net_arrivals"](spark, SF).collect()}
    spells = [tuple(r) for r in registry.nations(spark, SF).spells.select("from", "to", "start", "end").collect()]
    nodes, t0 = {v for v, _ in got}, min(s[2] for s in spells)
    for source in sorted(nodes)[:5]:
        best, before = {source: t0}, None
        while best != before:
            before = dict(best)
            for u, v, s, e in spells:
                if u in best and ((t := max(best[u], s)) == s or t < e):
                    best[v] = min(t, best.get(v, math.inf))
        assert {v: t for (u, v), t in got.items() if u == source} == best


def test_late_contacts_count(spark, late):
    q = registry.QUERIES
    assert {(r["from"], r["start"]) for r in q["net_edge_centrality"](spark, SF).collect()} == {("A", 0.0), ("B", 100.0), ("A", 400.0)}
    assert {(r["target"], r["node"]) for r in q["net_backward_paths"](spark, SF).collect()} == {(v, v) for v in "ABC"} | {("B", "A"), ("C", "A"), ("C", "B")}
    assert {(r["source"], r["node"], r["latency"]) for r in q["net_paths_fastest"](spark, SF).collect() if r["source"] != r["node"]} == {("A", "B", 0.0), ("A", "C", 0.0), ("B", "C", 0.0)}
    assert {r["ties"] for r in q["net_randomise_times"](spark, SF).collect()} == {3}


def test_windows_of_all_orders(spark):
    import duckdb
    from test_queries import TABLES, norm

    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    for name in ("net_similarity", "net_turnover", "net_persistence", "net_segregation", "net_projection", "net_multislice_modularity"):
        assert "% 97" not in registry.ORACLE_SQL[name]
        assert norm(registry.QUERIES[name](spark, SF).toPandas()) == norm(c.sql(registry.ORACLE_SQL[name]).df()), name


def test_communities_of_all_days(spark, late):
    assert registry.QUERIES["net_community_trajectory"](spark, SF).select("node").distinct().count() == 3
    assert registry.QUERIES["net_phases"](spark, SF).count() == 3


def test_fastest_stops_only_at_no_time():
    r = random.Random(4)
    for _ in range(60):
        rows = [(u, v, float(s), float(s + r.randint(0, 3)), 1.0) for u, v, s in ((r.choice("ABCD"), r.choice("ABCD"), r.randint(0, 12)) for _ in range(8)) if u != v]
        atoms = J.index(rows, True)
        got = {v: x[0] for v, x in J.fastest(atoms, "A", 0.0).items()}
        want = {"A": 0.0}
        for depart in sorted({t for x in rows for t in (x[2], x[3], math.nextafter(x[3], -math.inf))} | {0.0}):
            s = J.Search(atoms, "A", depart)
            for v in s.best:
                want[v] = min(want.get(v, math.inf), s.label(v).time - depart)
        assert got == pytest.approx(want, abs=1e-6)


def test_orders_between_nations_are_joined_once(spark):
    from kairograph.registry import nations

    plan = nations(spark, "/root/testdata/sf0.001").spells._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan
