"""A handful of registered queries against their SQL on the smallest tables."""

import math

import pytest

from kairograph.registry import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events conversations".split()


@pytest.fixture(scope="module")
def duck():
    import duckdb

    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def norm(frame):
    frame = frame[sorted(frame.columns)]
    clean = lambda v: "" if v is None or isinstance(v, float) and math.isnan(v) else f"{v:.6g}" if isinstance(v, float) else str(v)
    return sorted(tuple(clean(v) for v in r) for r in frame.astype(object).values.tolist())


def test_every_sql_has_a_query():
    assert set(ORACLE_SQL) <= set(QUERIES)


@pytest.mark.parametrize("name", ["net_snapshots", "net_metrics_degrees", "net_strength_series", "net_events", "net_temporal_density", "net_pshifts", "net_motif_keys", "net_persistence", "net_arrivals", "net_paths_sessions", "net_triads", "net_event_chains", "net_allegiance", "net_stream_katz"])
def test_query_equals_sql(spark, duck, name):
    got, want = QUERIES[name](spark, SF).toPandas(), duck.sql(ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert norm(got) == norm(want)


def test_next_turns_of_two_that_come_at_once(spark, tmp_path):
    """Two turns that reach a speaker at one instant have one next turn, as in the SQL."""
    import duckdb

    rows = [(1, 1, 7), (2, 2, 8), (3, 2, 9), (4, 2, 8), (5, 3, 6), (6, 4, 8)]
    c = duckdb.connect()
    c.sql(f"copy (select i::bigint as event_id, timestamp '2024-01-01' + s * interval 1 hour as ts, u::bigint as user_id, 'view' as event_type from (values {', '.join(map(str, rows))}) v(i, s, u)) to '{tmp_path}/events.parquet' (format parquet)")
    c.sql(f"create view events as select * from '{tmp_path}/events.parquet'")
    got, want = QUERIES["net_event_graph_next_turns"](spark, str(tmp_path)).toPandas(), c.sql(ORACLE_SQL["net_event_graph_next_turns"]).df()
    assert norm(got) == norm(want) and len(want) > 1


def test_orders_between_nations_are_merged_at_any_size(spark, monkeypatch):
    """Rows of orders and customers do not go through the driver, however few they are."""
    from kairograph import registry

    kept = []
    monkeypatch.setattr(registry, "keep", lambda df, *_: kept.append(df) or df)
    registry.nations(spark, SF)
    plan = kept[0]._jdf.queryExecution().executedPlan().toString()
    assert plan.count("SortMergeJoin") == 2


def test_copresence_has_more_tasks_for_more_rows(spark, duck, monkeypatch):
    from kairograph.plans import storage

    monkeypatch.setattr(storage, "ROWS", 500)
    got = QUERIES["net_copresence"](spark, SF)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "REPARTITION_BY_NUM" in plan and "hashpartitioning(_g" in plan
    rows = duck.sql("select count(*) from (select distinct l_orderkey, l_suppkey from lineitem)").fetchall()[0][0]
    assert f", {-(-rows // 500)}), REPARTITION_BY_NUM" in plan
    assert norm(got.toPandas()) == norm(duck.sql(ORACLE_SQL["net_copresence"]).df())
