"""Scores of contact streams by rounds of joins against one ordered pass."""

import math
import random

import pytest

from kairograph.errors import BudgetExceeded
from kairograph.operators import paths, streams
from kairograph.sources import builders

SPELLS = "from string, to string, start double, end double, weight double, session string"


def contacts(seed=5, n=60):
    r = random.Random(seed)
    rows = [(*r.sample("abcdef", 2), float(r.randint(0, 12)), r.choice("xy")) for _ in range(n)]
    return [*rows, ("a", "b", 0.7 + 0.1, "x"), ("b", "c", 0.8, "x"), ("a", "b", 3.0, "x"), ("a", "b", 3.0, "x")]


def network(spark, rows):
    return builders.from_tables(spark.createDataFrame([(a, b, t, t, 1.0, s) for a, b, t, s in rows], SPELLS), check=False)


def instants(rows, session):
    mine = sorted((t if abs(t - 0.8) > 1e-9 else 0.8, a, b) for a, b, t, s in rows if s == session)
    return [(t, [(a, b) for u, a, b in mine if u == t]) for t in sorted({t for t, _, _ in mine})]


def katz(rows, session, beta, decay, upper):
    x, last = dict.fromkeys("abcdef", 0.0), 0.0
    for t, batch in instants(rows, session):
        x, last = {v: y * math.exp(-decay * (t - last)) for v, y in x.items()}, t
        was = dict(x)
        for a, b in batch:
            x[b] += beta * (was[a] + 1)
    return {v: y * math.exp(-decay * (upper - last)) for v, y in x.items()}


def walks(rows, session, beta, decay):
    def weights(batches, end):
        total, out = dict.fromkeys("abcdef", 0.0), []
        for t, batch in batches:
            w = [(b if end else a, 1 + beta * total[a if end else b]) for a, b in batch]
            for v, y in w:
                total[v] += y
                out.append((v, t, y))
        return out

    batches = instants(rows, session)
    into, leave = weights(batches, True), weights(batches[::-1], False)
    return {v: sum(x * y * math.exp(-decay * (s - t)) for u, t, x in into if u == v for w, s, y in leave if w == v and t < s) for v in "abcdef"}


@pytest.mark.parametrize("decay", [0.0, 0.3, 400.0])
def test_scores_of_streams(spark, decay):
    rows = contacts()
    net = network(spark, rows)
    got = {m: {(r["session"], r["node"]): r["value"] for r in paths.stream_centrality(net, m, beta=0.2, decay=decay).collect()} for m in ("katz", "walk")}
    upper = max(t for _, _, t, _ in rows)
    for s in "xy":
        assert {v: got["katz"].get((s, v), 0.0) for v in "abcdef"} == pytest.approx(katz(rows, s, 0.2, decay, upper), rel=1e-9, abs=1e-300)
        assert {v: got["walk"].get((s, v), 0.0) for v in "abcdef"} == pytest.approx(walks(rows, s, 0.2, decay), rel=1e-9, abs=1e-300)


def test_times_equal_up_to_rounding_are_one_instant(spark):
    stream = streams.contact_stream(network(spark, [("a", "b", 0.7 + 0.1, None), ("b", "c", 0.8, None), ("c", "d", 0.8 + 1e-3, None)]))
    assert stream.select("t").distinct().count() == 2


def test_scores_beyond_doubles_are_refused(spark):
    rows = [("a", "b", float(t), None) if t % 2 else ("b", "a", float(t), None) for t in range(40)]
    with pytest.raises(BudgetExceeded):
        paths.stream_centrality(network(spark, rows), "katz", beta=1e20).collect()


def test_an_instant_of_pagerank_touches_its_own_vertices():
    import time

    import numpy as np

    r, n = random.Random(3), 2_000_000
    batches = [(float(t), np.array([r.randrange(9) for _ in range(k)]), np.array([r.randrange(9, 15) for _ in range(k)])) for t, k in enumerate([1, 3, 2] * 500)]
    for transition in (1, 0.5):
        score, active = [0.0] * 15, [0.0] * 15
        for _, a, b in batches:
            was, sent = active[:], [int((a == v).sum()) for v in range(15)]
            for v in range(15):
                moved = sum(0.85 * (was[x] + 0.15) for x, y in zip(a, b, strict=True) if y == v)
                score[v] += 0.15 * sent[v] + moved
                stays = (0.0 if transition == 1 else transition ** sent[v] * (was[v] + 0.15 * sent[v])) if sent[v] else was[v]
                active[v] = stays + (1.0 if transition == 1 else 1 - transition) * moved
        began = time.monotonic()
        got = paths.stream_pagerank(iter(batches), n, 0.85, transition)
        assert time.monotonic() - began < 10  # all vertices at every instant take a minute
        assert got[:15] == pytest.approx([x / sum(score) for x in score], rel=1e-9) and not got[15:].any()


@pytest.mark.parametrize("decay", [0.0, 0.3])
def test_what_waits_goes_from_block_to_block(spark, monkeypatch, decay):
    rows = contacts(8)
    monkeypatch.setattr(streams, "BLOCK", 12)
    net = network(spark, rows)
    got = {m: {(r["session"], r["node"]): r["value"] for r in paths.stream_centrality(net, m, beta=0.2, decay=decay).collect()} for m in ("katz", "walk")}
    upper = max(t for _, _, t, _ in rows)
    for s in "xy":
        assert {v: got["katz"].get((s, v), 0.0) for v in "abcdef"} == pytest.approx(katz(rows, s, 0.2, decay, upper), rel=1e-9)
        assert {v: got["walk"].get((s, v), 0.0) for v in "abcdef"} == pytest.approx(walks(rows, s, 0.2, decay), rel=1e-9)


def test_walks_of_many_hops_are_one_pass(spark, monkeypatch):
    stages = []
    kept = streams.keep
    monkeypatch.setattr(streams, "keep", lambda df, *how: stages.append(how) or kept(df, *how))
    rows = [("ab"[t % 2], "ba"[t % 2], float(t), None) for t in range(30)]
    got = {r["node"]: r["value"] for r in paths.stream_centrality(network(spark, rows), "katz", beta=1.0).collect()}
    x = {"a": 0.0, "b": 0.0}
    for a, b, _, _ in rows:
        x[b] += x[a] + 1
    assert got == pytest.approx(x)
    assert len(stages) < 12  # a stage for each hop was thirty
