"""Surrogate networks: what each model keeps, what it respects, and draws that cannot be."""

import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from kairograph.errors import BadScope, NoValidDraw
from kairograph.operators import surrogates as S
from kairograph.plans.network import build


def net_of(spark, rows, directed=True, presence=None, **more):
    ties = spark.createDataFrame(rows, "from string, to string, start double, end double, session string")
    p = None if presence is None else spark.createDataFrame(presence, "node string, start double, end double")
    return build(ties, directed, presence=p, **more)


@pytest.fixture(scope="module")
def rows():
    r = random.Random(5)
    out = []
    for i in range(90):
        a, b = r.sample("ABCDEFGH", 2)
        s = float(r.randint(0, 60))
        out.append((a, b, s, s + r.randint(0, 9), r.choice(["x", "y", None])))
    return [*out, out[0], out[0]]


def drawn(got):
    by = defaultdict(list)
    for r in got.spells.collect():
        by[r["replicate"]].append((r["from"], r["to"], r["start"], r["end"], r["session"]))
    return by


@pytest.mark.parametrize("within", ["network", "sender", "session"])
def test_scopes(spark, rows, within):
    scope = {"network": lambda r: 0, "sender": lambda r: r[0], "session": lambda r: r[4]}[within]
    net = net_of(spark, rows)
    count = lambda data, key: Counter((scope(r), key(r)) for r in data)
    for r in drawn(S.surrogates(net, "times", 3, 1, within)).values():
        assert count(r, lambda x: x[2:4]) == count(rows, lambda x: x[2:4]) and count(r, lambda x: x[:2]) == count(rows, lambda x: x[:2])
        assert Counter(r) != Counter(rows)
    for r in drawn(S.surrogates(net, "targets", 3, 1, within)).values():
        assert count(r, lambda x: x[1]) == count(rows, lambda x: x[1]) and count(r, lambda x: (x[0], *x[2:4])) == count(rows, lambda x: (x[0], *x[2:4]))
        assert all(x[0] != x[1] for x in r)

    def lines(data):
        by = defaultdict(list)
        for x in data:
            by[scope(x), x[:2]].append(x[2:4])
        return by

    for r in drawn(S.surrogates(net, "timeline", 3, 1, within)).values():
        a, b = lines(r), lines(rows)
        assert set(a) == set(b)
        assert Counter((k[0], tuple(sorted(v))) for k, v in a.items()) == Counter((k[0], tuple(sorted(v))) for k, v in b.items())


@pytest.mark.parametrize("directed", [True, False])
def test_swaps_keep_degrees(spark, rows, directed):
    few = [r for r in rows if ord(r[0]) + ord(r[1]) & 1] if directed else rows[:14]
    net = net_of(spark, few, directed)
    pair = (lambda r: (r[0], r[1])) if directed else (lambda r: (min(r[:2]), max(r[:2])))
    ends = lambda data: (Counter(a for a, _ in data), Counter(b for _, b in data)) if directed else Counter(v for p in data for v in p)
    want = {pair(r) for r in few}
    got = S.surrogates(net, "edges", 2, 3, swaps=3)
    moved = set()
    for r in drawn(got).values():
        now = {pair(x) for x in r}
        assert len(now) == len(want) and ends(now) == ends(want) and all(a != b for a, b in now) and len(r) == len(few)
        moved |= now - want
    assert moved
    assert all(0 < r["acceptance"] <= 1 and r["rejected"] == 0 for r in got.report.collect())


def test_one_pair_has_no_swap(spark):
    net = net_of(spark, [("A", "B", 0.0, 1.0, None)])
    got = S.surrogates(net, "edges", 1)
    assert drawn(got)[1] == [("A", "B", 0.0, 1.0, None)] and got.report.first()["acceptance"] == 0


PRESENCE = [("A", 0.0, 40.0), ("A", 50.0, 70.0), ("B", 0.0, 55.0), ("C", 10.0, 70.0)]
WATCHED = ((0.0, 30.0), (35.0, 70.0))


def outside(r, presence=PRESENCE, watched=WATCHED):
    there = lambda v: v not in {p[0] for p in presence} or any(p[0] == v and p[1] <= r[2] and r[3] <= p[2] for p in presence)
    seen = lambda t: any(a <= t <= b for a, b in watched)
    return not (there(r[0]) and there(r[1]) and seen(r[2]) and seen(r[3]))


@pytest.mark.parametrize("model", ["times", "targets"])
def test_repairs_respect_presence_and_watched_time(spark, rows, model):
    rows = [r for r in rows if not outside(r)] + [("A", "B", 41.0, 42.0, None)]
    net = net_of(spark, rows, presence=PRESENCE, observed=WATCHED)
    free, bound = S.surrogates(net, model, 3, 2, respect=()), S.surrogates(net, model, 3, 2)
    allowed = sum(map(outside, rows))
    assert allowed == 1 and max(sum(map(outside, r)) for r in drawn(free).values()) > 1
    for r in drawn(bound).values():
        assert sum(map(outside, r)) <= allowed
        assert Counter(x[2:4] for x in r) == Counter(x[2:4] for x in rows) and Counter(x[1] for x in r) == Counter(x[1] for x in rows)
        assert all(x[0] != x[1] for x in r)
    assert all(r["rejected"] > 0 for r in bound.report.collect())
    assert {r["rejected"] for r in bound.summary().collect()} == {r["rejected"] for r in bound.report.collect()}


@pytest.mark.parametrize("model", ["timeline", "edges"])
def test_whole_draws_are_rejected(spark, model):
    rows = [("A", "B", 0.0, 1.0, None), ("C", "D", 5.0, 6.0, None), ("E", "F", 5.0, 7.0, None)]
    net = net_of(spark, rows, presence=[("A", 0.0, 2.0)])
    got = S.surrogates(net, model, 4, 1, swaps=2)
    assert set(drawn(got)) == {1, 2, 3, 4}
    assert all(not outside(x, [("A", 0.0, 2.0)], ((0.0, 9.0),)) for r in drawn(got).values() for x in r)


def test_no_valid_draw(spark):
    rows = [(f"P{i}", f"Q{i}", float(i), float(i), None) for i in range(12)]
    only = net_of(spark, rows, presence=[(f"P{i}", float(i), float(i)) for i in range(12)])
    with pytest.raises(NoValidDraw):
        S.surrogates(only, "timeline", max_tries=1)
    with pytest.raises(NoValidDraw):
        S.surrogates(only, "times", max_tries=1)
    with pytest.raises(NoValidDraw):
        S.surrogates(net_of(spark, [("A", "B", 0.0, 4.0, None), ("C", "D", 6.5, 8.0, None)], observed=((0.0, 5.0), (6.0, 12.0))), "reversal")
    with pytest.raises(BadScope):
        S.surrogates(only, "edges", within="sender")


def test_names_and_reversal_carry_presence(spark, rows):
    net = net_of(spark, rows, presence=PRESENCE)
    got = S.surrogates(net, "labels", 2, 4)
    for i, r in drawn(got).items():
        there = [(p["node"], p["start"], p["end"]) for p in got.presence.filter(F.col("replicate") == i).collect()]
        assert sum(outside(x, there, ((0.0, 99.0),)) for x in r) == sum(outside(x, PRESENCE, ((0.0, 99.0),)) for x in rows)
        assert Counter(Counter(x[0] for x in r).values()) == Counter(Counter(x[0] for x in rows).values())
    back = S.surrogates(net, "reversal", transpose=True)
    hi = max(r[3] for r in rows) + min(r[2] for r in rows)
    assert Counter(drawn(back)[1]) == Counter((b, a, hi - e, hi - s, w) for a, b, s, e, w in rows)
    assert {(p["node"], p["start"], p["end"]) for p in back.presence.collect()} == {(v, hi - b, hi - a) for v, a, b in PRESENCE}


def test_places_do_not_depend_on_slices(spark):
    d = spark.range(500).select(F.lit(1).alias("replicate"), F.md5(F.col("id").cast("string")).alias("d"))
    places = lambda n: {r["d"]: r["k"] for r in S.ranked(d, ["replicate"], "d", "k", n).collect()}
    want = {x: i + 1 for i, x in enumerate(sorted(r["d"] for r in d.collect()))}
    assert places(1) == want and places(7) == want


def test_empty_network(spark):
    net = net_of(spark, [("A", "B", 0.0, 1.0, None)])
    empty = net.with_(spells=net.spells.limit(0))
    for model in ("times", "targets", "timeline", "edges", "labels"):
        assert S.surrogates(empty, model, 2).spells.isEmpty()


def test_repairs_carry_only_what_they_need(spark, rows, monkeypatch):
    kept, real = [], S.keep
    monkeypatch.setattr(S, "keep", lambda df, name, by=None: (kept.append((name, set(df.columns))), real(df, name, by))[1])
    got = drawn(S.surrogates(net_of(spark, rows), "targets", 2))
    rounds = [c for name, c in kept if name == "draws"]
    assert len(rounds) > 1 and not any(c & {"_id", "raw_id", "weight", "session"} for c in rounds)
    assert all(Counter((x[0], *x[2:]) for x in r) == Counter((x[0], *x[2:]) for x in rows) and all(x[0] != x[1] for x in r) for r in got.values())


@pytest.mark.parametrize("within", ["network", "session"])
def test_draws_do_not_depend_on_slices(spark, rows, within, monkeypatch):
    net = net_of(spark, rows)
    whole = {r: sorted(map(str, x)) for r, x in drawn(S.surrogates(net, "times", 3, 1, within)).items()}
    monkeypatch.setattr(S, "GROUP", 1)
    monkeypatch.setattr(S, "LEAST", 9)
    assert {r: sorted(map(str, x)) for r, x in drawn(S.surrogates(net, "times", 3, 1, within)).items()} == whole


@pytest.mark.parametrize("model", ["times", "targets"])
def test_what_a_slice_cannot_mend_is_mended_with_others(spark, rows, model, monkeypatch):
    monkeypatch.setattr(S, "GROUP", 1)
    monkeypatch.setattr(S, "LEAST", 4)
    passes = []
    monkeypatch.setattr(S._Draw, "dealt", lambda d, draws, moved, *columns, f=S._Draw.dealt: (passes.append("_row" in columns), f(d, draws, moved, *columns))[1])
    rows = [r for r in rows if not outside(r)]
    got = drawn(S.surrogates(net_of(spark, rows, presence=PRESENCE, observed=WATCHED), model, 2, 2))
    assert True in passes
    for r in got.values():
        assert not any(map(outside, r)) and all(x[0] != x[1] for x in r)
        assert Counter(x[2:4] for x in r) == Counter(x[2:4] for x in rows) and Counter(x[1] for x in r) == Counter(x[1] for x in rows) and Counter(x[0] for x in r) == Counter(x[0] for x in rows)


def test_draws_are_written_as_a_row_for_each_slice(spark, rows, monkeypatch):
    kept, real = [], S.keep
    monkeypatch.setattr(S, "keep", lambda df, name, by=None: (kept.append((name, real(df, name, by))), kept[-1][1])[1])
    drawn(S.surrogates(net_of(spark, rows, presence=PRESENCE), "targets", 2))
    assert [d.count() for name, d in kept if name == "draws"] == [2, 2]


def test_rounds_of_swaps_carry_numbers_only(spark, rows, monkeypatch):
    kept, real = [], S.keep
    monkeypatch.setattr(S, "keep", lambda df, name, by=None: (kept.append((name, dict(df.dtypes))), real(df, name, by))[1])
    drawn(S.surrogates(net_of(spark, rows), "edges", 2, swaps=2))
    rounds = [kinds for name, kinds in kept if name == "swaps"]
    assert len(rounds) > 1 and all(set(kinds.values()) <= {"int", "bigint"} for kinds in rounds)
