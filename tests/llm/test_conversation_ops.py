"""Conversation repair and prefix trie against plain searches, language identification by held-out accuracy."""

import hashlib
import heapq
import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from kairograph.llm import conversation_repair as repair
from kairograph.llm import language_id, prefix_trie

SCHEMA = "conv_id long, turn long, role string, text string"
SPACE = " \t\n\x0b\x0c\r"
NEXT = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})


def digest(role, text):
    return hashlib.md5(f"{len(role)}:{role}{text}".encode()).digest()


def damage(rows):
    out = {}
    for c, t, r, x in rows:
        kind = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        into = out.setdefault(c, [])
        r, x = " " if r is None else r, " " if x is None else x
        x = "" if kind == 1 else "".join(a for a in x if a not in ".!?") if kind == 2 else x
        into += [(t, "user" if kind == 4 else r, x)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    return out


def cheapest(rows):
    """All edits by Dijkstra's search over cost, then letters."""
    rows = sorted(rows, key=lambda z: ((z[0] is not None, z[0] or 0), digest(z[1], z[2])))
    faults, seen = [], set()
    for _, r, x in rows:
        bare = x.rstrip(SPACE)
        faults.append("blank" if not bare else "duplicate" if (r, x) in seen else "truncated" if bare[-1] not in ".!?" else "")
        seen.add((r, x))
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:], strict=False))
    turns = [t for t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    heap, done = [(0, "", 0, 0, ())], set()
    while True:
        cost, audit, i, state, said = heapq.heappop(heap)
        if i == len(rows) and state in (0, 3):
            break
        if (i, state) in done:
            continue
        done.add((i, state))
        more = [(w, NEXT[state][w[0]]) for w in ("user", "assistant") if w[0] in NEXT[state]]
        for who, then in more:
            heapq.heappush(heap, (cost + 3, audit + "I", i, then, (*said, f"{who}:")))
        if i < len(rows):
            (_, r, x), f = rows[i], faults[i]
            heapq.heappush(heap, (cost + 4, audit + "D", i + 1, state, said))
            if f in ("", "truncated"):
                extra = 3 * (f == "truncated")
                if r[:1] in NEXT[state]:
                    heapq.heappush(heap, (cost + extra, audit + "K", i + 1, NEXT[state][r[:1]], (*said, f"{r}:{x}")))
                for who, then in more:
                    heapq.heappush(heap, (cost + 3 + extra, audit + "R", i + 1, then, (*said, f"{who}:{x}")))
    return gaps, *(faults.count(k) for k in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256("\n".join(said).encode()).hexdigest()


def odd_conversations(seed=1):
    r = random.Random(seed)
    rows = [(c, r.choice([None, i, i, i, i, r.randint(0, 9)]), r.choice(["system", "user", "assistant", "user", "assistant", "x", None, ""]), r.choice(["hi.", "yo", "no! ", "", None, " \n", "a?", f"t{i}.", f"ü{i}."])) for c in (None, *range(-3, 30)) for i in range(r.choice([1, 2, 3, 5, 8, 13, 60]))]
    return rows + [(40, i, "user", "the same.") for i in range(30)] + [(41, 3, "user", "again and again.")] * 20 + [(42, 0, "user", "long " * 30_000)]


@pytest.mark.parametrize("segment", [1, 7, 65_536])
def test_repair_is_the_cheapest(spark, monkeypatch, segment):
    monkeypatch.setattr(repair, "SEGMENT", segment)
    rows = odd_conversations()
    got = {x[0]: tuple(x)[1:] for x in repair.repair(repair.damaged(spark.createDataFrame(rows, SCHEMA))).collect()}
    assert got == {c: cheapest(v) for c, v in damage(rows).items()}


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 15), max_size=60), st.integers(0, 60))
def test_segments_join_as_one(codes, cut):
    codes = bytes(codes)
    whole = repair.walk(codes, 0, repair.END, True)
    a, b = codes[:cut], codes[cut:]
    goal = repair._goals([repair.matrix(a), repair.matrix(b)])[0]
    first, state, cost = repair.walk(a, 0, tuple(goal), False)
    second, _, rest = repair.walk(b, state, repair.END, True)
    assert (first + second, cost + rest) == (whole[0], whole[2])


def test_repair_of_empty_tables_and_other_columns(spark):
    assert repair.repair(repair.damaged(spark.createDataFrame([], SCHEMA))).count() == 0
    more = spark.createDataFrame([(1, 1, "user", "Hi.", "x", 5), (1, 2, "assistant", "Yes.", None, None)], SCHEMA + ", audit string, key long")
    got = repair.repair(repair.as_they_are(more)).first()
    assert (got["audit"], got["cost"], got["repaired_sha256"]) == ("KK", 0, hashlib.sha256(b"user:Hi.\nassistant:Yes.").hexdigest())


def trie(rows):
    found = {}
    for c, t, r, x in rows:
        if c is not None:
            found.setdefault(c, []).append(((t is not None, t or 0), digest(r or "", x or ""), (r or "", x or "")))
    found = {c: [z[2] for z in sorted(v)] for c, v in found.items()}
    rebuilt = {}
    for c, v in found.items():
        h = zlib.crc32(str(c).encode()) % 6
        rebuilt[c] = found.get(c - c % 100 if c >= 0 else c + -c % 100, [])[:h] + v[h:]
    nodes = {}
    for c, v in rebuilt.items():
        for d in range(len(v) + 1):
            nodes.setdefault(tuple(v[:d]), []).append(c)
    kids, leaves, saved = (dict.fromkeys(nodes, 0) for _ in range(3))
    for p in nodes:
        if p:
            kids[p[:-1]] += 1
    for p, m in nodes.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += kids[p] == 0
            saved[p[:d]] += (len(m) - 1) * len(p[-1][1]) if p else 0
    ends = lambda p, m: hashlib.sha256(",".join(str(c) for c in sorted(m) if len(rebuilt[c]) == len(p)).encode()).hexdigest()
    return sorted((min(m), len(p), min(nodes[p[:-1]]) if p else -99, len(m), kids[p], leaves[p], saved[p], ends(p, m)) for p, m in nodes.items())


def many_beginnings():
    r = random.Random(2)
    rows = [(c, r.choice([None, i, i, i, i, i, i]), "ua"[i % 2], r.choice(["hi", "yo", None]) if r.random() < 0.7 else "ä" * r.randint(0, 5)) for c in (None, -150, -105, *range(300), *r.sample(range(500, 900), 60)) if c != 200 for i in range(r.choice([1, 2, 3, 5, 8, 13]))]
    return rows + [(c, i, "u", "same") for c in range(1000, 1050) for i in range(7)] + [(2000, 1, "u", "twice")] * 3 + [(3000, i, "u", f"turn {i}") for i in range(700)] + [(3001, 1, "u", "long " * 30_000)]


@pytest.mark.parametrize("block", [2, 256])
def test_trie_is_that_of_all_beginnings(spark, monkeypatch, block):
    monkeypatch.setattr(prefix_trie, "BLOCK", block)
    monkeypatch.setattr(prefix_trie, "PIECE", 7)
    rows = many_beginnings()
    got = prefix_trie.prefix_trie(prefix_trie.rebuilt(spark.createDataFrame(rows, SCHEMA)))
    assert sorted(tuple(-99 if v is None else v for v in x) for x in got.collect()) == trie(rows)


def test_trie_of_empty_tables_and_other_columns(spark):
    assert prefix_trie.prefix_trie(prefix_trie.rebuilt(spark.createDataFrame([], SCHEMA))).count() == 0
    more = spark.createDataFrame([(7, 1, "user", "a", 5, 6), (7, 1, "user", "a", None, None), (7, 1, "user", "a", 1, 1)], SCHEMA + ", depth long, part long")
    got = prefix_trie.prefix_trie(prefix_trie.rebuilt(more)).collect()
    assert all(x["n_convs"] == 1 and x["n_leaves"] == 1 and x["saved_tokens"] == 0 for x in got)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 6), max_size=200), st.sampled_from([1, 2, 3, 8]))
def test_parentheses_close_where_a_stack_says(steps, block):
    bits, depth = [], 0
    for s in steps:
        down = min(s - 1, depth) if s else 0
        bits += [-1] * max(0, down) + [1]
        depth += 1 - max(0, down)
    if not bits:
        return
    old, prefix_trie.BLOCK = prefix_trie.BLOCK, block
    try:
        shard = prefix_trie.Parentheses(np.array(bits, np.int8))
        stack, close = [], {}
        for i, b in enumerate(bits):
            if b == 1:
                stack.append(i)
            else:
                close[stack.pop()] = i
        assert [shard.close(int(i)) for i in shard.opens] == [close.get(int(i), len(bits)) for i in shard.opens]
    finally:
        prefix_trie.BLOCK = old


DOCS = "doc_id long, text string, lang string"


def test_languages_that_are_held_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = language_id.languages(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in rows if r["held_out"]]
    assert len(rows) == docs.count() and {r["doc_id"] for r in held} == {r["doc_id"] for r in rows if zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2}
    assert sum(r["lang_pred"] == r["lang"] for r in held) >= 0.98 * len(held)
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_what_is_held_out_changes_nothing(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(150)
    key = "crc32(cast(doc_id as string)) % 4 = 2"
    from pyspark.sql import functions as F

    other = docs.withColumn("lang", F.when(F.expr(key), "xx").otherwise(F.col("lang")))
    assert sorted(map(tuple, language_id.languages(docs).collect())) == sorted(map(tuple, language_id.languages(other).collect()))


def test_languages_of_odd_texts(spark):
    rows = [(i, f"der die das und ist nicht {i}" if i % 2 else f"the and of that is not {i}", "de" if i % 2 else "en", 1.0) for i in range(60)]
    odd = [(100, None, "de", 0.0), (101, "", None, 0.0), (102, "12 34 !?", "en", 0.0), (None, "the and of", "zz", 0.0), (103, "der die das " * 120_000, None, 0.0), (103, "the of and", None, 0.0), (103, "the of and", None, 0.0), (104, "日本", None, 0.0)]
    docs = spark.createDataFrame(rows + odd, DOCS + ", score double")
    got = [(r["doc_id"], r["lang_pred"]) for r in language_id.languages(docs).collect()]
    assert len(got) == 68 and {x for i, x in got if i in (100, 101, 102)} == {"und"} and "zz" not in {x for _, x in got}
    assert sorted(x for i, x in got if i == 103) == ["de", "en", "en"]
    assert all(x == ("de" if i % 2 else "en") for i, x in got if i is not None and i < 60)
    unknown = language_id.languages(spark.createDataFrame([(1, "some words", None), (2, None, None)], DOCS)).collect()
    assert [(r["lang_pred"], r["score"]) for r in unknown] == [("und", 0.0)] * 2
    assert language_id.languages(spark.createDataFrame([], DOCS)).count() == 0
    one = language_id.languages(spark.createDataFrame([(1, "some words", "en"), (3, "other words", "en")], DOCS)).collect()
    assert {r["lang_pred"] for r in one} == {"en"}


@pytest.mark.parametrize("n", [1, 2, 3, 5, 6, 40])
def test_codewords_are_apart(n):
    code = language_id.codewords(n)
    apart = [(code[i] != code[j]).sum() for i in range(n) for j in range(i)]
    assert min(apart, default=1) >= max(1, code.shape[1] // 4)
    assert all(abs(c.sum()) < n for c in code.T) or n == 1
