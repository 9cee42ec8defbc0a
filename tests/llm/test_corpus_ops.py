"""Operators over a whole corpus against brute force."""

import hashlib
import random
import sys
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from kairograph.llm import near_dedup, permutation_index, substring_dedup, toxicity

SF = "/root/testdata/sf0.001"


def words(r, n, size=400):
    return " ".join(f"w{r.randrange(size)}" for _ in range(n))


def near_copies(seed=1):
    r = random.Random(seed)
    texts = [words(r, r.randint(1, 80)) for _ in range(40)]
    for _ in range(5):
        base = words(r, 120).split()
        for _ in range(12):
            other = list(base)
            for _ in range(r.randint(0, 5)):
                other[r.randrange(len(other))] = f"x{r.randrange(99)}"
            texts.append(" ".join(other))
    texts += [texts[3], texts[3].upper(), "", " \n", None, "one", "One", "one two", texts[50]]
    return texts


def _components(texts, size, percent):
    sets = []
    for t in texts:
        w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "").split()
        k = min(size, len(w))
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if w else set())
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {i: (len(sets[i]), find(i), find(i) == i) for i in range(len(texts))}


@pytest.mark.parametrize(("size", "threshold"), [(3, 0.85), (5, 0.8)])
def test_near_duplicates(spark, monkeypatch, size, threshold):
    texts = near_copies(size)
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    monkeypatch.setattr(near_dedup, "BLOCK", 4)
    got = {r["doc_id"]: tuple(r)[1:] for r in near_dedup.near_duplicates(d, size, threshold).collect()}
    assert got == _components(texts, size, round(threshold * 100))


def test_near_duplicate_edges(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert near_dedup.near_duplicates(none).count() == 0
    d = spark.createDataFrame([(1, "a b c", 1), (None, "a b c", 2), (2, None, 3), (1, "a b c", 4)], "doc_id long, text string, component_id int")
    got = sorted((str(r["doc_id"]), str(r["component_id"]), r["kept"]) for r in near_dedup.near_duplicates(d).collect())
    assert got == [("1", "1", True), ("1", "1", True), ("2", "2", True), ("None", "None", True)]
    assert near_dedup.keep_one(d).columns == d.columns and near_dedup.keep_one(d).count() == 4


def test_a_large_family_meets_its_hub_and_not_itself(spark):
    """20,000 near copies: the rows that tasks get grow with the family, not with its square."""
    base = [f"b{i}" for i in range(400)]
    rows = spark.range(20_000).select(F.col("id").alias("doc_id"), F.concat(F.lit(" ".join(base) + " u"), F.col("id").cast("string")).alias("text"))
    seen = spark.sparkContext.accumulator(0)
    plain = near_dedup._compare

    def counted(task, held, bar, percent):
        seen.add(len(held))
        return plain(task, held, bar, percent)

    near_dedup._compare = counted
    try:
        got = near_dedup.near_duplicates(rows)
        assert got.filter("kept").count() == 1 and got.agg(F.max("component_id")).first()[0] == 0
    finally:
        near_dedup._compare = plain
    assert 0 < seen.value < 1_000_000


def _removed(raws):
    first = {}
    for i, raw in enumerate(raws):
        for j in range(len(raw) - 49):
            first.setdefault(raw[j : j + 50], i)
    out = []
    for i, raw in enumerate(raws):
        gone = np.zeros(len(raw), bool)
        for j in range(len(raw) - 49):
            if first[raw[j : j + 50]] < i:
                gone[j : j + 50] = True
        edges = np.diff(np.concatenate([[0], gone.astype(int)]))
        kept = bytes(np.frombuffer(raw, np.uint8)[~gone])
        out.append((len(raw), int(gone.sum()), int((edges == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return out


def test_substrings(spark):
    r = random.Random(2)
    piece = [words(r, 14, 50) for _ in range(6)]
    texts = [" ".join(r.choice(piece) if r.random() < 0.4 else words(r, r.randint(1, 12)) for _ in range(r.randint(0, 6))) for _ in range(60)]
    texts += ["é" * 40, "x" * 200, "é" * 60, "x" * 120 + "y", None, "", texts[5], texts[5] + " more", "ab" * 90]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {x["doc_id"]: tuple(x)[1:] for x in substring_dedup.removal_digest(d, blocks=5).collect()}
    assert [got[i] for i in range(len(texts))] == _removed([(t or "").encode() for t in texts])
    spans = {x["doc_id"]: x["spans"] for x in substring_dedup.removed_spans(d).collect()}
    assert sum(s["end"] - s["start"] for v in spans.values() for s in v) == sum(v[1] for v in got.values())


def test_runs_have_the_same_numbers_in_any_order_of_rows():
    r = random.Random(5)
    rows = [(i, words(r, 20, 40).encode()) for i in range(6)] + [(2, b"x" * 90), (None, b"y" * 90), (4, None)]
    found = []
    for order in (rows, rows[::-1]):
        t = pa.table({"block": pa.array([0] * len(rows), pa.int32()), "doc_id": pa.array([x[0] for x in order], pa.int64()), "raw": pa.array([x[1] for x in order], pa.binary())})
        b = substring_dedup._Block(t, 50, 3)
        found.append(b.distinct(np.unique(b.key))[0])
    assert found[0] == found[1] and len(found[0]) > 6


def test_substring_edges(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert substring_dedup.removal_digest(none).count() == 0
    long = "abcdefghij" * 30
    d = spark.createDataFrame([(1, long, 1), (1, long, 1), (None, long, 2), (2, None, 3)], "doc_id long, text string, n_bytes int")
    got = sorted((str(x["doc_id"]), x["n_removed"]) for x in substring_dedup.removal_digest(d).collect())
    assert got == [("1", 0), ("1", 0), ("2", 0), ("None", 0)]


def test_runs_of_joined_strings_hold_every_window_once():
    r = random.Random(6)
    for _ in range(30):
        strings = [bytes(r.choice(b"abc") for _ in range(r.choice([0, 1, 49, 50, 51, 90, 300, 40000]))) for _ in range(r.randint(0, 6))]
        sizes = np.array([len(x) for x in strings], np.int64)
        text, begins = b"".join(strings), np.concatenate([[0], np.cumsum(sizes)])
        which, first, last, anchor = substring_dedup.runs(text, sizes, 50)
        got = [(w, i - begins[w]) for w, a, b in zip(which.tolist(), first.tolist(), last.tolist()) for i in range(a, b)]
        assert got == [(w, i) for w, x in enumerate(strings) for i in range(len(x) - 49)]
        for a, b, k in list(zip(first.tolist(), last.tolist(), anchor.tolist()))[:50]:
            assert {int(x) for x in substring_dedup.window_anchors(text[a : b + 49])} == {k} and b - a <= substring_dedup.LONGEST


def test_maximal_repeats():
    texts = [(0, b"xxabcdefyy"), (1, b"zzabcdefww"), (2, b"qabcdq")]
    got = substring_dedup.maximal_repeats(texts, 3)
    assert got == [(6, [(0, 2), (1, 2)]), (4, [(0, 2), (1, 2), (2, 1)])]


def test_interval_tree_against_windows():
    r = random.Random(5)
    for _ in range(80):
        strings = [bytes(r.choice(b"ab\x00") for _ in range(r.randint(3, 30))) for _ in range(r.randint(1, 6))]
        docs = np.array([r.randint(0, 5) for _ in strings], np.int64)
        low = {}
        for s, d in zip(strings, docs.tolist(), strict=True):
            for i in range(len(s) - 3):
                low[s[i : i + 4]] = min(low.get(s[i : i + 4], 99), d)
        for s, g in zip(strings, substring_dedup.least_documents(strings, docs, 4), strict=True):
            assert [low[s[i : i + 4]] for i in range(len(s) - 3)] == g.tolist()


def _exact(rows, k, every):
    fine = [(i, np.array(v, float)) for i, v in rows if i is not None and v is not None and len(v) == 8 and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    return {(q, r + 1): (i, s) for q, x in fine if q % every == 0 for r, (s, i) in enumerate((-a, b) for a, b in sorted((-float(x @ y), i) for i, y in fine if i != q)[:k])}


def test_neighbours_small_tables_are_exact(spark):
    r = np.random.default_rng(1)
    rows = [(i, [float(x) for x in r.normal(size=8)]) for i in range(300)]
    rows += [(i, rows[7][1]) for i in range(300, 360)]
    rows += [(400, None), (420, [0.0] * 8), (440, [float("nan")] * 8), (460, [1.0] * 5), (None, rows[1][1])]
    d = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {(x["query_id"], x["rank"]): (x["vec_id"], x["score"]) for x in permutation_index.neighbours(d, k=5, every=20).collect()}
    want = _exact(rows, 5, 20)
    assert got.keys() == want.keys()
    assert all(got[k][0] == want[k][0] and got[k][1] == pytest.approx(want[k][1]) for k in want)
    assert permutation_index.neighbours(d.limit(0)).count() == 0


def test_neighbour_recall(spark):
    d = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    got = permutation_index.neighbours(d).select("query_id", "vec_id").toPandas()
    x = d.toPandas()
    m = np.stack(x["embedding"].to_numpy()).astype(float)
    ids, where = x["vec_id"].to_numpy(), {v: i for i, v in enumerate(x["vec_id"])}
    hits = 0
    for q, g in got.groupby("query_id"):
        s = m @ m[where[q]]
        s[where[q]] = -np.inf
        hits += len(set(ids[np.argsort(-s)[:20]]) & set(g["vec_id"]))
    assert hits / len(got) >= 0.9


def test_neighbour_recall_of_random_vectors(spark, tmp_path):
    """51,282 random directions, the hardest case, against a scan of everything."""
    import pyarrow.parquet as pq

    r = np.random.default_rng(4)
    x = r.normal(size=(51_282, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    pq.write_table(pa.table({"vec_id": np.arange(len(x)), "embedding": pa.array(list(x), pa.list_(pa.float64())), "rank": ["x"] * len(x)}), tmp_path / "e.parquet")
    d = spark.read.parquet(str(tmp_path / "e.parquet"))
    got = permutation_index.neighbours(d).select("query_id", "vec_id").toPandas()
    assert len(got) == 20 * 2565
    s = x[::20] @ x.T
    s[np.arange(len(s)), np.arange(0, len(x), 20)] = -np.inf
    true = np.argpartition(-s, 20, axis=1)[:, :20]
    found = got.groupby("query_id")["vec_id"].agg(set)
    assert sum(len(set(t.tolist()) & found[20 * i]) for i, t in enumerate(true)) / len(got) >= 0.9


def test_neighbours_of_repeated_rows(spark):
    r = np.random.default_rng(2)
    v = [[float(a) for a in r.normal(size=4)] for _ in range(60)]
    rows = [(i % 40, v[i % 40], "x", 5) for i in range(200)]
    d = spark.createDataFrame(rows, "vec_id long, embedding array<double>, score string, rank int")
    got = permutation_index.neighbours(d, k=3).collect()
    assert len(got) == 6 and len({(x["query_id"], x["vec_id"]) for x in got}) == 6 and got[0].asDict().keys() == {"query_id", "rank", "vec_id", "score"}


def test_deobfuscation():
    texts = ["what an idiot and a stupid clown", "you are an idiot", "the stupid thing", "a clown is here"] * 50
    c = np.concatenate([toxicity.codes(t) for t in texts])
    n = np.bincount(((c[:-3] * 27 + c[1:-2]) * 27 + c[2:-1]) * 27 + c[3:], minlength=27**4).reshape(27**3, 27) + 0.01
    restore = toxicity.Restorer(np.log(n / n.sum(1, keepdims=True)).astype(np.float32)).restore
    assert restore("You 1d10t!") == "you idiot"
    assert restore("so s t u p i d, really") == "so stupid, really"
    assert restore("sttttupid") == "stupid"
    assert restore("c.l.o.w.n") == "clown"
    assert restore("plain text 123, v2 stays.") == "plain text 123, v2 stays."


def test_viterbi_is_the_best_of_all_readings():
    """Every reading of short lattices, scored by the same model, against the decoder."""
    r = random.Random(9)
    logs = np.log(np.random.default_rng(3).dirichlet(np.full(27, 0.3), size=27**3) + 1e-6).astype(np.float32)

    def readings(units, k=0, last="", state=(26 * 27 + 26) * 27 + 26, score=0.0, word=""):
        if k == len(units):
            yield score + float(logs[state, 26]), word
            return
        for letter, code, cost, moves in toxicity.edges(units[k], last == units[k], (units[max(0, k - 2) : k] + units[k + 1 : k + 3]).count(units[k]) > 1):
            sign = units[k] if moves else last
            if letter:
                yield from readings(units, k + 1, sign, (state * 27 + code) % 27**3, score + cost + float(logs[state, code]), word + letter)
            else:
                yield from readings(units, k + 1, sign, state, score + cost, word)

    for _ in range(150):
        shown = "".join(r.choice("abss10@$! .i") for _ in range(r.randint(1, 6)))
        every = list(readings(toxicity._UNIT.findall(shown)))
        top = max(s for s, _ in every)
        assert toxicity.viterbi(shown, logs.ravel().tolist()) in {w for s, w in every if s > top - 1e-4}


def test_very_long_disguises_are_read(spark):
    texts = ["what an idiot and a stupid clown", "you are an idiot", "the stupid thing"] * 100
    restore = toxicity.Restorer(toxicity.language_model(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))).restore
    got = restore("s t u p i d " * 400 + "end")
    assert got.count("stupid") > 300 and restore("1d10t " * 3000).count("idiot") == 3000


def test_common_disguises(spark):
    texts = ["what an idiot and a stupid clown", "you are an idiot", "the stupid thing", "all good books are free too", "i hate the hate", "an asshole"] * 200
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    restore = toxicity.Restorer(toxicity.language_model(d)).restore
    for shown, word in {"$tupid": "stupid", "1diot": "idiot", "@sshole": "asshole", "hat3": "hate", "idi07": "idiot", "stuupid": "stupid"}.items():
        assert restore(f"the {shown} thing") == f"the {word} thing"
    assert restore("so h  a - t  e it") == "so hate it"
    assert restore("s t u p i d i d i o t").split() == ["stupid", "idiot"]
    assert restore("h a t e") == "hate" and restore("y o u") == "you"
    assert restore("all good books are free too, 123 v2") == "all good books are free too, 123 v2"
    assert restore("stupid!").startswith("stupid") and len(restore("stupid!")) <= 7


def test_clean_rows_speak_against_an_entry():
    rows = [["loser", "^lose"]] * 20 + [["^lose"]] * 2
    assert toxicity.cover(rows, {"loser": 0, "^lose": 5}, 0.1) == ["loser"]
    copies = [["scum", "^vequ"]] * 10 + [["scum"]] * 5 + [["scum", "clown"]] * 9
    assert toxicity.cover(copies, {"scum": 0, "^vequ": 0, "clown": 0}, 0.1) == ["scum"]


def test_toxicity_held_out(spark):
    from kairograph.llm.common import table

    sf = "/root/testdata/sf0.1"
    d, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    got = toxicity.toxicity(d, labels).join(labels, "doc_id").filter("held_out")
    n = {(r["predicted"], r["toxic"]): r["count"] for r in got.groupBy("predicted", "toxic").count().collect()}
    caught, missed, wrong, fine = n.get((1, 1), 0), n.get((0, 1), 0), n.get((1, 0), 0), n.get((0, 0), 0)
    assert caught / (caught + missed) > 0.75 and wrong / (wrong + fine) < 0.02


def test_toxicity_edges(spark):
    d = spark.createDataFrame([(1, "idiot", "x"), (None, "idiot", "x"), (2, None, None), (3, "", "x")], "doc_id long, text string, score string")
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    got = toxicity.toxicity(d, labels)
    assert got.count() == 4 and got.agg(F.max("score")).first()[0] == 0
    assert toxicity.drop_toxic(d, labels).columns == d.columns
    assert toxicity.toxicity(d.limit(0), labels).count() == 0


def test_held_out_labels_are_not_read(spark):
    d = spark.createDataFrame([(i, "bad word" if i % 2 else "good word") for i in range(300)], "doc_id long, text string")
    true = spark.createDataFrame([(i, i % 2) for i in range(300)], "doc_id long, toxic int")
    lies = true.withColumn("toxic", F.when(toxicity.held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a = toxicity.toxicity(d, true).orderBy("doc_id").collect()
    assert a == toxicity.toxicity(d, lies).orderBy("doc_id").collect()
    assert sum(r["predicted"] for r in a) == 150


def test_pipeline(spark):
    sys.path.insert(0, str(Path(__file__).resolve().parents[2]))
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    seen = {r["doc_id"] for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns, name
        docs = spark.createDataFrame(out.collect(), out.schema)
        left = {r["doc_id"] for r in docs.collect()}
        assert left <= seen
        seen = left
    last = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert {r["doc_id"] for r in last.collect()} == seen == {r["doc_id"] for r in corpus_pipeline.run(spark, SF).collect()}
