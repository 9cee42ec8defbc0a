"""Document operators against libraries, brute force and exact round trips."""

import base64
import hashlib
import json
import random
import re
import zlib

import numpy as np
import public_tokenizers as P
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from kairograph.llm import byte_bpe, decontaminate, licenses, secrets, token_binary, token_count

ODD = ["", " ", "  a", "a  b", "a \n b", "\n\n x\t y ", "it's  don't 's we'll", "x\x1c y\x1d  z\x85 w\xa0 q", "日本語 テキスト 🎉🎉 é", "<|endoftext|> a <|endoftext|>", "a<|endoftext|>b   ", "12 345  6.7 -- ,,, \r\n \r\n", "word" * 500, "Ünïcode. Straße! ǅ İ ſ K"]


def fuzz(n=400, seed=3):
    r = random.Random(seed)
    return ["".join(r.choice(" \n\tabE1.,é'sß\x1c\xa0#%") for _ in range(r.randint(0, 14))) for _ in range(n)]


def docs(spark, texts, **more):
    rows = [(i, t) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string")


def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string")


def clashing(spark):
    """Null ids and texts, repeated rows, and columns with names of results."""
    return spark.createDataFrame([(1, "token = abcdef1", 5, "x"), (None, "a b", 6, "x"), (2, None, 7, None), (1, "token = abcdef1", 5, "x")], "doc_id long, text string, n_tokens long, spans string")


def tiktoken_reference():
    import tiktoken

    with open(P.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_byte_bpe_like_the_rank_library():
    want = tiktoken_reference()
    bpe = byte_bpe.ByteBpe(byte_bpe.tokenizer_json(P.path("byte_bpe_50k.tiktoken")))
    texts = ODD + fuzz()
    for text, ids in zip(texts, bpe.encode(texts), strict=True):
        ids = ids.tolist()
        assert ids == want.encode_ordinary(text)
        assert bpe.decode_bytes(ids) == text.encode() and "".join(bpe.decode_stream(ids)) == text
        spans = bpe.offsets(text, np.array(ids, "<u4"))
        assert len(spans) == len(ids) and (not len(spans) or (spans[0][0] == 0 and spans[-1][1] == len(text)))


def test_byte_bpe_query(spark):
    got = {r["doc_id"]: r for r in byte_bpe.encode_digest(docs(spark, ODD), P.path("byte_bpe_50k.tiktoken")).collect()}
    want = tiktoken_reference()
    for i, t in enumerate(ODD):
        ids = want.encode_ordinary(t)
        assert got[i]["n_tokens"] == len(ids)
        assert got[i]["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert got[i]["decoded_sha256"] == hashlib.sha256(t.encode()).hexdigest()
    full = byte_bpe.encode_documents(docs(spark, ODD[:9]), P.path("byte_bpe_50k.tiktoken")).orderBy("doc_id").collect()
    assert [r["decoded"] for r in full] == ODD[:9]
    assert byte_bpe.encode_digest(empty(spark), P.path("byte_bpe_50k.tiktoken")).count() == 0
    assert byte_bpe.encode_digest(clashing(spark), P.path("byte_bpe_50k.tiktoken")).count() == 4


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_ids_like_the_library_whatever_the_normaliser(name):
    from tokenizers import Tokenizer

    texts = [*ODD, *fuzz(100), "Hello World", "ÉTÉ\nIt'S", "x" * 100_000]
    with open(P.path(name)) as f:
        ids = token_binary.WordEncoder(f.read()).encode(texts)
    assert [np.frombuffer(b, "<u4").tolist() for b in ids] == [e.ids for e in Tokenizer.from_file(P.path(name)).encode_batch(texts, add_special_tokens=False)]


def test_counts_like_the_library(spark):
    from tokenizers import Tokenizer

    texts = ODD + fuzz()
    want = [len(e.ids) for e in Tokenizer.from_file(P.path("byte_bpe_50k.json")).encode_batch(texts, add_special_tokens=False)]
    assert token_count.Counter(P.path("byte_bpe_50k.json"), P.PATTERN).counts(texts) == want
    got = token_count.token_counts(docs(spark, texts), P.path("byte_bpe_50k.json"), P.PATTERN).orderBy("doc_id").collect()
    assert [r["n_tokens"] for r in got] == want and got[12]["n_bytes"] == 2000 and not got[0]["over_limit"]
    assert token_count.token_counts(clashing(spark), P.path("byte_bpe_50k.json"), P.PATTERN).filter("n_tokens = 0").count() == 1


def test_token_files(spark):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    texts = ODD + fuzz(300)
    want, at = {}, 0
    for i, e in enumerate(t.encode_batch(texts, add_special_tokens=False)):
        ids = [*e.ids, 1]
        want[i] = (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
    folder, manifest = token_binary.write_tokens(docs(spark, texts).repartition(3), P.path("word_bpe_49k.json"), 1)
    got = {r["doc_id"]: tuple(r)[1:] for r in token_binary.read_tokens(spark, folder).collect()}
    assert got == want and manifest.agg(F.sum("n_docs")).first()[0] == len(texts)
    system, root = token_binary.open_fs(folder)
    name = manifest.orderBy("first_doc").first()["file"]
    with system.open_input_stream(f"{root}/{name}") as f:
        raw = f.read()
    mark = raw[6:38]
    dictionary = b""
    if mark != bytes(32):
        with system.open_input_stream(f"{root}/{mark.hex()}.dict") as f:
            dictionary = f.read()
        with pytest.raises(ValueError):
            token_binary.ShardReader(raw, b"another")
    shard = token_binary.ShardReader(raw, dictionary)
    assert shard.doc_id(8) == 8 and len(shard.ids(8)) == want[8][1]
    with system.open_input_file(f"{root}/{name}") as f:
        seen = token_binary.ShardReader(f, dictionary)
        assert [x.tolist() for x in seen.scan(100)] == [shard.ids(i).tolist() for i in range(shard.n)]
    for df, n in ((empty(spark), 0), (clashing(spark), 4)):
        folder, _ = token_binary.write_tokens(df, P.path("word_bpe_49k.json"), 1)
        back = token_binary.read_tokens(spark, folder).orderBy("start").collect()
        assert len(back) == n and all(r["n_tokens"] >= 1 for r in back)


def _secrets(text):
    """Scanning the whole text with the plain expressions."""
    out = [("assign", m.start(), m.end()) for m in secrets.ASSIGN.finditer(text) if len(m[2]) >= 6]
    out += [("access", m.start(), m.end()) for m in secrets.ACCESS.finditer(text) if m.end() - m.start() >= 20]
    return out + [("hex", m.start(), m.end()) for m in re.finditer("[0-9a-f]+", text) if m.end() - m.start() >= 24]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["token", "TOKEN", "secret", "api_key", "apikey", "=", ":", " ", '"', "abcdef", "x1", "é", "İ", "AKIA", "ABCDEFGHIJKLMNOPQRST", "0123456789abcdef01234567", "ſecret", "\n", "passwd"]), max_size=12))
def test_secrets_like_plain_search(parts):
    text = "".join(parts)
    assert sorted(s for s in secrets.scan(text, secrets.automaton()) if s[0] in ("assign", "access", "hex")) == sorted(_secrets(text))


def test_secret_checksums(spark):
    body = "abcdefghijklmnopqrstuvwxyz0123"
    good, bad = f"ghp_{body}{secrets.checksum62(body)}", f"ghp_{body}000000"
    scan = lambda t: secrets.scan(t, secrets.automaton())
    assert scan(f"é {good}.") == [("github", 2, 42)] and scan(bad) == []
    text = 'x token = "secretvalue" y'
    assert secrets.redact(text, scan(text)) == 'x [SECRET]" y'
    out = secrets.secret_digest(clashing(spark)).collect()
    assert sorted(r["n_assign"] for r in out) == [0, 0, 1, 1]
    table = spark.createDataFrame([(1, text, "en", 25), (2, None, "en", None)], "doc_id long, text string, lang string, n_chars long")
    kept = secrets.redact_secrets(table).orderBy("doc_id").collect()
    assert kept[0]["text"] == 'x [SECRET]" y' and kept[0]["n_chars"] == 13 and kept[1]["text"] is None
    assert secrets.redact_secrets(table).columns == table.columns


def _contaminated(text, items, window=10):
    """Every window of every item against every place."""
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    hit, found = set(), set()
    for name, item in items:
        v = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in item or ""))
        size = min(window, len(v))
        for i in range(len(v) - size + 1 if v else 0):
            for j in range(len(w) - size + 1):
                if w[j : j + size] == v[i : i + size]:
                    hit.update(range(j, j + size))
                    found.add(str(name))
    return len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)


def test_contamination_like_brute_force(spark, monkeypatch):
    r = random.Random(1)
    word = lambda: r.choice(["a", "b", "c", "É", "d1"])
    items = [(i, " ".join(word() for _ in range(r.choice([1, 3, 9, 10, 12, 15])))) for i in range(12)] + [(3, "b a"), (99, None), (100, "...")]
    texts = [" ".join(word() for _ in range(r.randint(0, 40))) + "." for _ in range(60)] + [None, "", items[4][1] + "! " + items[5][1].upper()]
    table = spark.createDataFrame(items, "item_id long, text string")
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = {i: _contaminated(t, items) for i, t in enumerate(texts)}
    got = {x["doc_id"]: tuple(x)[1:] for x in decontaminate.contamination(d, table).collect()}
    assert got == want
    assert {x["doc_id"] for x in decontaminate.drop_contaminated(d, table).collect()} == {i for i, x in want.items() if not x[4]}
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", 40)
    monkeypatch.setattr(decontaminate.item_blocks, "__defaults__", (40,))
    got = {x["doc_id"]: tuple(x)[1:] for x in decontaminate.contamination(d, table).collect()}
    assert got == want


def test_contamination_edges(spark):
    items = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.contamination(clashing(spark), items).filter("contaminated").count() == 0
    assert decontaminate.contamination(empty(spark), items).count() == 0


def test_proximity(spark):
    d = spark.createDataFrame([(1, "x alpha y beta z"), (2, "alpha a b c d e beta"), (3, "beta alpha"), (4, "alpha"), (5, "beta")], "doc_id long, text string")
    got = sorted(tuple(r) for r in decontaminate.near_hits(d, ["Alpha beta"], 4).collect())
    assert got == [(1, 0, 1, 4), (3, 0, 0, 2)]


def test_licenses(spark):
    t = licenses.TEMPLATES
    changed = t["MIT-text"].replace("free of charge", "without any charge")
    texts = ["x " + t["MIT"] + " y", t["Apache-2.0"], changed, "the license of the work is not a license", None, "", t["CC-BY-NC-4.0"] + "\n" + t["GPL-3.0"]]
    got = {r["doc_id"]: r["matches"] for r in licenses.license_matches(docs(spark, texts)).collect()}
    names = {i: [m["license"] for m in v] for i, v in got.items()}
    assert names == {0: ["MIT"], 1: ["Apache-2.0"], 2: ["MIT-text"], 3: [], 4: [], 5: [], 6: ["CC-BY-NC-4.0", "GPL-3.0"]}
    m = got[0][0]
    assert texts[0][m["start"] : m["end"]] == "Released under the MIT License" and m["coverage"] == 1
    assert 0.9 < got[2][0]["coverage"] < 1
    assert licenses.license_digest(clashing(spark)).count() == 4 and licenses.license_digest(empty(spark)).count() == 0


def _whole_alignment(template, text):
    """The same scores over the whole table of places, without a band."""
    best = {}
    top = (0.0, 0, -1, -1)
    for i, word in enumerate(template):
        for j, other in enumerate(text):
            options = [(0.0, 0, -1, -1)]
            s, m, a, z = best.get((i - 1, j - 1), options[0])
            options.append((s + 1, m + 1, a if m else j, j) if word == other else (s - 0.25, m, a, z))
            for (x, y), cost in (((i - 1, j), 0.25), ((i, j - 1), licenses.GAP)):
                s, m, a, z = best.get((x, y), options[0])
                options.append((s - cost, m, a, z))
            best[i, j] = max(options, key=lambda o: o[0])
            if best[i, j][0] > top[0] + 1e-12:
                top = best[i, j]
    return top


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 4), min_size=1, max_size=8), st.lists(st.integers(1, 5), max_size=12))
def test_alignment_is_the_best_of_all(template, text):
    score, matched, first, last = licenses.align(template, text, -len(template), len(text))
    assert score == pytest.approx(_whole_alignment(template, text)[0], abs=1e-9)
    assert matched == 0 or (0 <= first <= last < len(text) and text[first] in template)


def test_license_candidates_lose_nothing_that_matches():
    """Against an alignment of every template with the whole text, without index or band."""
    r = random.Random(8)
    small = {n: licenses.TEMPLATES[n] for n in ("MIT", "CC-BY-4.0", "GPL-3.0", "ISC", "Zlib")}
    scanner = licenses.Scanner(small)
    filler = "lorem ipsum dolor sit amet consectetur adipiscing elit the license of this software".split()
    for _ in range(25):
        name = r.choice(sorted(small))
        w = small[name].split()
        for _ in range(r.randint(0, 2) if len(w) > 20 else 0):  # a shorter template has one fingerprint
            w[r.randrange(len(w))] = r.choice(filler)
        if r.random() < 0.5 and len(w) > 20:
            at = r.randrange(5, len(w) - 5)
            w[at:at] = [r.choice(filler) for _ in range(r.randint(7, 12))]
        text = " ".join([r.choice(filler) for _ in range(r.randint(0, 20))] + w + [r.choice(filler) for _ in range(r.randint(0, 20))])
        ids = [scanner.ids.get(x, 0) for x in licenses.words(text)]
        got = {n for n, *_ in scanner.scan(text)}
        t = scanner.names.index(name)
        want = _whole_alignment(scanner.texts[t], ids)[1]
        assert (name in got) == scanner.enough(t, want), (name, text)


def test_edited_and_quoted_licenses():
    scan = licenses.Scanner(licenses.TEMPLATES).scan
    w = licenses.TEMPLATES["MIT-text"].split()
    far = " ".join([*w[:40], *("and so on with many other words that nobody has asked for here at all".split()), *w[40:]])
    (m,) = [x for x in scan(far) if x[0] == "MIT-text"]
    assert m[1] > 0.95
    (m,) = [x for x in scan("it says " + " ".join(w[20:60]) + " end") if x[0] == "MIT-text"]
    assert 0.3 < m[1] < 0.8
    import time

    began = time.time()
    assert len(scan("\n".join([licenses.TEMPLATES["MIT"]] * 8000))) == 8000 and time.time() - began < 20


def test_json_of_tokenizer_is_whole():
    spec = json.loads(byte_bpe.tokenizer_json(P.path("byte_bpe_50k.tiktoken")))
    assert len(spec["model"]["vocab"]) == 50256
