"""Secret scans: keyword automaton, anchored expressions near hits, checksums.

An Aho-Corasick automaton over the ASCII-lower-cased text finds the keywords;
the expensive expressions are tried only where a keyword begins, never by
scanning.  Long hexadecimal runs have no keyword: a byte-class translation and
one substring search decide whether a text is looked at at all.  Tokens that
carry a checksum of their own are reported only if it is right.

Null texts are empty and have no spans.  Rows are scored one by one, so repeated
rows give repeated results, and a null ``doc_id`` is passed through.
"""

from __future__ import annotations

import re
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kairograph.llm.common import id_text, map_arrow

#: Kinds in the order that breaks ties between spans of one start.
KINDS = ("assign", "access", "hex", "github", "npm")
ASSIGN = re.compile(
    r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)",
    re.IGNORECASE | re.ASCII,
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
GITHUB = re.compile(r"gh[pousr]_([A-Za-z0-9]{30})([A-Za-z0-9]{6})(?![A-Za-z0-9])")
NPM = re.compile(r"npm_([A-Za-z0-9]{30})([A-Za-z0-9]{6})(?![A-Za-z0-9])")
KEYWORDS = {
    "password": "assign", "passwd": "assign", "secret": "assign", "token": "assign", "apikey": "assign", "api_key": "assign",
    "akia": "access", "ghp_": "github", "gho_": "github", "ghu_": "github", "ghs_": "github", "ghr_": "github", "npm_": "npm",
}
BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
_HEX_CLASS = bytes(ord("h") if chr(b) in "0123456789abcdef" else ord(".") for b in range(256))
_HEX_RUN = b"h" * 24

Span = tuple[str, int, int]


def checksum62(body: str) -> str:
    """CRC-32 of the token's body in base 62, six digits."""
    n, out = zlib.crc32(body.encode()), ""
    for _ in range(6):
        n, digit = divmod(n, 62)
        out = BASE62[digit] + out
    return out


def automaton():
    import ahocorasick

    found = ahocorasick.Automaton()
    for word, kind in KEYWORDS.items():
        found.add_word(word, (kind, len(word)))
    found.make_automaton()
    return found


def scan(text: str | None, keywords) -> list[Span]:
    """All spans ``(kind, start, end)`` of one text in code points, in order."""
    if not text:
        return []
    raw = text.encode()
    spans: list[Span] = []
    done = dict.fromkeys(KINDS, 0)  # matches of one kind do not overlap
    hits = [(end + 1 - n, kind) for end, (kind, n) in keywords.iter(raw.lower().decode())]
    for start, kind in sorted(hits):
        if start < done[kind]:
            continue
        if kind == "assign":
            if m := ASSIGN.match(text, start):
                done[kind] = m.end()
                if len(m[2]) >= 6:
                    spans.append((kind, start, m.end()))
        elif kind == "access":
            if m := ACCESS.match(text, start):
                done[kind] = m.end()
                if m.end() - start >= 20:
                    spans.append((kind, start, m.end()))
        elif (m := (GITHUB if kind == "github" else NPM).match(text, start)) and checksum62(m[1]) == m[2]:
            done[kind] = m.end()
            spans.append((kind, start, m.end()))
    if _HEX_RUN in raw.translate(_HEX_CLASS):
        spans += [("hex", m.start(), m.end()) for m in HEX.finditer(text)]
    return sorted(spans, key=lambda s: (s[1], KINDS.index(s[0])))


def secret_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: ``doc_id, spans array<struct<kind,start,end>>``."""
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))

    def make():
        keywords = automaton()

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            rows = [[{"kind": k, "start": a, "end": b} for k, a, b in scan(t, keywords)] for t in batch.column(1).to_pylist()]
            return pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, kind)], ["doc_id", "spans"])

        return step

    src = id_text(docs, id_col, text_col)
    return map_arrow(src, make, f"doc_id {src.schema['doc_id'].dataType.simpleString()}, spans array<struct<kind:string,start:int,end:int>>")


def secret_digest(docs: DataFrame) -> DataFrame:
    """The contract's columns of every document, derived from :func:`secret_spans`."""
    shown = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("spans", lambda s: s["kind"].isin("assign", "access", "hex"))
    return secret_spans(docs).select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(shown(base), 256).alias("base_sha256"), shown(F.col("spans")).alias("spans"))


def redact(text: str, spans: list[Span], mark: str = "[SECRET]") -> str:
    """``text`` with every maximal run of covered characters replaced by ``mark``."""
    out, at = [], 0
    for _, start, end in sorted(spans, key=lambda s: s[1]):
        if start >= at:
            out += [text[at:start], mark]
        at = max(at, end)
    return "".join([*out, text[at:]])


def redact_secrets(docs: DataFrame) -> DataFrame:
    """Every document with its secrets masked and ``n_chars`` recounted; columns as before.

    Null texts stay null.
    """
    at, names = docs.columns.index("text"), docs.columns

    def make():
        keywords = automaton()

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            texts = [t if not t or not (s := scan(t, keywords)) else redact(t, s) for t in batch.column(at).to_pylist()]
            columns = list(batch.columns)
            columns[at] = pa.array(texts, batch.schema.field(at).type)
            return pa.RecordBatch.from_arrays(columns, names)

        return step

    out = map_arrow(docs, make, docs.schema)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in names else out
