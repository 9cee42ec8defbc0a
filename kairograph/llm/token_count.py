"""Token counts by heap-and-linked-list byte-pair merging, without identifiers.

A word starts as one symbol per byte, linked to its neighbours.  A heap holds
the adjacent pairs by rank; the lowest is popped and merged until none is left.
The count is the number of initial symbols less the merges made.

Null texts are empty and have no tokens.  Rows are counted one by one.
"""

from __future__ import annotations

import json
from functools import lru_cache
from heapq import heapify, heappop, heappush

import pyarrow as pa
from pyspark.sql import DataFrame

from kairograph.llm.common import id_text, map_arrow
from kairograph.llm.pieces import PieceCache, cut, literal

LIMIT = 1024


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    table, extra = [""] * 256, 0
    for b in range(256):
        if b in shown:
            table[b] = chr(b)
        else:
            table[b] = chr(256 + extra)
            extra += 1
    return table


class Merges:
    """The pairs of a byte-level vocabulary file by rank, on symbol numbers."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab = spec["model"]["vocab"]
        pairs = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        self.rank = {vocab[a] << 32 | vocab[b]: i for i, (a, b) in enumerate(pairs)}
        self.result = [vocab[a + b] for a, b in pairs]
        self.symbol = [vocab[c] for c in byte_symbols()]
        self.special = [t["content"] for t in spec["added_tokens"]]

    def length(self, raw: bytes) -> int:
        """How many symbols of one word are left once no ranked pair is adjacent."""
        n = len(raw)
        if n < 2:
            return n
        rank, result = self.rank.get, self.result
        ids = [*map(self.symbol.__getitem__, raw), -1]  # the end joins nothing
        after, before = [*range(1, n + 1), n], [*range(-1, n)]
        heap = []
        last = ids[0]
        for i in range(n - 1):
            now = ids[i + 1]
            if (r := rank(last << 32 | now)) is not None:
                heap.append(r << 32 | i)
            last = now
        heapify(heap)
        left = n
        while heap:
            top = heappop(heap)
            i, r = top & 0xFFFFFFFF, top >> 32
            a = ids[i]
            if a < 0 or rank(a << 32 | ids[j := after[i]]) != r:
                continue  # one of the two has been merged since
            ids[i] = a = result[r]
            ids[j] = -1
            left -= 1
            after[i] = k = after[j]
            before[k] = i
            if (r := rank(a << 32 | ids[k])) is not None:
                heappush(heap, r << 32 | i)
            if (h := before[i]) >= 0 and (r := rank(ids[h] << 32 | a)) is not None:
                heappush(heap, r << 32 | h)
        return left


class Counter:
    """Counts of texts under one vocabulary file."""

    def __init__(self, path: str, pattern: str):
        import regex

        self.merges = Merges(path)
        self.split = regex.compile(pattern).findall
        self.cache = PieceCache(lambda pieces: [self.piece(p) for p in pieces])
        special = self.merges.special
        self.marks = regex.compile("|".join(map(regex.escape, special))) if special else None

    def piece(self, piece: str) -> int:
        if piece.isalpha():  # a space and letters are one word
            return self.merges.length((" " + piece).encode())
        return self.plain(literal(piece))

    def plain(self, text: str) -> int:
        """Tokens of a string, without the cache of pieces."""
        length, split = self.merges.length, self.split
        if self.marks and "<" in text and (n := len(self.marks.findall(text))):
            return n + sum(length(w.encode()) for part in self.marks.split(text) for w in split(part))
        return sum(length(w.encode()) for w in split(text))

    def counts(self, texts: list[str]) -> list[int]:
        halves = [cut(t) for t in texts]
        return [self.plain(first) + n for (first, _), n in zip(halves, self.cache.each([x for _, x in halves], sum), strict=True)]


@lru_cache(maxsize=2)
def counter_of(path: str, pattern: str) -> Counter:
    """One counter for all tasks of a worker, whose remembered pieces they share."""
    return Counter(path, pattern)


def token_counts(docs: DataFrame, path: str, pattern: str, limit: int = LIMIT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` of every document."""

    def make():
        counter = counter_of(path, pattern)

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            counts = counter.counts(texts)
            return pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(t.encode()) for t in texts], pa.int64()), pa.array(counts, pa.int64()), pa.array([n > limit for n in counts])],
                ["doc_id", "n_bytes", "n_tokens", "over_limit"],
            )

        return step

    src = id_text(docs, id_col, text_col)
    return map_arrow(src, make, f"doc_id {src.schema['doc_id'].dataType.simpleString()}, n_bytes long, n_tokens long, over_limit boolean")
