"""Benchmark decontamination over a positional inverted index, sharded by document.

Every shard (a run of documents with about ``SHARD_BYTES`` of text) stores the
postings of all its tokens: for each term the ascending positions at which it
occurs, one position being left free between documents.  The index is a table in
the shared folder and serves any number of searches.  Queries go to all shards,
as in any distributed index, so no posting list is gathered in one place and a
frequent term harms nobody.  A
phrase starts from the list of its rarest term; the other lists, moved by their
offsets, are intersected with it from rare to frequent.  A phrase with a term
that the shard lacks is dropped before any list is touched.

Benchmark items reach the shards in blocks of at most ``BLOCK_BYTES`` of text,
each block being broadcast; more items mean more blocks, and hits of one
document are united over blocks.

A text of any length lies in one shard, which it may fill alone; memory grows in
proportion to it.  Null texts have no words.  A document row is judged by itself (repeated rows
give repeated results); a null ``doc_id`` is passed through.  Items with a null
id or without words take no part; repeated item ids count once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kairograph.llm.common import binary, id_text, materialize

WINDOW = 10
BLOCK_BYTES = 1 << 20
SHARD_BYTES = 2 << 20
_WORDS = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words(raw: bytes | None) -> list[bytes]:
    """Lower-cased words of ASCII letters, digits and everything beyond ASCII."""
    return raw.translate(_WORDS).split() if raw else []


class Phrases:
    """Distinct windows of a block of items as rows of term numbers."""

    def __init__(self, items: list[tuple[str, bytes | None]], window: int = WINDOW):
        self.names, self.terms = sorted({i for i, _ in items}), {}
        number = {name: k for k, name in enumerate(self.names)}
        found: dict[tuple[int, ...], set[int]] = {}
        for name, raw in items:
            ids = [self.terms.setdefault(w, len(self.terms)) for w in words(raw)]
            for start in range(max(1, len(ids) - window + 1) if ids else 0):
                found.setdefault(tuple(ids[start : start + window]), set()).add(number[name])
        self.width = max(map(len, found), default=1)
        self.table = np.array([list(p) + [-1] * (self.width - len(p)) for p in found], np.int64).reshape(-1, self.width)
        self.lengths = (self.table >= 0).sum(1)
        self.owners = list(map(sorted, found.values()))


class Postings:
    """The positional index of one shard: terms of the queries only, all positions of each."""

    def __init__(self, docs: list[list[bytes]], terms: dict[bytes, int]):
        self.sizes = np.array([len(d) for d in docs], np.int64)
        self.bases = np.concatenate([[0], np.cumsum(self.sizes + 1)])  # one free position after each document
        self.stride = int(self.bases[-1]) + 1
        get, none = terms.get, len(terms)
        flat = np.fromiter((get(w, none) for d in docs for w in (*d, b"")), np.int64, self.stride - 1)
        kept = np.flatnonzero(flat != none)
        order = np.argsort(flat[kept].astype(np.int32), kind="stable")
        self.positions = kept[order]
        self._ready(np.bincount(flat[kept], minlength=none + 1))

    def _ready(self, counts: np.ndarray) -> None:
        self.counts = counts
        self.begins = np.concatenate([[0], np.cumsum(counts)])
        self.keys = np.repeat(np.arange(len(counts)), counts) * self.stride + self.positions  # ascending: by term, then position

    @classmethod
    def stored(cls, sizes: np.ndarray, names: bytes, counts: np.ndarray, positions: np.ndarray, terms: dict[bytes, int]) -> Postings:
        """The lists of the queries' terms out of a stored shard."""
        self = cls.__new__(cls)
        self.sizes = sizes.astype(np.int64)
        self.bases = np.concatenate([[0], np.cumsum(self.sizes + 1)])
        self.stride = int(self.bases[-1]) + 1
        ends = np.cumsum(counts, dtype=np.int64)
        own = np.full(len(terms) + 1, 0, np.int64)
        lists: list[np.ndarray] = [np.empty(0, np.int64)] * (len(terms) + 1)
        for i, name in enumerate(names.split()):
            if (t := terms.get(name)) is not None:
                own[t] = counts[i]
                lists[t] = positions[ends[i] - counts[i] : ends[i]]
        self.positions = np.concatenate(lists).astype(np.int64)
        self._ready(own)
        return self

    def occurs(self, terms: np.ndarray, positions: np.ndarray) -> np.ndarray:
        """Whether each position is in the list of its term."""
        if not len(self.keys):
            return np.zeros(len(terms), bool)
        wanted = terms * self.stride + positions
        at = np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1)
        return (self.keys[at] == wanted) & (positions >= 0)

    def find(self, phrases: Phrases, at_once: int = 1 << 20) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Phrase numbers and start positions of all exact occurrences."""
        table = phrases.table
        if not len(table) or not len(self.keys):
            return
        counts = np.where(table >= 0, self.counts[table], np.iinfo(np.int64).max)
        order = np.argsort(counts, axis=1, kind="stable")
        rarest = counts.min(1)
        alive = np.flatnonzero(rarest > 0)
        ends = np.cumsum(rarest[alive])
        for part in np.split(alive, np.searchsorted(ends, np.arange(at_once, ends[-1] if len(ends) else 0, at_once))):
            if not len(part):
                continue
            who = np.repeat(part, rarest[part])
            lead = order[part, 0]
            inside = np.arange(len(who)) - np.repeat(np.cumsum(rarest[part]) - rarest[part], rarest[part])
            starts = self.positions[np.repeat(self.begins[table[part, lead]], rarest[part]) + inside] - np.repeat(lead, rarest[part])
            for step in range(1, phrases.width):
                more = phrases.lengths[who] > step
                column = order[who, step]
                ok = ~more | self.occurs(np.where(more, table[who, column], 0), starts + column)
                who, starts = who[ok], starts[ok]
                if not len(who):
                    break
            if len(who):
                yield who, starts

    def near(self, terms: list[int], slop: int) -> list[tuple[int, int]]:
        """Shortest stretches ``[first, last]`` of at most ``slop`` words that hold every term.

        One stretch for each occurrence of the rarest term that has one.
        """
        terms = sorted(set(terms), key=lambda t: self.counts[t])
        lists = [self.positions[self.begins[t] : self.begins[t + 1]] for t in terms]
        if not lists or not len(lists[0]):
            return []
        out = []
        for p in lists[0].tolist():
            near = [x[np.searchsorted(x, p - slop + 1) : np.searchsorted(x, p + slop)].tolist() for x in lists[1:]]
            doc = int(np.searchsorted(self.bases, p, "right"))
            near = [[q for q in x if int(np.searchsorted(self.bases, q, "right")) == doc] for x in near]
            best = None
            for first in sorted({p, *(q for x in near for q in x if q <= p)}, reverse=True):
                last = max([p, *(min((q for q in x if q >= first), default=first + slop) for x in near)])
                if last - first < slop and (best is None or last - first < best[1] - best[0]):
                    best = first, last
            if best:
                out.append(best)
        return out

    def local(self, positions: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Document number and word number of positions."""
        doc = np.searchsorted(self.bases, positions, "right") - 1
        return doc, positions - self.bases[doc]


def item_blocks(items: DataFrame, limit: int = BLOCK_BYTES) -> Iterator[list[tuple[str, bytes | None]]]:
    """Items in blocks of bounded size, streamed through the driver one partition at a time."""
    block, held = [], 0
    rows = items.select(F.col("item_id").cast("string").alias("i"), F.col("text").cast("binary").alias("t")).filter("i is not null and t is not null").distinct()
    for row in rows.toLocalIterator():
        block.append((row["i"], bytes(row["t"])))
        held += len(row["t"])
        if held >= limit:
            yield block
            block, held = [], 0
    if block:
        yield block


INDEX = "sizes binary, terms binary, counts binary, positions binary"


def build_index(docs: DataFrame) -> DataFrame:
    """One row for each shard: ids and word counts of its documents, and the postings of its terms."""
    src = id_text(docs)
    kind = src.schema["doc_id"].dataType.simpleString()

    def shard(ids: list, texts: list[list[bytes]], id_type: pa.DataType) -> pa.RecordBatch:
        sizes = np.array([len(t) for t in texts], np.int32)
        number: dict[bytes, int] = {}
        of = number.setdefault
        flat = np.fromiter((of(w, len(number)) for t in texts for w in t), np.int32, int(sizes.sum()))
        place = np.arange(len(flat)) + np.repeat(np.arange(len(texts)), sizes)  # one free position after each document
        order = np.argsort(flat, kind="stable")
        columns = [sizes, b" ".join(number), np.bincount(flat, minlength=len(number)).astype(np.int32), place[order].astype(np.int32)]
        return pa.RecordBatch.from_arrays([pa.array([ids], pa.list_(id_type)), *[pa.array([c if isinstance(c, bytes) else c.tobytes()], pa.binary()) for c in columns]], ["doc_ids", "sizes", "terms", "counts", "positions"])

    def run(batches):
        ids, texts, held, id_type = [], [], 0, pa.int64()
        for batch in batches:
            id_type = batch.schema.field(0).type
            for i, raw in zip(batch.column(0).to_pylist(), binary(batch.column(1)), strict=True):
                ids.append(i)
                texts.append(words(raw))
                held += len(raw or b"")
                if held >= SHARD_BYTES:
                    yield shard(ids, texts, id_type)
                    ids, texts, held = [], [], 0
        if ids:
            yield shard(ids, texts, id_type)

    return src.mapInArrow(run, f"doc_ids array<{kind}>, {INDEX}")


def _opened(batch: pa.RecordBatch, terms: dict[bytes, int]) -> Iterator[tuple[list, Postings]]:
    for i in range(batch.num_rows):
        ids, sizes, names, counts, positions = (batch.column(k)[i] for k in range(5))
        read = lambda x: np.frombuffer(x.as_buffer(), np.int32)
        yield ids.as_py(), Postings.stored(read(sizes), names.as_py(), read(counts), read(positions), terms)


HITS = "n_words long, hits array<struct<start:int,end:int>>, items array<string>"


def phrase_hits(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """``doc_id, n_words, hits, items``: word stretches ``[start, end)`` hit, merged, and the items that hit.

    One row for each document row, however many blocks of items there are.
    """
    blocks = item_blocks(items)
    first, more = next(blocks, []), next(blocks, None)
    if more is not None:
        return united(docs, items, window)
    return search_phrases(materialize(build_index(docs), "postings"), first, window)


def search_phrases(index: DataFrame, block: list[tuple[str, bytes | None]], window: int = WINDOW) -> DataFrame:
    """Hits of one block of items in a stored index."""
    span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
    sent = index.sparkSession.sparkContext.broadcast(Phrases(block, window))  # BLOCK_BYTES of text at most
    kind = index.schema["doc_ids"].dataType.elementType.simpleString()

    def run(batches):
        phrases = sent.value
        for batch in batches:
            for ids, found in _opened(batch, phrases.terms):
                hits: list[list] = [[] for _ in ids]
                owners: list[set] = [set() for _ in ids]
                for who, starts in found.find(phrases):
                    doc, word = found.local(starts)
                    for d, p, s, n in zip(doc.tolist(), who.tolist(), word.tolist(), phrases.lengths[who].tolist(), strict=True):
                        hits[d].append((s, s + n))
                        owners[d].update(phrases.owners[p])
                merged = [[{"start": a, "end": b} for a, b in merge(h)] for h in hits]
                names = [[phrases.names[i] for i in sorted(o)] for o in owners]
                yield pa.RecordBatch.from_arrays([pa.array(ids, batch.schema.field(0).type.value_type), pa.array(found.sizes), pa.array(merged, span), pa.array(names, pa.list_(pa.string()))], ["doc_id", "n_words", "hits", "items"])

    return index.mapInArrow(run, f"doc_id {kind}, {HITS}")


def united(docs: DataFrame, items: DataFrame, window: int) -> DataFrame:
    """Hits over several blocks of items, united for each document.

    Documents are told apart by id and text, so each repeated row gets the hits
    of its text.
    """
    src = docs.select("doc_id", "text")
    keyed = src.select(F.struct("doc_id", F.sha2("text", 256).alias("h")).alias("doc_id"), "text").dropDuplicates(["doc_id"])
    parts, index = None, materialize(build_index(keyed), "postings")
    for block in item_blocks(items):
        part = search_phrases(index, block, window)
        parts = part if parts is None else parts.unionByName(part)

    one = F.array().cast("array<struct<start:int,end:int>>")

    def add(kept, s):
        last = F.try_element_at(kept, F.lit(-1))
        longer = F.struct(last["start"].alias("start"), F.greatest(last["end"], s["end"]).alias("end"))
        return F.when(last["end"] >= s["start"], F.concat(F.slice(kept, 1, F.greatest(F.size(kept) - 1, F.lit(0))), F.array(longer))).otherwise(F.concat(kept, F.array(s)))

    tidy = F.aggregate(F.array_sort(F.flatten(F.collect_list("hits"))), one, add)
    whole = parts.groupBy("doc_id").agg(F.first("n_words").alias("n_words"), tidy.alias("hits"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    left = src.select(F.struct("doc_id", F.sha2("text", 256).alias("h")).alias("key"), "doc_id")
    same = left["key"].eqNullSafe(whole["doc_id"])
    return left.join(whole, same).select(left["doc_id"], "n_words", "hits", "items")


def merge(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(set(spans)):
        if out and a <= out[-1][1]:
            out[-1] = out[-1][0], max(b, out[-1][1])
        else:
            out.append((a, b))
    return out


def contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """The contract's columns of every document."""
    hits = phrase_hits(docs, items, window)
    n_hit = F.aggregate("hits", F.lit(0).cast("long"), lambda a, s: a + (s["end"] - s["start"]))
    return hits.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.size("hits") > 0).alias("contaminated"))


def near_hits(docs: DataFrame, queries: list[str], slop: int) -> DataFrame:
    """Proximity: ``doc_id, query int, start, end`` of stretches of at most ``slop`` words with every word of a query.

    ``queries`` is a stated, bounded list of strings.
    """
    index = build_index(docs)
    kind = index.schema["doc_ids"].dataType.elementType.simpleString()

    def run(batches):
        terms: dict[bytes, int] = {}
        asked = [[terms.setdefault(w, len(terms)) for w in words(q.encode())] for q in queries]
        for batch in batches:
            for ids, found in _opened(batch, terms):
                rows = []
                for k, wanted in enumerate(asked):
                    for first, last in found.near(wanted, slop):
                        doc, word = found.local(np.array([first]))
                        rows.append((ids[int(doc[0])], k, int(word[0]), int(word[0]) + last - first + 1))
                columns = list(zip(*rows, strict=True)) or [(), (), (), ()]
                kinds = [batch.schema.field(0).type.value_type, pa.int32(), pa.int32(), pa.int32()]
                yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, kinds, strict=True)], ["doc_id", "query", "start", "end"])

    return index.mapInArrow(run, f"doc_id {kind}, query int, start int, end int")


def drop_contaminated(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """Documents without any hit, columns as before.

    The index of the documents is stored once and every block of items searches it.
    Rows are told apart by id and text: repeated rows stay or go together, a null text
    has no words and stays, and rows with a null id are judged like others.
    """
    keyed = docs.select(F.struct("doc_id", F.sha2("text", 256).alias("h")).alias("doc_id"), "text")
    index, gone = materialize(build_index(keyed), "postings"), None
    for block in item_blocks(items):
        hit = search_phrases(index, block, window).filter(F.size("hits") > 0).select("doc_id.*")
        gone = hit if gone is None else gone.unionByName(hit)
    if gone is None:
        return docs
    gone = gone.distinct().toDF("_id", "_h")
    return docs.join(gone, docs["doc_id"].eqNullSafe(F.col("_id")) & F.sha2(docs["text"], 256).eqNullSafe(F.col("_h")), "left_anti").select(docs.columns)
