"""Repeated substrings by the interval tree of enhanced suffix arrays.

A string of ``WINDOW`` bytes contains ``WINDOW - GRAM + 1`` grams; the smallest
hash among them is its anchor, the same wherever the string occurs.  Neighbouring
windows share anchors, so a document falls into runs of windows, each run with
one anchor and of about ``(WINDOW - GRAM) / 2`` windows.

1. Anchors: each block of documents sends each distinct anchor and whether several
   of its documents have it; a bucket of anchors answers which of them occur in
   more than one document (all rows of a document are in one block).
2. Runs: each block cuts out the bytes of its runs with such anchors, one copy of
   each distinct run with the least document that has it.
3. A bucket builds the suffix array of its runs with common-prefix lengths, and
   stack-scans it into the tree of common-prefix intervals.  An interval whose
   suffixes have different bytes before them is left-diverse: a maximal repeat.
   All members of an interval, not only neighbours, get its least document.
4. Each block looks up its runs again and finds the stretches of each document
   that a smaller document has too.

A block sends one entry for each distinct anchor or run however many copies it
holds, so copies and common passages are gathered before anything is shuffled,
and what a bucket holds is bounded by distinct content.

Texts are bytes of UTF-8; null is empty.  Matches stay inside one document and
one run; a longer repeat is a chain of overlapping ones, which the stretches of a
document join.  Rows with a null id keep all bytes and remove none.  Repeated
rows of one id do not remove each other.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kairograph.llm.common import id_text

WINDOW, GRAM = 50, 24
#: Windows of a run at most; text that repeats within itself has one anchor for long.
LONGEST = 64
#: Bytes of text in a block: as the root of the corpus, so that a block's entry for one
#: bucket holds many anchors and entries do not grow with the square of the corpus.
BLOCK_LEAST, BLOCK_MOST, ROOT = 4 << 20, 32 << 20, 1000
STEP = 1 << 15
_K = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xFF51AFD7ED558CCD)]
_BYTES = np.random.default_rng(5).integers(1, 1 << 63, 256, dtype=np.uint64)
_POWERS = {n: np.uint64(pow(0x9E3779B97F4A7C15, n, 1 << 64)) for n in (1, 2, 4, 8, 16)}


def window_anchors(raw: bytes, window: int = WINDOW) -> np.ndarray:
    """The anchor of the window at every start: the least hash of its grams."""
    if len(raw) < window:
        return np.empty(0, np.uint64)
    h, have, eight = _BYTES[np.frombuffer(raw, np.uint8)], 1, None
    while have < 16:  # polynomial hashes of 1, 2, 4, 8, 16 bytes, then 24
        h = h[:-have] * _POWERS[have] + h[have:]
        have *= 2
        eight = h if have == 8 else eight
    h = h[:-8] * _POWERS[8] + eight[16:]
    h ^= h >> np.uint64(29)
    h *= _K[3]
    h ^= h >> np.uint64(32)
    span, have, n = window - GRAM + 1, 1, len(raw) - window + 1
    while have * 2 <= span:
        h = np.minimum(h[:-have], h[have:])
        have *= 2
    return np.minimum(h[:n], h[span - have : span - have + n])


def runs(text: bytes, sizes: np.ndarray, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """String, first window, last window (exclusive) and anchor of every run of strings joined in ``text``.

    Places are those in ``text``; no run leaves its string.
    """
    begins = np.concatenate([[0], np.cumsum(sizes)])
    ends = np.maximum(begins[1:] - window + 1, begins[:-1])  # windows of a string start before this
    firsts, anchors, before = [], [], None
    for at in range(0, max(0, len(text) - window + 1), STEP):
        now = window_anchors(text[at : at + STEP + window - 1], window)
        new = np.empty(len(now), bool)
        new[0] = before is None or now[0] != before
        np.not_equal(now[1:], now[:-1], out=new[1:])
        low, high = np.searchsorted(begins, [at, at + len(now)])
        new[begins[low:high][sizes[low:high] > 0] - at if low < len(sizes) else []] = True
        before = now[-1]
        first = np.flatnonzero(new)
        firsts.append(first + at)
        anchors.append(now[first])
    if not firsts:
        return (*(np.empty(0, np.int64),) * 3, np.empty(0, np.uint64))
    first, anchor = np.concatenate(firsts), np.concatenate(anchors)
    which = np.searchsorted(begins, first, "right") - 1
    last = np.minimum(np.append(first[1:], len(text)), ends[np.minimum(which, len(sizes) - 1)])
    fine = first < last
    which, first, last, anchor = which[fine], first[fine], last[fine], anchor[fine]
    many = -(-(last - first) // LONGEST)
    step = LONGEST * (np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many))
    first, last = np.repeat(first, many) + step, np.repeat(last, many)
    return np.repeat(which, many), first, np.minimum(first + LONGEST, last), np.repeat(anchor, many)


class Intervals:
    """The enhanced suffix array of a set of strings and its common-prefix intervals.

    Suffixes of ``least`` bytes or more only.  ``previous`` is the byte before each
    suffix, -1 at the start of a string, which differs from every other.
    """

    def __init__(self, strings: list[bytes], least: int):
        sizes = np.array([len(s) for s in strings], np.int64)
        begins = np.concatenate([[0], np.cumsum(sizes)])
        text = np.frombuffer(b"".join(strings) + bytes(8), np.uint8)
        per = np.maximum(sizes - least + 1, 0)
        self.string = np.repeat(np.arange(len(strings)), per)
        self.offset = np.arange(len(self.string)) - np.repeat(np.cumsum(per) - per, per)
        place, rest = begins[self.string] + self.offset, sizes[self.string] - self.offset
        width = -(-int(sizes.max(initial=0)) // 8)
        words = np.ndarray((max(0, len(text) - 7),), ">u8", text.tobytes(), 0, (1,))
        keys = []
        for i in range(width):
            have = np.clip(rest - 8 * i, 0, 8)
            word = words[np.minimum(place + 8 * i, len(words) - 1)].astype(np.uint64)
            drop = ((8 - have) * 8).astype(np.uint64)
            keys.append(np.where(have == 0, np.uint64(0), (word >> (drop % np.uint64(64))) << (drop % np.uint64(64))))
        order = np.lexsort([rest, *keys[::-1]]) if width else np.empty(0, np.int64)
        self.string, self.offset, place, rest = self.string[order], self.offset[order], place[order], rest[order]
        self.previous = np.where(self.offset > 0, text[np.maximum(place - 1, 0)].astype(np.int16), -1)
        # Common prefix of each suffix with the one before it.
        n = len(order)
        self.common = np.zeros(n, np.int64)
        open_ = np.ones(max(n - 1, 0), bool)
        for key in keys:
            k = key[order]
            differ = k[1:] ^ k[:-1]
            hit = differ != 0
            same = np.sum([differ < np.uint64(1 << b) for b in range(0, 64, 8)], axis=0)
            self.common[1:] += np.where(open_, same, 0)
            open_ &= ~hit
        self.common[1:] = np.minimum(self.common[1:], np.minimum(rest[1:], rest[:-1]))

    def scan(self, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """``(length, first, last)`` of all intervals with a common prefix of ``least`` or more, children first."""
        long = np.flatnonzero(self.common >= least)
        sizes: list[int] = []
        firsts: list[int] = []
        lasts: list[int] = []
        stack: list[tuple[int, int]] = []
        before, height = -2, 0
        for i, now in zip(long.tolist(), self.common[long].tolist(), strict=True):
            if i != before + 1:  # a gap closes all
                while stack:
                    size, begin = stack.pop()
                    sizes.append(size), firsts.append(begin), lasts.append(before)
                height = 0
            begin = i - 1
            while height > now:
                size, begin = stack.pop()
                sizes.append(size), firsts.append(begin), lasts.append(i - 1)
                height = stack[-1][0] if stack else 0
            if height < now:
                stack.append((now, begin))
                height = now
            before = i
        while stack:
            size, begin = stack.pop()
            sizes.append(size), firsts.append(begin), lasts.append(before)
        return np.array(sizes, np.int64), np.array(firsts, np.int64), np.array(lasts, np.int64)

    def left_diverse(self, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """Which intervals have members that can not all be extended by one byte to the left."""
        p = self.previous
        change = np.concatenate([[0], np.cumsum((p[1:] != p[:-1]) | (p[1:] == -1))])
        return (change[last] > change[first]) | (p[first] == -1)

    def maximal(self, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The left-diverse intervals: maximal repeats with all their members."""
        size, first, last = self.scan(least)
        if not len(size):
            return size, first, last
        fine = self.left_diverse(first, last)
        return size[fine], first[fine], last[fine]


def _expand(begin: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which range, and the number, of all whole numbers in ranges."""
    which = np.repeat(np.arange(len(begin)), count)
    return which, np.arange(len(which)) - np.repeat(np.cumsum(count) - count, count) + begin[which]


def least_documents(strings: list[bytes], docs: np.ndarray, least: int) -> list[np.ndarray]:
    """For each string, the least document that has the window at each of its starts.

    Left-diverse intervals suffice: what lies in another one also lies in the
    left-diverse one it extends to.
    """
    per = np.array([max(0, len(s) - least + 1) for s in strings], np.int64)
    begins = np.concatenate([[0], np.cumsum(per)])
    flat = np.repeat(docs, per)
    tree = Intervals(strings, least)
    size, first, last = tree.maximal(least)
    if len(size):
        of = np.append(docs[tree.string], np.iinfo(np.int64).max)
        low = np.minimum.reduceat(of, np.stack([first, last + 1], 1).ravel())[::2]
        count = last - first + 1
        for part in np.split(np.arange(len(size)), np.flatnonzero(np.diff(np.cumsum(count) >> 20)) + 1):
            which, member = _expand(first[part], count[part])
            which = part[which]
            later = of[member] > low[which]
            which, member = which[later], member[later]
            back, place = _expand(begins[tree.string[member]] + tree.offset[member], size[which] - least + 1)
            np.minimum.at(flat, place, low[which[back]])
    return np.split(flat, begins[1:-1]) if strings else []


def _documents(t: pa.Table) -> tuple[list, list[bytes]]:
    """Ids and texts in an order that does not depend on how the rows of a block arrive."""
    t = t.take(pc.sort_indices(t, sort_keys=[("doc_id", "ascending"), ("raw", "ascending")]))
    return t["doc_id"].to_pylist(), [x or b"" for x in t["raw"].to_pylist()]


class _Block:
    """Documents of a block and their runs; rows without id have none."""

    def __init__(self, t: pa.Table, window: int, buckets: int):
        self.ids, self.raws = _documents(t)
        self.window, self.buckets = window, buckets
        rows = [i for i, d in enumerate(self.ids) if d is not None and len(self.raws[i]) >= window]
        self.text = b"".join([self.raws[i] for i in rows])
        sizes = np.array([len(self.raws[i]) for i in rows], np.int64)
        which, self.first, self.last, anchor = runs(self.text, sizes, window)
        self.row = np.array(rows, np.int64)[which]
        self.doc = np.array([self.ids[i] for i in rows], np.int64)[which]
        self.begin = np.concatenate([[0], np.cumsum(sizes)])[which]
        mixed = anchor * _K[1]
        bucket = (mixed >> np.uint64(33)) % np.uint64(buckets)
        self.key = bucket << np.uint64(32) | mixed & np.uint64(0xFFFFFFFF)  # bucket, then a mark of the anchor in it

    def cuts(self, key: np.ndarray) -> np.ndarray:
        """Where each bucket begins in ascending keys."""
        return np.searchsorted(key, np.arange(self.buckets + 1, dtype=np.uint64) << np.uint64(32))

    def distinct(self, shared: np.ndarray):
        """Distinct run strings with a shared mark by bucket, where they occur, and the least and greatest document of each."""
        at = np.searchsorted(shared, self.key)
        hit = np.flatnonzero(shared[np.minimum(at, len(shared) - 1)] == self.key) if len(shared) else np.empty(0, np.int64)
        hit = hit[np.argsort(self.key[hit], kind="stable")]
        number: dict[bytes, int] = {}
        of, text, more = number.setdefault, self.text, self.window - 1
        which = np.fromiter((of(text[a : b + more], len(number)) for a, b in zip(self.first[hit].tolist(), self.last[hit].tolist(), strict=True)), np.int64, len(hit))
        low = np.full(len(number), np.iinfo(np.int64).max)
        high = np.full(len(number), np.iinfo(np.int64).min)
        np.minimum.at(low, which, self.doc[hit])
        np.maximum.at(high, which, self.doc[hit])
        key = np.zeros(len(number), np.uint64)
        key[which] = self.key[hit]
        return list(number), hit, which, low, high, key


def _prepare(docs: DataFrame, blocks: int | None):
    """Rows with their block, and the number of blocks (and of buckets)."""
    src = id_text(docs).select("doc_id", F.col("text").cast("binary").alias("raw"))
    if blocks is None:
        size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        blocks = max(4, -(-size // min(BLOCK_MOST, max(BLOCK_LEAST, math.isqrt(ROOT * size)))))
    return src.select(F.pmod(F.xxhash64("doc_id"), F.lit(blocks)).cast("int").alias("block"), F.col("doc_id").cast("long"), "raw"), blocks


_WHOLE = pa.schema([("block", pa.int32()), ("bucket", pa.int32()), ("mark", pa.binary()), ("flag", pa.binary())])


def _covers(docs: DataFrame, window: int, blocks: int | None, finish, schema: str) -> DataFrame:
    src, count = _prepare(docs, blocks)
    src = src.repartition(count, "block")

    def anchors(t: pa.Table) -> pa.Table:
        b = _Block(t, window, count)
        order = np.lexsort([b.doc, b.key])
        k, d = b.key[order], b.doc[order]
        begin = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]])) if len(k) else np.empty(0, np.int64)
        many = d[begin] != d[np.append(begin[1:], len(k)) - 1] if len(k) else np.empty(0, bool)
        k = k[begin]
        mark, cuts = k.astype(np.uint32), b.cuts(k).tolist()
        rows = [(i, mark[x:y].tobytes(), np.packbits(many[x:y]).tobytes()) for i, (x, y) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)) if y > x]
        to, marks, flags = zip(*rows, strict=True) if rows else ((), (), ())
        return pa.table([pa.array([t["block"][0].as_py()] * len(rows), pa.int32()), pa.array(to, pa.int32()), pa.array(marks, pa.binary()), pa.array(flags, pa.binary())], schema=_WHOLE)

    def repeated(t: pa.Table) -> pa.Table:
        marks = [np.frombuffer(x, np.uint32) for x in t["mark"].to_pylist()]
        m = np.concatenate([np.unpackbits(np.frombuffer(x, np.uint8), count=len(a)) for x, a in zip(t["flag"].to_pylist(), marks, strict=True)])
        who, a = np.repeat(np.arange(len(marks)), [len(x) for x in marks]), np.concatenate(marks)
        order = np.argsort(a, kind="stable")
        x = a[order]
        begin = np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]]))
        times = np.diff(np.append(begin, len(x)))
        yes = np.zeros(len(a), bool)
        yes[order] = np.repeat((times > 1) | (np.maximum.reduceat(m[order], begin) > 0), times)
        sent = [(int(k), v) for k, v in zip(t["block"].to_pylist(), _split(a[yes], who[yes], len(marks)), strict=True) if v]
        bucket = t["bucket"][0].as_py()
        return pa.table({"block": pa.array([s[0] for s in sent], pa.int32()), "bucket": pa.array([bucket] * len(sent), pa.int32()), "shared": pa.array([s[1] for s in sent], pa.binary())})

    found = src.groupBy("block").applyInArrow(anchors, "block int, bucket int, mark binary, flag binary").repartition(count, "bucket").groupBy("bucket").applyInArrow(repeated, "block int, bucket int, shared binary").repartition(count, "block")

    def shared_of(t: pa.Table) -> np.ndarray:
        if not t.num_rows:
            return np.empty(0, np.uint64)
        parts = [np.frombuffer(x, np.uint32).astype(np.uint64) | np.uint64(b << 32) for b, x in zip(t["bucket"].to_pylist(), t["shared"].to_pylist(), strict=True)]
        return np.sort(np.concatenate(parts))

    def cut(left: pa.Table, right: pa.Table) -> pa.Table:
        """Of each bucket: marks, sizes (the top bit: several documents here), least documents and bytes of distinct runs."""
        rows = {n: [] for n in ("bucket", "block", "mark", "size", "low", "text")}
        if left.num_rows and right.num_rows:
            b = _Block(left, window, count)
            strings, _, _, low, high, key = b.distinct(shared_of(right))
            size = np.array([len(s) for s in strings], np.uint16) | ((high > low).astype(np.uint16) << 15)
            mark, cuts = key.astype(np.uint32), b.cuts(key).tolist()
            for i, (x, y) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
                if y > x:
                    rows["bucket"].append(i), rows["block"].append(left["block"][0].as_py()), rows["text"].append(b"".join(strings[x:y]))
                    for n, v in (("mark", mark), ("size", size), ("low", low)):
                        rows[n].append(v[x:y].tobytes())
        return pa.table({n: pa.array(v, pa.int32() if n in ("bucket", "block") else pa.binary()) for n, v in rows.items()})

    sent = src.groupBy("block").cogroup(found.groupBy("block")).applyInArrow(cut, "bucket int, block int, mark binary, size binary, low binary, text binary").repartition(count, "bucket")

    def trees(t: pa.Table) -> pa.Table:
        """Equal runs are one string with the least document of all; a tree over the strings of each mark that has several."""
        number: dict[bytes, int] = {}
        of, which = number.setdefault, []
        columns = [[np.frombuffer(x, kind) for x in t[n].to_pylist()] for n, kind in (("size", np.uint16), ("mark", np.uint32), ("low", np.int64))]
        row = np.repeat(np.arange(t.num_rows), [len(x) for x in columns[0]])
        size, mark, low = map(np.concatenate, columns)
        inside = np.concatenate([np.arange(len(x)) for x in columns[0]]).astype(np.uint32)
        for text, sizes in zip(t["text"].to_pylist(), columns[0], strict=True):
            ends = np.cumsum(sizes & 32767).tolist()
            which += [of(text[x:y], len(number)) for x, y in zip([0, *ends[:-1]], ends, strict=True)]
        strings, which = list(number), np.array(which, np.int64)
        docs = np.full(len(strings), np.iinfo(np.int64).max)
        np.minimum.at(docs, which, low)
        of_mark = np.zeros(len(strings), np.uint32)
        of_mark[which] = mark
        order = np.argsort(of_mark, kind="stable")
        group = np.concatenate([[0], np.cumsum(np.diff(of_mark[order]) != 0)])
        several = (np.bincount(group) > 1)[group]
        order, group = order[several], group[several]
        per = np.array([len(s) for s in strings], np.int64) - window + 1
        begins = np.concatenate([[0], np.cumsum(per)])
        flat = np.repeat(docs, per)
        weight = np.cumsum(per[order] + window) >> 18
        steps = np.flatnonzero(np.diff(group) != 0) + 1  # a tree holds whole groups, of about a quarter of a MB
        steps = steps[np.concatenate([[True], np.diff(weight[steps - 1]) > 0])] if len(steps) else steps
        for part in np.split(order, steps):
            if len(part):
                got = least_documents([strings[i] for i in part.tolist()], docs[part], window)
                _, place = _expand(begins[part], per[part])
                flat[place] = np.concatenate(got)
        # Stretches of one least document, then those of each place that a smaller document has.
        new = np.ones(len(flat), bool)
        new[1:] = flat[1:] != flat[:-1]
        new[begins[:-1]] = True
        start = np.flatnonzero(new)
        end = np.append(start[1:], len(flat))
        first = np.searchsorted(start, begins)
        place, stretch = _expand(first[which], (first[1:] - first[:-1])[which])
        less = (flat[start[stretch]] < low[place]) | ((flat[start[stretch]] == low[place]) & (size[place] > 32767))
        place, stretch = place[less], stretch[less]
        base = begins[which[place]]
        fields = (inside[place], (start[stretch] - base).astype(np.uint8), (end[stretch] - base).astype(np.uint8), flat[start[stretch]])
        cuts = np.searchsorted(row[place], np.arange(t.num_rows + 1)).tolist()
        rows = [(k, [f[x:y].tobytes() for f in fields]) for k, x, y in zip(t["block"].to_pylist(), cuts[:-1], cuts[1:], strict=True) if y > x]
        bucket = t["bucket"][0].as_py()
        out = {"block": pa.array([r[0] for r in rows], pa.int32()), "bucket": pa.array([bucket] * len(rows), pa.int32())}
        return pa.table(out | {n: pa.array([r[1][i] for r in rows], pa.binary()) for i, n in enumerate(("k", "a", "z", "low"))})

    back = sent.groupBy("bucket").applyInArrow(trees, "block int, bucket int, k binary, a binary, z binary, low binary")
    names = ("k", "a", "z", "low", "shared")
    none = lambda df: df.select("block", "bucket", *[F.col(n) if n in df.columns else F.lit(None).cast("binary").alias(n) for n in names])
    back = none(found).unionByName(none(back)).repartition(count, "block")

    def end(left: pa.Table, right: pa.Table) -> pa.Table:
        """Stretches of each document, merged."""
        spans = np.empty((0, 3), np.int64)
        asked = right.filter(right["shared"].is_valid())
        got = right.filter(right["k"].is_valid())
        if left.num_rows and got.num_rows:
            b = _Block(left, window, count)
            _, hit, which, _, _, key = b.distinct(shared_of(asked))
            cuts = b.cuts(key)
            read = lambda n, kind: np.concatenate([np.frombuffer(x, kind) for x in got[n].to_pylist()])
            many = [len(x) // 4 for x in got["k"].to_pylist()]
            k = read("k", np.uint32).astype(np.int64) + np.repeat(cuts[np.array(got["bucket"])], many)
            x, y, low = read("a", np.uint8).astype(np.int64), read("z", np.uint8).astype(np.int64), read("low", np.int64)
            order = np.argsort(which, kind="stable")
            places = np.searchsorted(which[order], np.arange(len(key) + 1))
            answer, at = _expand(places[k], places[k + 1] - places[k])
            h = hit[order[at]]
            later = low[answer] < b.doc[h]
            h, answer = h[later], answer[later]
            start = b.first[h] - b.begin[h]
            spans = merged(b.row[h], start + x[answer], start + y[answer] + window - 1)
            return finish(b.ids, b.raws, spans)
        return finish(*_documents(left), spans)

    return src.groupBy("block").cogroup(back.groupBy("block")).applyInArrow(end, schema)


def _split(values: np.ndarray, who: np.ndarray, n: int) -> list[bytes]:
    ends = np.searchsorted(who, np.arange(n + 1))
    return [values[ends[k] : ends[k + 1]].tobytes() for k in range(n)]


def merged(row: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """``[row, start, end]`` of the stretches of each row, those that touch made one, by row and start."""
    if not len(row):
        return np.empty((0, 3), np.int64)
    order = np.lexsort([start, row])
    row, start, end = row[order], start[order], end[order]
    shift = row * (int(end.max()) + 2)  # rows do not touch
    reach = np.maximum.accumulate(shift + end)
    new = np.flatnonzero(np.concatenate([[True], shift[1:] + start[1:] > reach[:-1]]))
    last = np.append(new[1:], len(row)) - 1
    return np.stack([row[new], start[new], reach[last] - shift[last]], 1)


def _by_row(spans: np.ndarray, rows: int) -> list[list[tuple[int, int]]]:
    out: list[list[tuple[int, int]]] = [[] for _ in range(rows)]
    for r, a, b in spans.tolist():
        out[r].append((a, b))
    return out


def removed_spans(docs: DataFrame, window: int = WINDOW, blocks: int | None = None) -> DataFrame:
    """``doc_id, spans array<struct<start,end>>``: the byte stretches to remove from every row."""
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def finish(ids: list, raws: list[bytes], spans: np.ndarray) -> pa.Table:
        rows = [[{"start": a, "end": b} for a, b in x] for x in _by_row(spans, len(ids))]
        return pa.table({"doc_id": pa.array(ids, pa.int64()), "spans": pa.array(rows, kind)})

    return _covers(docs, window, blocks, finish, "doc_id long, spans array<struct<start:long,end:long>>")


def removal_digest(docs: DataFrame, window: int = WINDOW, blocks: int | None = None) -> DataFrame:
    """The contract's columns of every document."""

    def finish(ids: list, raws: list[bytes], found: np.ndarray) -> pa.Table:
        rows = []
        for raw, spans in zip(raws, _by_row(found, len(ids)), strict=True):
            kept, at = hashlib.sha256(), 0
            for a, b in spans:
                kept.update(raw[at:a])
                at = b
            kept.update(raw[at:])
            rows.append((len(raw), sum(b - a for a, b in spans), len(spans), kept.hexdigest()))
        n, removed, many, sha = zip(*rows, strict=True) if rows else ((), (), (), ())
        return pa.table({"doc_id": pa.array(ids, pa.int64()), "n_bytes": pa.array(n, pa.int64()), "n_removed": pa.array(removed, pa.int64()), "n_spans": pa.array(many, pa.int64()), "kept_sha256": pa.array(sha, pa.string())})

    return _covers(docs, window, blocks, finish, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def maximal_repeats(texts: list[tuple[int, bytes]], least: int = WINDOW) -> list[tuple[int, list[tuple[int, int]]]]:
    """Maximal repeats of a bounded set of texts: length and all occurrences ``(doc_id, start)``.

    The scan that the buckets run, on whole texts; groups of one document alone are kept too.
    """
    tree = Intervals([raw for _, raw in texts], least)
    out = []
    for size, first, last in zip(*(x.tolist() for x in tree.maximal(least)), strict=True):
        out.append((size, sorted((texts[s][0], o) for s, o in zip(tree.string[first : last + 1].tolist(), tree.offset[first : last + 1].tolist(), strict=True))))
    return sorted(out, key=lambda x: (-x[0], x[1]))
