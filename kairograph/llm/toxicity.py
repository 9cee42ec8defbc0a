"""Toxicity by noisy-channel deobfuscation.

1. A character language model: counts of four characters in a row over all
   documents, letters folded to a-z and everything else to one boundary sign.
2. Restoring: stretches that may be disguised (words with a sign or digit at any
   place, three letters or more set apart by spaces or points, a letter twice or
   more in a row) become lattices whose edges are what each sign may stand for,
   itself included; a gap joins its letters or parts two words.  Viterbi decoding
   under the model picks the likeliest reading.  Other text is left as it is.
3. Scoring: words of the restored text, and their beginnings, are looked up in a
   lexicon learnt from labelled rows.  An entry's weight is the share of toxic
   rows among the training rows that hold it, drawn towards the overall share;
   only entries whose association with the label is beyond what the number of
   candidates would give by chance, and that explain toxic rows which no better
   entry explains, are kept.  The score is the largest weight.

The lexicon is fitted on at most ``TRAIN_ROWS`` labelled rows, chosen by a hash of
the id.  Labels of rows that are held out,
``crc32(doc_id) mod 3 = 1``, are never read.

Texts are read whole whatever their length; a reading keeps one back-pointer a sign
and state, and only short stretches and words are remembered.  Null and empty texts get the score of a text without entries.  Without usable
labels every score is 0.  Rows are scored one by one; null ids pass through.
"""

from __future__ import annotations

import math
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kairograph.llm.common import Batches, id_text, map_arrow, slices

THRESHOLD = 0.7
TRAIN_ROWS, PRIOR = 10_000, 2
LETTERS, SLICES, FAN = 27, 27, 64
EDGE = 26

#: What a sign or digit may stand for.
LEET = {"0": "o", "1": "il", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "il", "|": "il", "+": "t", "€": "e", "£": "l"}
#: Log-probabilities of the channel.
KEEP, SWAP, SAME_SIGN, SKIP_SIGN, SKIP_REPEAT, SKIP_DOUBLE, GAP = math.log(0.9), math.log(0.08), math.log(0.02), math.log(0.05), math.log(0.3), math.log(0.01), math.log(0.5)

_FOLD = {"à": "a", "á": "a", "â": "a", "ã": "a", "ä": "a", "å": "a", "ç": "c", "è": "e", "é": "e", "ê": "e", "ë": "e", "ì": "i", "í": "i", "î": "i", "ï": "i", "ñ": "n", "ò": "o", "ó": "o", "ô": "o", "õ": "o", "ö": "o", "ù": "u", "ú": "u", "û": "u", "ü": "u", "ý": "y", "ÿ": "y", "ß": "s"}
_CODES = np.full(256, EDGE, np.int32)
for _c in range(26):
    _CODES[97 + _c] = _c
for _k, _v in _FOLD.items():
    _CODES[ord(_k)] = ord(_v) - 97

_LETTER = "a-zà-öø-ÿ"
_SIGNS = re.escape("".join(LEET))
_GAPS = r" .*_\-"
_MIXED = re.compile(rf"(?<![\w{_SIGNS}])(?=[{_SIGNS}]*[{_LETTER}])(?=[{_LETTER}]*[{_SIGNS}])[{_LETTER}{_SIGNS}]+(?![\w{_SIGNS}])")
_SPACED = re.compile(rf"(?<![\w{_SIGNS}])(?=[{_SIGNS}{_GAPS}]*[{_LETTER}])[{_LETTER}{_SIGNS}](?:[{_GAPS}]+[{_LETTER}{_SIGNS}]){{2,}}(?![\w{_SIGNS}])")
_REPEATED = re.compile(rf"(?<!\w)[{_LETTER}]*([{_LETTER}])\1[{_LETTER}]*(?!\w)")
_UNIT = re.compile(rf"[{_GAPS}]+|.", re.DOTALL)
_WORD = re.compile(r"[^\W\d_]+")


def codes(text: str) -> np.ndarray:
    return _CODES[np.frombuffer(f" {text} ".lower().encode("latin-1", "replace"), np.uint8)]


def language_model(docs: DataFrame) -> np.ndarray:
    """Log-probabilities ``[three before, next]`` from counts over all documents.

    Tasks send their counts in slices that executors sum, ``FAN`` tasks at a time;
    the driver gets one table whose size is fixed by the alphabet.
    """
    from pyspark import TaskContext

    size = LETTERS**4

    def count(batches: Batches) -> Batches:
        total = np.zeros(size, np.int64)
        for batch in slices(batches):
            c = np.concatenate([codes(t) for t in batch.column(0).to_pylist() if t] or [np.empty(0, np.int32)])
            if len(c) > 3:
                total += np.bincount(((c[:-3] * LETTERS + c[1:-2]) * LETTERS + c[2:-1]) * LETTERS + c[3:], minlength=size)
        parts = [p.tobytes() for p in np.split(total, SLICES)]
        task = TaskContext.get().partitionId() // FAN
        yield pa.RecordBatch.from_arrays([pa.array([task] * SLICES, pa.int32()), pa.array(range(SLICES), pa.int32()), pa.array(parts, pa.binary())], ["task", "slice", "n"])

    def add(t: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(x, np.int64) for x in t["n"].to_pylist())
        return pa.table({"task": pa.array([t["task"][0].as_py() // FAN], pa.int32()), "slice": t["slice"][:1], "n": pa.array([total.tobytes()], pa.binary())})

    kind = "task int, slice int, n binary"
    sums = docs.select("text").mapInArrow(count, kind)
    tasks = docs.rdd.getNumPartitions()
    while True:
        sums = sums.groupBy("task", "slice").applyInArrow(add, kind)
        tasks = -(-tasks // FAN)
        if tasks <= 1:
            break
    rows = sums.collect()
    counts = np.concatenate([np.frombuffer(bytes(r["n"]), np.int64) for r in sorted(rows, key=lambda r: r["slice"])] or [np.zeros(size, np.int64)]).reshape((LETTERS,) * 4).astype(float)
    p = np.full(LETTERS, 1 / LETTERS)
    for axes in ((0, 1, 2), (0, 1), (0,), ()):  # each order is smoothed by the one below
        n = counts.sum(axis=axes)
        p = (n + 5 * p) / (n.sum(-1, keepdims=True) + 5)
    return np.log(p).astype(np.float32).reshape(LETTERS**3, LETTERS)


def viterbi(shown: str, model: list[float]) -> str:
    """The likeliest word behind the signs of one stretch; the earlier reading of equals.

    A state is the last three letters and the last sign; it holds its score and the
    chain of letters that leads to it.  ``model`` is the flat table of log-probabilities.
    """
    edge, size = (EDGE * LETTERS + EDGE) * LETTERS + EDGE, LETTERS**3
    best: dict[tuple[int, str], tuple[float, tuple | None]] = {(edge, ""): (0.0, None)}
    units = _UNIT.findall(shown)
    for k, c in enumerate(units):
        often = (units[max(0, k - 2) : k] + units[k + 1 : k + 3]).count(c) > 1
        fresh, again = edges(c, False, often), edges(c, True, often)
        following: dict[tuple[int, str], tuple[float, tuple | None]] = {}
        for (state, last), (score, word) in best.items():
            for letter, code, cost, moves in again if last == c else fresh:
                if letter:
                    at = state * LETTERS + code
                    key, value, chain = (at % size, c if moves else last), score + cost + model[at], (word, letter)
                else:
                    key, value, chain = (state, c if moves else last), score + cost, word
                old = following.get(key)
                if old is None or old[0] < value:
                    following[key] = value, chain
        best = following
    if not best:
        return shown
    top = -math.inf
    chain = None
    for (state, _), (score, word) in best.items():
        if (value := score + model[state * LETTERS + EDGE]) > top:
            top, chain = value, word
    out = []
    while chain:
        chain, letter = chain
        out.append(letter)
    return "".join(reversed(out))


@lru_cache(maxsize=4096)
def edges(c: str, again: bool, often: bool) -> list[tuple[str, int, float, bool]]:
    """What one sign of a lattice may stand for: letter (empty if it is left out), its code, cost, whether it becomes the last sign.

    ``again``: the last sign is the same one; ``often``: so are two of the four around it.
    """

    def one(letter: str, cost: float, moves: bool = True) -> tuple[str, int, float, bool]:
        return letter, int(_CODES[ord(letter[0])]) if letter and ord(letter[0]) < 256 else EDGE, cost, moves

    if c[0] in " .*_-":
        return [one("", GAP, False), one(c, GAP)]
    if c.isalpha():
        return [one(c, KEEP), *([one("", SKIP_REPEAT if often else SKIP_DOUBLE, False)] if again else [])]
    return [*(one(x, SWAP) for x in LEET.get(c, "")), one("", SKIP_SIGN, False), one(c, SAME_SIGN)]


class Restorer:
    """Readable text of disguised text; readings of stretches are remembered, boundedly."""

    def __init__(self, model: np.ndarray):
        self.model, self.known = model.ravel().tolist(), {}

    def read(self, found: re.Match) -> str:
        shown = found[0]
        word = self.known.get(shown)
        if word is None:
            if len(self.known) > 50_000:
                self.known.clear()
            word = viterbi(shown, self.model)
            if len(shown) <= 200:
                self.known[shown] = word
        return word

    def restore(self, text: str) -> str:
        """Lower-cased text with disguised stretches read."""
        text = text.lower()
        for pattern in (_SPACED, _MIXED, _REPEATED):
            text = pattern.sub(self.read, text)
        return text


def entries_of(word: str) -> list[str]:
    """A word and its beginnings of four to six letters."""
    return [word, *("^" + word[:n] for n in (4, 5, 6) if len(word) >= n)]


def held_out(doc_id):
    return F.crc32(doc_id.cast("string")) % 3 == 1


def learn(docs: DataFrame, labels: DataFrame, model, rows: int = TRAIN_ROWS) -> tuple[dict[str, float], float]:
    """Weights of lexicon entries, and the score of a text without any."""
    usable = labels.select(F.col("doc_id"), F.col("toxic").cast("int").alias("toxic")).filter("doc_id is not null and toxic is not null").filter(~held_out(F.col("doc_id")))
    chosen = usable.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    marked = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("text", "toxic")  # TRAIN_ROWS pairs at most

    def gather(batches: Batches) -> Batches:
        restorer = Restorer(model.value)
        for batch in slices(batches):
            counts: dict[str, list[int]] = {}
            for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                seen = {"", *(e for w in set(_WORD.findall(restorer.restore(text or ""))) for e in entries_of(w))}
                for e in seen:
                    counts.setdefault(e, [0, 0])[toxic] += 1
            yield pa.RecordBatch.from_arrays([pa.array(counts, pa.string()), pa.array([v[1] for v in counts.values()], pa.int64()), pa.array([v[0] for v in counts.values()], pa.int64())], ["e", "t", "c"])

    counts = marked.mapInArrow(gather, "e string, t long, c long").groupBy("e").agg(F.sum("t").alias("t"), F.sum("c").alias("c"))
    counts = counts.filter("t >= 2 or e = ''")
    total = counts.filter("e = ''").first()
    if total is None or not total["t"]:
        return {}, 0.0
    toxic, n = total["t"], total["t"] + total["c"]
    share = toxic / n
    candidates = counts.filter("e <> ''").count()
    log = lambda x, y: F.when(x > 0, x * F.log(x / y)).otherwise(0.0)
    t, c, size = F.col("t").cast("double"), F.col("c").cast("double"), (F.col("t") + F.col("c")).cast("double")
    gain = 2 * (log(t, size * share) + log(c, size * (1 - share)) + log(toxic - t, (n - size) * share) + log(n - toxic - c, (n - size) * (1 - share)))
    kept = counts.filter("e <> ''").filter(t / size > share).withColumn("gain", gain).filter(F.col("gain") > max(12.0, 2 * math.log(max(2, candidates))))
    found = kept.orderBy(F.desc("gain"), "e").collect()  # entries of TRAIN_ROWS rows that pass the test
    weight = {r["e"]: (r["t"] + PRIOR * share) / (r["t"] + r["c"] + PRIOR) for r in found}
    names = docs.sparkSession.sparkContext.broadcast(set(weight))

    def hold(batches: Batches) -> Batches:
        restorer = Restorer(model.value)
        for batch in slices(batches):
            texts = [t or "" for t, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) if toxic]
            rows = [sorted(names.value.intersection(e for w in set(_WORD.findall(restorer.restore(t))) for e in entries_of(w))) for t in texts]
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.list_(pa.string()))], ["e"])

    held = [r["e"] for r in marked.mapInArrow(hold, "e array<string>").collect()]  # toxic ones of TRAIN_ROWS rows
    clean = {r["e"]: r["c"] for r in found}
    held = [[e for e in x if weight[e] >= THRESHOLD] for x in held]  # weaker ones alone reject nothing
    return {e: weight[e] for e in cover(held, clean, share)}, 0.1 * share


def cover(held: list[list[str]], clean: dict[str, int], share: float) -> list[str]:
    """Entries that explain the toxic rows one after another.

    Each time the entry with the most evidence among rows not yet explained, less
    what its clean rows speak against it, is taken.  Words that come with an entry
    already taken, such as the rest of a text that has many copies, explain nothing
    more and stay out.
    """
    left = [set(x) for x in held]
    having: dict[str, set[int]] = {}
    for i, x in enumerate(left):
        for e in x:
            having.setdefault(e, set()).add(i)
    out, least = [], max(3, 0.002 * len(left))

    def evidence(e: str) -> float:
        t, c = len(having[e]), clean[e]
        p = (t + PRIOR * share) / (t + c + PRIOR)
        return max(0.0, t * math.log(p / share) + c * math.log((1 - p) / (1 - share))) if t >= least and p >= 0.5 else 0.0

    while having:
        best = max(having, key=lambda e: (evidence(e), len(e), e))
        if not evidence(best):
            break
        out.append(best)
        for i in having.pop(best):
            for e in left[i]:
                if e in having:
                    having[e].discard(i)
                    if not having[e]:
                        del having[e]
            left[i] = set()
    return out


def fit(docs: DataFrame, labels: DataFrame):
    """The model and the lexicon, as broadcasts of bounded size."""
    sc = docs.sparkSession.sparkContext
    model = sc.broadcast(language_model(docs))
    return model, sc.broadcast(learn(docs, labels, model))


class Scorer:
    def __init__(self, model: np.ndarray, learnt: tuple[dict[str, float], float]):
        self.restorer = Restorer(model)
        lexicon, self.base = learnt

        class Weights(dict):
            def __missing__(self, word: str) -> float:
                value = max((lexicon.get(e, 0.0) for e in entries_of(word)), default=0.0)
                if len(self) < 400_000 and len(word) <= 64:
                    self[word] = value
                return value

        self.weight = Weights().__getitem__

    def score(self, text: str | None) -> float:
        return max(self.base, max(map(self.weight, _WORD.findall(self.restorer.restore(text))), default=0.0)) if text else self.base


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, fitted=None, restored: bool = False) -> DataFrame:
    """``doc_id, held_out, score, predicted`` and, if asked for, the restored text."""
    model, learnt = fitted or fit(docs, labels)
    src = id_text(docs)

    def make():
        scorer = Scorer(model.value, learnt.value)

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            texts = batch.column(1).to_pylist()
            columns = [batch.column(0), pa.array([scorer.score(t) for t in texts], pa.float64())]
            if restored:
                columns.append(pa.array([None if t is None else scorer.restorer.restore(t) for t in texts], pa.string()))
            return pa.RecordBatch.from_arrays(columns, ["doc_id", "score", "restored"][: len(columns)])

        return step

    out = map_arrow(src, make, f"doc_id {src.schema['doc_id'].dataType.simpleString()}, score double" + ", restored string" * restored)
    more = ["restored"] * restored
    return out.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), *more)


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Documents with a score under ``threshold``, columns as before."""
    model, learnt = fit(docs, labels)
    at, names = docs.columns.index("text"), docs.columns

    def make():
        scorer = Scorer(model.value, learnt.value)

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            keep = [scorer.score(t) < threshold for t in batch.column(at).to_pylist()]
            return pa.RecordBatch.from_arrays(batch.columns, names).filter(pa.array(keep, pa.bool_()))

        return step

    return map_arrow(docs, make, docs.schema)
