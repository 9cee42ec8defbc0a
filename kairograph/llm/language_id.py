"""Language of texts by error-correcting output codes over byte trigrams.

Every language has a codeword; each bit of the code splits the languages in two and
has a binary classifier, the log ratio of trigram frequencies of the two sides.
Frequencies are counted over all documents that may be learnt from.  A text's margins
are put on one scale by their means and variances over those documents, and decoding
weighs the loss of each bit by how often its classifier is right for the language
(loss-weighted decoding of Escalera, Pujol and Radeva).  A text whose second language
is nearly as near is flagged ambiguous.

Defined results: null text and text without a letter is ``und`` with score 0; so is
every text if nothing can be learnt; null ``doc_id`` is neither learnt from nor held
out; ties of languages go to the smaller name; repeated rows are rows, empty tables
give no rows, other columns are not read; whole texts are read, a very long one in
blocks.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kairograph.llm.common import Batches, binary, materialize, slices

#: Trigrams are hashed to so many numbers.
BUCKETS = 1 << 15
#: Bytes of a text looked up at once.
BLOCK = 1 << 20
UNKNOWN = "und"

_LETTERS = np.frombuffer(bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256)), np.uint8)


def trigrams(text: bytes) -> np.ndarray:
    """Bucket of every three bytes, between spaces; capital ASCII letters are small, other ASCII is a space."""
    b = _LETTERS[np.frombuffer(b" " + text + b" ", np.uint8)].astype(np.uint32)
    x = b[:-2] | b[1:-1] << np.uint32(8) | b[2:] << np.uint32(16)
    return (x[x != 0x202020] * np.uint32(2_654_435_761)) >> np.uint32(17)


def _blocks(text: bytes):
    for k in range(0, len(text), BLOCK):
        yield trigrams(text[k : k + BLOCK + 2] if k else text[: BLOCK + 2])


def codewords(n: int, seed: int = 7) -> np.ndarray:
    """``n`` rows of +1 and -1: all ways to split up to five languages, else the best of random codes of 10 log2 n bits."""
    if n <= 5:
        bits = range(1 << max(0, n - 1), (1 << n) - 1)
        return np.array([[1 if b >> (n - 1 - i) & 1 else -1 for b in bits] for i in range(n)]).reshape(n, -1)
    rng, best, found = np.random.default_rng(seed), -1, None
    width = math.ceil(10 * math.log2(n))
    for _ in range(200):
        code = np.where(rng.random((n, width)) < 0.5, -1, 1)
        if (np.abs(code.sum(0)) == n).any():
            continue
        apart = (width - code @ code.T) // 2
        least = apart[~np.eye(n, dtype=bool)].min()
        if least > best:
            best, found = least, code
    return found


def letters(text: str = "text") -> Column:
    return F.coalesce(F.regexp_like(F.col(text), F.lit(r"\p{L}")), F.lit(False))


@dataclass
class Model:
    """Languages, their codewords, and a weight for each trigram bucket and bit."""

    languages: list[str]
    code: np.ndarray
    weights: np.ndarray

    @classmethod
    def of(cls, counts: dict[str, np.ndarray]) -> Model:
        languages = sorted(counts)
        code = codewords(len(languages))
        share = np.array([(counts[x] + 0.5) / (counts[x].sum() + 0.5 * BUCKETS) for x in languages]).reshape(len(languages), BUCKETS)
        sides = [[np.log(share[code[:, b] == s].mean(0)) for s in (1, -1)] for b in range(code.shape[1])]
        return cls(languages, code, np.array([p - q for p, q in sides], np.float32).reshape(-1, BUCKETS).T.copy())

    def margins(self, text: bytes) -> np.ndarray:
        """Sums of log ratios, divided by the root of how many there are."""
        total, n = np.zeros(self.code.shape[1]), 0
        for found in _blocks(text):
            total += self.weights[found].sum(0, dtype=np.float64)
            n += len(found)
        return total / math.sqrt(max(n, 1))


@dataclass
class Scale:
    """Slope and middle of each bit's margin, and what each bit weighs for each language."""

    slope: np.ndarray
    middle: np.ndarray
    weight: np.ndarray

    @classmethod
    def of(cls, model: Model, rows: list) -> Scale:
        """From count, mean, variance and share of right signs of margins for each language and bit."""
        shape = model.code.shape
        n, mean, var, right = (np.zeros(shape) for _ in range(4))
        for r in rows:
            at = model.languages.index(r["lang"]), r["bit"]
            n[at], mean[at], var[at], right[at] = r["n"], r["mean"], r["var"], r["right"]
        there = n > 0
        side = lambda s, x: np.where(there & (model.code == s), x, 0).sum(0) / np.maximum(1, (there & (model.code == s)).sum(0))
        up, down = side(1, mean), side(-1, mean)
        spread = np.where(there, var, 0).sum(0) / np.maximum(1, there.sum(0)) + 1e-9
        weight = np.maximum(np.where(there, right, 0.5), 1e-3)
        return cls(np.maximum(up - down, 0) / spread, (up + down) / 2, weight / np.maximum(weight.sum(1, keepdims=True), 1e-9))

    def losses(self, model: Model, margins: np.ndarray) -> np.ndarray:
        """Loss of each text (row) for each language."""
        z = np.clip(self.slope * (margins - self.middle), -30, 30)
        return np.stack([(self.weight[k] * np.log1p(np.exp(-model.code[k] * z))).sum(1) for k in range(len(model.languages))], 1)


def _counts(learnable: DataFrame) -> dict[str, np.ndarray]:
    """Trigram counts of every language over all rows; a task holds one array for each language it meets."""
    schema = "lang string, salt int, counts binary"

    def count(batches: Batches) -> Batches:
        found: dict[str, np.ndarray] = {}
        for batch in slices(batches):
            for lang, text in zip(batch.column("lang").to_pylist(), binary(batch.column("text")), strict=True):
                into = found.setdefault(lang, np.zeros(BUCKETS, np.int64))
                for x in _blocks(text):
                    into += np.bincount(x, minlength=BUCKETS)
        for lang, c in found.items():
            yield pa.RecordBatch.from_arrays([pa.array([lang]), pa.array([0], pa.int32()), pa.array([c.tobytes()], pa.binary())], ["lang", "salt", "counts"])

    def add(pdf):
        total = sum(np.frombuffer(c, np.int64) for c in pdf["counts"])
        return pdf.head(1).assign(counts=[total.tobytes()])

    parts = learnable.select("lang", "text").mapInArrow(count, schema).withColumn("salt", F.floor(F.spark_partition_id() / 64).cast("int"))
    merged = parts.groupBy("lang", "salt").applyInPandas(add, schema).groupBy("lang").applyInPandas(add, schema)
    return {r["lang"]: np.frombuffer(r["counts"], np.int64).astype(float) for r in merged.collect()}


def languages(docs: DataFrame, folds: int = 4, held: int = 2, gap: float = 0.1) -> DataFrame:
    """``doc_id, held_out, lang_pred, score, second, ambiguous`` of every row.

    ``docs`` has ``doc_id, text, lang``; rows whose crc32 of the id leaves ``held`` by
    ``folds`` are not learnt from.  ``gap``: a text is ambiguous if the second
    language's loss is greater by less.
    """
    spark = docs.sparkSession
    rest = F.crc32(F.col("doc_id").cast("string")) % folds
    rows = docs.select("doc_id", "text", "lang", (F.coalesce(rest, F.lit(-1)) == held).alias("held_out"), letters().alias("lettered"))
    usable = (rest != held) & F.col("lang").isNotNull() & F.col("lettered")
    counts = _counts(rows.filter(usable))
    if not counts:
        return rows.select("doc_id", "held_out", F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(None).cast("string").alias("second"), F.lit(False).alias("ambiguous"))
    model = Model.of(counts)
    sent = spark.sparkContext.broadcast(model)

    def measure(batches: Batches) -> Batches:
        m = sent.value
        for batch in slices(batches):
            found = [m.margins(t) if use else None for t, use in zip(binary(batch.column("text")), batch.column("lettered").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "held_out", "lang")), pa.array([None if x is None else x.tolist() for x in found], pa.list_(pa.float64()))], ["doc_id", "held_out", "lang", "margins"])

    kind = dict(docs.dtypes)["doc_id"]
    with_lang = rows.select("doc_id", "held_out", F.when(usable, F.col("lang")).alias("lang"), "text", "lettered")
    stored = materialize(with_lang.mapInArrow(measure, f"doc_id {kind}, held_out boolean, lang string, margins array<double>"), "margins")
    each = stored.filter("lang is not null").select("lang", F.posexplode("margins").alias("bit", "m"))
    signs = spark.createDataFrame([(x, b, int(model.code[k, b])) for k, x in enumerate(model.languages) for b in range(model.code.shape[1])], "lang string, bit int, side int")
    right = F.avg((F.col("m") * F.col("side") > 0).cast("double"))
    moments = each.join(F.broadcast(signs), ["lang", "bit"]).groupBy("lang", "bit").agg(F.count("*").alias("n"), F.avg("m").alias("mean"), F.var_pop("m").alias("var"), right.alias("right"))
    scale = Scale.of(model, moments.collect())

    def decode(batches: Batches) -> Batches:
        m = sent.value
        names = np.array(m.languages, object)
        for batch in batches:
            margins = batch.column("margins").to_pylist()
            known = [i for i, x in enumerate(margins) if x is not None]
            lang, second, score, close = [UNKNOWN] * len(margins), [None] * len(margins), [0.0] * len(margins), [False] * len(margins)
            if known:
                loss = scale.losses(m, np.array([margins[i] for i in known]).reshape(len(known), -1))
                order = np.argsort(loss, 1, kind="stable")
                chance = np.exp((loss.min(1, keepdims=True) - loss) * m.code.shape[1])
                chance /= chance.sum(1, keepdims=True)
                for j, i in enumerate(known):
                    first = order[j, 0]
                    lang[i], score[i] = names[first], float(chance[j, first])
                    if len(names) > 1:
                        second[i] = names[order[j, 1]]
                        close[i] = bool(loss[j, order[j, 1]] - loss[j, first] < gap)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(second, pa.string()), pa.array(close, pa.bool_())], ["doc_id", "held_out", "lang_pred", "score", "second", "ambiguous"])

    return stored.select("doc_id", "held_out", "margins").mapInArrow(decode, f"doc_id {kind}, held_out boolean, lang_pred string, score double, second string, ambiguous boolean")
