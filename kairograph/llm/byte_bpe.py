"""Byte-level BPE encoding and decoding with the tokenizers library.

The tokenizer is built from a rank file: every byte is mapped to a printable
character, and each token contributes every pair of tokens that joins to it, in
rank order, so that merging goes by the rank of the result.  Decoding reverses
the byte table; characters split over tokens come back whole because bytes are
joined before they are read as UTF-8.

Null texts are empty and have no ids.  Rows are encoded one by one.
"""

from __future__ import annotations

import base64
import codecs
import hashlib
import json
import os
from array import array
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from kairograph.llm.common import id_text, map_arrow
from kairograph.llm.pieces import PieceCache, cut, literal
from kairograph.llm.token_count import byte_symbols


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


@lru_cache(maxsize=4)
def tokenizer_json(path: str) -> str:
    """The definition of a tokenizer of the library with the ranks of ``path``."""
    ranks, table = load_ranks(path), byte_symbols()
    shown = {token: "".join(table[b] for b in token) for token in ranks}
    merges = [[shown[token[:i]], shown[token[i:]]] for token, _ in sorted(ranks.items(), key=lambda x: x[1]) for i in range(1, len(token)) if token[:i] in ranks and token[i:] in ranks]
    level = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": False, "use_regex": True}
    model = {"type": "BPE", "dropout": None, "unk_token": None, "continuing_subword_prefix": None, "end_of_word_suffix": None, "fuse_unk": False, "byte_fallback": False, "ignore_merges": False}
    model |= {"vocab": {shown[t]: r for t, r in ranks.items()}, "merges": merges}
    return json.dumps({"version": "1.0", "truncation": None, "padding": None, "added_tokens": [], "normalizer": None, "pre_tokenizer": level, "post_processor": None, "decoder": level, "model": model})


def make_tokenizer(definition: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # one thread to each task
    from tokenizers import Tokenizer

    return Tokenizer.from_str(definition)


class ByteBpe:
    """Encoder and decoder of one rank file."""

    def __init__(self, definition: str):
        self.tokenizer = make_tokenizer(definition)
        back = {c: b for b, c in enumerate(byte_symbols())}
        vocab = self.tokenizer.get_vocab()
        self.bytes_of: list[bytes] = [b""] * (max(vocab.values(), default=-1) + 1)
        for token, i in vocab.items():
            self.bytes_of[i] = bytes(back[c] for c in token)
        self.model, self.shown = self.tokenizer.model, dict(enumerate(byte_symbols()))
        self.cache = PieceCache(self._pieces)

    def _pieces(self, pieces: list[str]) -> list[bytes]:
        """A space and letters are one word for the model; other pieces go through the whole tokenizer."""
        tokenize, shown = self.model.tokenize, self.shown
        mixed = [p for p in pieces if not p.isalpha()]
        ids = dict(zip(mixed, self._encode([literal(p) for p in mixed]), strict=True))
        space = shown[32]

        def word(p: str) -> bytes:
            p = space + (p if p.isascii() else p.encode().decode("latin-1").translate(shown))
            return array("I", [t.id for t in tokenize(p)]).tobytes()

        return [word(p) if p.isalpha() else ids[p] for p in pieces]

    def _encode(self, texts: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of whole texts."""
        halves = [cut(t) for t in texts]
        heads = self._encode([first for first, _ in halves])
        rests = self.cache.each([rest for _, rest in halves], b"".join)
        return [np.frombuffer(a + b, "<u4") for a, b in zip(heads, rests, strict=True)]

    def decode_bytes(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))

    def decode(self, ids: Iterable[int]) -> str:
        return self.decode_bytes(ids).decode("utf-8", "replace")

    def decode_stream(self, ids: Iterable[int]) -> Iterator[str]:
        """Text as it becomes known: bytes of a character split over tokens wait for the rest."""
        reader = codecs.getincrementaldecoder("utf-8")("replace")
        for i in ids:
            yield reader.decode(self.bytes_of[i])
        yield reader.decode(b"", True)

    def offsets(self, text: str, ids: np.ndarray) -> np.ndarray:
        """Half-open character span of each token; tokens that share a character share its place."""
        raw = np.frombuffer(text.encode(), np.uint8)
        begins = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])  # characters begun before each byte
        ends = np.cumsum([len(self.bytes_of[i]) for i in ids.tolist()], dtype=np.int64)
        starts = np.concatenate([[0], ends[:-1]]) if len(ends) else ends
        first = begins[np.minimum(starts + 1, len(raw))] - 1 if len(ends) else ends
        return np.stack([first, begins[ends]], axis=1) if len(ends) else np.empty((0, 2), np.int64)


@lru_cache(maxsize=2)
def encoder_of(definition: str) -> ByteBpe:
    """One encoder for all tasks of a worker, whose remembered pieces they share."""
    return ByteBpe(definition)


def encode_documents(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, ids array<int>, offsets array<struct<start,end>>, decoded`` of every document."""
    definition = docs.sparkSession.sparkContext.broadcast(tokenizer_json(path))  # a vocabulary: a few MB whatever the input
    span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))

    def make():
        bpe = encoder_of(definition.value)

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            ids = bpe.encode(texts)
            spans = [[{"start": a, "end": b} for a, b in bpe.offsets(t, x).tolist()] for t, x in zip(texts, ids, strict=True)]
            return pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([x.tolist() for x in ids], pa.list_(pa.int32())), pa.array(spans, span), pa.array([bpe.decode(x.tolist()) for x in ids], pa.string())],
                ["doc_id", "ids", "offsets", "decoded"],
            )

        return step

    src = id_text(docs, id_col, text_col)
    return map_arrow(src, make, f"doc_id {src.schema['doc_id'].dataType.simpleString()}, ids array<int>, offsets array<struct<start:int,end:int>>, decoded string")


def encode_digest(docs: DataFrame, path: str) -> DataFrame:
    """The contract's columns: ids of the encoder and bytes of the decoder, as digests."""
    definition = docs.sparkSession.sparkContext.broadcast(tokenizer_json(path))

    def make():
        bpe = encoder_of(definition.value)

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            ids = [x.tolist() for x in bpe.encode([t or "" for t in batch.column(1).to_pylist()])]
            sha = lambda raw: hashlib.sha256(raw).hexdigest()
            return pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(x) for x in ids], pa.int64()), pa.array([sha(" ".join(map(str, x)).encode()) for x in ids], pa.string()), pa.array([sha(bpe.decode_bytes(x)) for x in ids], pa.string())],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

        return step

    src = id_text(docs)
    return map_arrow(src, make, f"doc_id {src.schema['doc_id'].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string")
