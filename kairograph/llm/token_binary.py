"""Token ids as binary shards: one shared zstandard dictionary, one frame per document.

File layout (little-endian), one file per range of ``doc_id``::

    magic  b"KTOK1\\0"   6 bytes
    dictionary hash      32 bytes  SHA-256 of the dictionary (zeros: none)
    width                uint16    bytes of an id, 2 or 4
    documents            uint64
    offset index         (documents + 1) x uint64, from the first frame
    token index          (documents + 1) x uint64, tokens before each document
    document ids         documents x (uint8 known, int64 id)
    frames               zstandard, one for each document

A document is read by two look-ups and one small decompression.  The dictionary
is trained on the serialised ids of a bounded sample (``SAMPLE`` documents,
``SAMPLE_IDS`` neighbouring ids of each from a hashed place), lies beside the shards and is found by hash.
Shards carry the name of the attempt that wrote them; the manifest, written by
Spark, lists the attempts that count, so a task that runs twice does no harm.

Null texts are empty and become the end id alone.  Null ``doc_id`` sorts first;
rows with equal ids are ordered by text.
"""

from __future__ import annotations

import hashlib
import json
import struct
import uuid
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kairograph.llm.byte_bpe import make_tokenizer
from kairograph.llm.common import Batches, id_text, new_path, slices
from kairograph.llm.pieces import PieceCache, cut, literal
from kairograph.llm.token_count import byte_symbols

MAGIC = b"KTOK1\0"
HEAD = "<6s32sHQ"
SAMPLE, SAMPLE_IDS, DICTIONARY_BYTES, LEVEL = 1024, 4096, 65536, 3


def open_fs(path: str):
    """File system and path of a URI, as pyarrow knows them."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


#: The normaliser and splitter under which pieces between spaces can be encoded by themselves.
NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
SPLITTER = {
    "type": "Sequence",
    "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ],
}


class WordEncoder:
    """Ids of texts under any vocabulary of the library.

    Where the definition folds case and white space and splits at it, as `NORMALIZER`
    and `SPLITTER` say, pieces are encoded once and remembered; other definitions get
    whole texts.
    """

    def __init__(self, definition: str):
        self.tokenizer = make_tokenizer(definition)
        shape = json.loads(definition)
        self.by_piece = shape.get("normalizer") == NORMALIZER and shape.get("pre_tokenizer") == SPLITTER and shape["model"].get("type", "BPE") == "BPE"
        self.model, self.shown = self.tokenizer.model, dict(enumerate(byte_symbols()))
        self.cache = PieceCache(self._pieces)

    def _encode(self, texts: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _pieces(self, pieces: list[str]) -> list[bytes]:
        """Letters of Latin-1 alone are one word in its normal form; other pieces take the whole tokenizer."""
        tokenize, shown, ids = self.model.tokenize, self.shown, {}
        mixed = [p for p in pieces if not (p.isalpha() and max(p) <= "\xff")]
        ids = dict(zip(mixed, self._encode([literal(p) for p in mixed]), strict=True))

        def word(p: str) -> bytes:
            p = p.lower() if p.isascii() else p.lower().encode().decode("latin-1").translate(shown)
            return array("I", [t.id for t in tokenize(p)]).tobytes()

        return [ids[p] if p in ids else word(p) for p in pieces]

    @staticmethod
    def _folded(text: str) -> str:
        """Lower case and plain spaces already here where the normaliser does no more than that, so pieces differ less."""
        if "<|" in text:  # special strings are told apart by case
            return text
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return text
        return text.lower().replace("\n", " ")

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian uint32 ids."""
        if not self.by_piece:
            return self._encode(texts)
        halves = [cut(self._folded(t)) for t in texts]
        heads = self._encode([first for first, _ in halves])
        return [a + b for a, b in zip(heads, self.cache.each([rest for _, rest in halves], b"".join), strict=True)]


@lru_cache(maxsize=2)
def encoder_of(definition: str) -> WordEncoder:
    """One encoder for all tasks of a worker, whose remembered pieces they share."""
    return WordEncoder(definition)


def train_dictionary(samples: list[bytes], size: int = DICTIONARY_BYTES) -> bytes:
    """A dictionary for serialised id arrays; empty where there is too little to train on."""
    import zstandard

    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b""


def pack_shard(rows: list[tuple[int | None, bytes]], dictionary: bytes, width: int) -> bytes:
    """The bytes of one file; ids come as uint32."""
    import zstandard

    data = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
    press = zstandard.ZstdCompressor(level=LEVEL, dict_data=data, write_content_size=True).compress
    kind = f"<u{width}"
    frames = [press(np.frombuffer(ids, "<u4").astype(kind).tobytes()) for _, ids in rows]
    places = np.concatenate([[0], np.cumsum([len(f) for f in frames])]).astype("<u8")
    tokens = np.concatenate([[0], np.cumsum([len(ids) // 4 for _, ids in rows])]).astype("<u8")
    names = b"".join(struct.pack("<Bq", i is not None, i or 0) for i, _ in rows)
    mark = hashlib.sha256(dictionary).digest() if dictionary else bytes(32)
    return struct.pack(HEAD, MAGIC, mark, width, len(rows)) + places.tobytes() + tokens.tobytes() + names + b"".join(frames)


class ShardReader:
    """Random access to the documents of one file.

    ``source`` is an open file with ``read_at`` or bytes.  Opening reads the head and
    the index, 25 bytes a document; a document then costs one read of its own frame.
    """

    def __init__(self, source, dictionary: bytes = b""):
        import zstandard

        self.source = pa.BufferReader(source) if isinstance(source, bytes) else source
        at = struct.calcsize(HEAD)
        magic, mark, width, n = struct.unpack(HEAD, self.source.read_at(at, 0))
        if magic != MAGIC:
            raise ValueError("not a token shard")
        if mark != bytes(32) and hashlib.sha256(dictionary).digest() != mark:
            raise ValueError("the shard was written with another dictionary")
        index = self.source.read_at(16 * (n + 1) + 9 * n, at)
        self.n, self.kind, self.frames = n, f"<u{width}", at + len(index)
        self.places = np.frombuffer(index, "<u8", n + 1)
        self.tokens = np.frombuffer(index, "<u8", n + 1, 8 * (n + 1))
        self.names = index[16 * (n + 1) :]
        self.open = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary) if mark != bytes(32) else None).decompress

    def doc_id(self, i: int) -> int | None:
        known, value = struct.unpack_from("<Bq", self.names, 9 * i)
        return value if known else None

    def ids(self, i: int) -> np.ndarray:
        a, b = int(self.places[i]), int(self.places[i + 1])
        return np.frombuffer(self.open(self.source.read_at(b - a, self.frames + a)), self.kind)

    def scan(self, at_once: int = 4 << 20) -> Iterator[np.ndarray]:
        """Ids of all documents in order, read in stretches of about ``at_once`` bytes."""
        first = 0
        while first < self.n:
            a = int(self.places[first])
            last = max(first + 1, int(np.searchsorted(self.places, a + at_once, "right")) - 1)
            raw = self.source.read_at(int(self.places[last]) - a, self.frames + a)
            ends = (self.places[first : last + 1] - np.uint64(a)).tolist()
            for x, y in zip(ends[:-1], ends[1:], strict=True):
                yield np.frombuffer(self.open(raw[x:y]), self.kind)
            first = last


def write_tokens(docs: DataFrame, tokenizer_path: str, end_id: int = 1, out: str | None = None) -> tuple[str, DataFrame]:
    """Encode and write all documents in ascending ``doc_id``; the folder and its manifest."""
    spark = docs.sparkSession
    out = out or new_path(spark, "tokens")
    with open(tokenizer_path, encoding="utf-8") as f:
        definition = spark.sparkContext.broadcast(f.read())  # a vocabulary: a few MB whatever the input
    src = id_text(docs)
    vocab = make_tokenizer(definition.value).get_vocab_size()
    width = 2 if max(vocab, end_id + 1) <= 1 << 16 else 4

    def sample(batches: Batches) -> Batches:
        encoder = encoder_of(definition.value)
        for batch in slices(batches):
            ids = encoder.encode([t or "" for t in batch.column(1).to_pylist()])
            rows = [np.frombuffer(x, "<u4")[(at := zlib.crc32(x) % max(1, len(x) // 4 - SAMPLE_IDS + 1)) : at + SAMPLE_IDS].astype(f"<u{width}").tobytes() for x in ids]
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.binary())], ["ids"])

    order = F.xxhash64("doc_id")
    last = src.select(order.alias("h")).orderBy("h").limit(SAMPLE).agg(F.max("h")).first()[0]
    picked = [] if last is None else src.filter(order <= last).limit(SAMPLE).mapInArrow(sample, "ids binary").collect()
    dictionary = spark.sparkContext.broadcast(train_dictionary([bytes(r[0]) for r in picked]))  # DICTIONARY_BYTES at most
    system, root = open_fs(out)
    system.create_dir(root, recursive=True)
    if dictionary.value:
        with system.open_output_stream(f"{root}/{hashlib.sha256(dictionary.value).hexdigest()}.dict") as f:
            f.write(dictionary.value)

    def write(batches: Batches) -> Batches:
        encoder, rows = encoder_of(definition.value), []
        end = np.array([end_id], "<u4").tobytes()
        files, held = [], 0

        def flush() -> None:
            nonlocal held
            system, root = open_fs(out)
            raw = pack_shard(rows, dictionary.value, width)
            name = f"shard-{uuid.uuid4().hex}.tok"
            with system.open_output_stream(f"{root}/{name}") as f:
                f.write(raw)
            files.append((name, rows[0][0], rows[0][0] is not None, len(rows), sum(len(x) // 4 for _, x in rows), len(raw)))
            rows.clear()
            held = 0

        for batch in slices(batches):
            ids = encoder.encode([t or "" for t in batch.column(1).to_pylist()])
            for i, x in zip(batch.column(0).to_pylist(), ids, strict=True):
                rows.append((i, x + end))
                held += len(x)
            if held >= 64 << 20:
                flush()
        if rows:
            flush()
        task = min((f[1] if f[2] else -(1 << 63) for f in files), default=0)
        for part, (name, first, known, n, tokens, size) in enumerate(files):
            yield pa.RecordBatch.from_arrays(
                [pa.array([task], pa.int64()), pa.array([part], pa.int32()), pa.array([name]), pa.array([first], pa.int64()), pa.array([n], pa.int64()), pa.array([tokens], pa.int64()), pa.array([size], pa.int64())],
                ["task", "part", "file", "first_doc", "n_docs", "n_tokens", "n_bytes"],
            )

    ordered = src.select(F.col("doc_id").cast("long"), "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    manifest = ordered.mapInArrow(write, "task long, part int, file string, first_doc long, n_docs long, n_tokens long, n_bytes long")
    manifest.write.parquet(f"{out}/manifest")
    return out, spark.read.parquet(f"{out}/manifest")


def read_tokens(spark: SparkSession, folder: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of every document, from the files.

    The driver holds the manifest, one short row per file of up to 64 MB of ids.
    """
    files = sorted(spark.read.parquet(f"{folder}/manifest").collect(), key=lambda r: (r["task"], r["part"]))
    rows, before = [], 0
    for r in files:
        rows.append((r["file"], before))
        before += r["n_tokens"]
    shards = spark.createDataFrame(rows, "file string, before long").repartition(max(1, len(rows)), "file")

    def read(batches: Batches) -> Batches:
        system, root = open_fs(folder)
        known: dict[str, bytes] = {}
        for batch in batches:
            for name, before in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                with system.open_input_file(f"{root}/{name}") as f:
                    mark = struct.unpack(HEAD, f.read_at(struct.calcsize(HEAD), 0))[1]
                    if mark != bytes(32) and mark not in known:
                        with system.open_input_stream(f"{root}/{mark.hex()}.dict") as d:
                            known[mark] = d.read()
                    shard = ShardReader(f, known.get(mark, b""))
                    crc = [zlib.crc32(ids.astype("<u4").tobytes()) for ids in shard.scan()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([shard.doc_id(i) for i in range(shard.n)], pa.int64()), pa.array(shard.tokens[:-1].astype(np.int64) + before), pa.array(np.diff(shard.tokens.astype(np.int64))), pa.array(crc, pa.int64())],
                    ["doc_id", "start", "n_tokens", "ids_crc32"],
                )

    return shards.mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")
