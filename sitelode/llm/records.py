"""Token ids in length-delimited binary records, with a separate offset index.

A record is: payload length (8 bytes, little-endian), masked crc32 of those 8 bytes (4), the payload,
masked crc32 of the payload (4). A payload is one document: doc_id (8), flags (1: no doc_id, 2: ids
take 4 bytes), number of ids (4), the ids of 2 or 4 bytes. Beside each record file lies an index file
with the offset and doc_id of each record (8 bytes each), for reads in any order.
"""

from __future__ import annotations

import os
import re
import struct
import uuid
import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .chunks import utf8
from .scratch import materialize, scratch_dir, shuffle_partitions

#: The id that ends each document.
END_ID = 2
#: Distinct words whose ids a worker remembers.
CACHE_WORDS = 1_500_000
_MASK = 0xA282EAD8
_HEAD = struct.Struct("<qBI")
_FILES = "part int, file string, docs long, tokens long, bytes long"
#: Words of ASCII letters and plain marks only; runs of either are tokenized apart, letters in lower case.
_PLAIN = re.compile(rb"[A-Za-z,.;:!?()\"-]+")
_PROBE = "The cat, sat\n\ton(it)!  Well--known; THE END.\r\n A-b ...x"
_PARTS = re.compile(rb"[a-z]+|[^a-z]+")
_encoders: dict[str, Encoder] = {}


def masked(data: bytes) -> int:
    """crc32 rotated by 15 bits plus a constant, so that a checksum of checksums stays meaningful."""
    c = zlib.crc32(data)
    return ((c >> 15 | c << 17) + _MASK) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    size = struct.pack("<Q", len(payload))
    return b"".join((size, struct.pack("<I", masked(size)), payload, struct.pack("<I", masked(payload))))


def payload(doc_id: int | None, ids: bytes, width: int) -> bytes:
    return _HEAD.pack(doc_id or 0, (doc_id is None) + 2 * (width == 4), len(ids) // width) + ids


class Encoder:
    """Ids of whole texts, as little-endian numbers of ``width`` bytes.

    No token reaches over ASCII white space and the rules look at nothing beyond it, so the library
    encodes each distinct word (run of other bytes) once and texts are put together from those. Of words
    of plain letters and marks it encodes the runs of letters, in lower case, and of marks: that is how
    its own rules take them apart. A tokenizer that a probe shows to work otherwise encodes whole texts.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.width = 2 if self.library.get_vocab_size(with_added_tokens=True) <= 1 << 16 else 4
        self.kind = "<u2" if self.width == 2 else "<u4"
        self.words: dict[bytes, bytes] = {}
        ids = lambda t: self.library.encode(t, add_special_tokens=False).ids
        words = _PROBE.split()
        self.by_word = ids(_PROBE) == [i for w in words for i in ids(w)]
        self.by_part = self.by_word and ids(_PROBE) == [i for w in words for p in _PARTS.findall(w.lower().encode()) for i in ids(p.decode())]

    def __call__(self, text: bytes) -> bytes:
        if not self.by_word:
            return np.array(self.library.encode(text.decode(), add_special_tokens=False).ids, self.kind).tobytes()
        words = text.split()
        missing = [w for w in set(words) if w not in self.words]
        if missing:
            if len(self.words) + len(missing) > CACHE_WORDS:
                self.words.clear()
                missing = list(set(words))
            plain = {w: _PARTS.findall(w.lower()) for w in missing if self.by_part and _PLAIN.fullmatch(w)}
            needed = list({p for parts in plain.values() for p in parts if p not in self.words}.union(w for w in missing if w not in plain))
            for lo in range(0, len(needed), 4096):
                part = needed[lo : lo + 4096]
                for w, e in zip(part, self.library.encode_batch_fast([w.decode() for w in part], add_special_tokens=False)):
                    self.words[w] = np.array(e.ids, self.kind).tobytes()
            for w, parts in plain.items():
                self.words[w] = b"".join(map(self.words.__getitem__, parts))
        return b"".join(map(self.words.__getitem__, words))


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def _writer(folder: str, tokenizer: str, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encode, part = encoder(tokenizer), TaskContext.get().partitionId()
        end = end_id.to_bytes(encode.width, "little")
        name = f"part-{part:06d}-{uuid.uuid4().hex}"  # another attempt writes another file; the manifest names one
        fs, root = pa.fs.FileSystem.from_uri(folder)
        docs = tokens = at = 0
        out = index = None
        for batch in batches:
            for i, text in zip(batch.column("k").to_pylist(), utf8(batch.column("t"))):
                if out is None:
                    fs.create_dir(root, recursive=True)
                    out, index = fs.open_output_stream(f"{root}/{name}.rec"), fs.open_output_stream(f"{root}/{name}.idx")
                ids = encode(text or b"") + end
                n = len(ids) // encode.width
                data = frame(payload(i, ids, encode.width))
                out.write(data)
                index.write(struct.pack("<qq", at, i or 0))
                docs, tokens, at = docs + 1, tokens + n, at + len(data)
        if out is not None:
            out.close()
            index.close()
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([name]), *[pa.array([x], pa.int64()) for x in (docs, tokens, at)]], names=["part", "file", "docs", "tokens", "bytes"])

    return run


def write_records(docs: DataFrame, tokenizer: str, end_id: int = END_ID) -> tuple[str, DataFrame]:
    """Encode every text and write records in ascending doc_id order (null ids first, ties by text).

    Returns the folder and a manifest (part, file, docs, tokens, bytes); part numbers follow the order.
    Null text is empty: only the end id. Documents are dealt by ranges of doc_id, so no task sorts more
    than its range, and rows that share an id still spread by a hash of the text.
    """
    spark = docs.sparkSession
    folder = f"{scratch_dir(spark)}/records-{uuid.uuid4().hex}"
    rows = docs.select(F.col("doc_id").cast("long").alias("k"), F.col("text").alias("t")).withColumn("h", F.xxhash64("t"))
    dealt = rows.repartitionByRange(shuffle_partitions(spark), "k", "h").sortWithinPartitions("k", "h").select("k", "t")
    return folder, materialize(dealt.mapInArrow(_writer(folder, tokenizer, end_id), _FILES), "record-files")


class RecordFile:
    """Reads one record file, in order or by its index."""

    def __init__(self, folder: str, name: str):
        self.fs, self.root = pa.fs.FileSystem.from_uri(folder)
        self.name = name

    def index(self) -> np.ndarray:
        """Rows (offset, doc_id)."""
        with self.fs.open_input_file(f"{self.root}/{self.name}.idx") as f:
            return np.frombuffer(f.read(), np.int64).reshape(-1, 2)

    def read(self, offsets: Sequence[int]) -> Iterator[tuple[int | None, np.ndarray]]:
        """(doc_id, ids) of the records at ``offsets``, checked against their checksums."""
        with self.fs.open_input_file(f"{self.root}/{self.name}.rec") as f:
            at = None
            for o in offsets:
                if o != at:
                    f.seek(o)
                head = f.read(12)
                size, check = struct.unpack("<QI", head)
                if masked(head[:8]) != check:
                    raise ValueError(f"damaged length at {o} of {self.name}")
                body = f.read(size + 4)
                payload = body[:size]
                if masked(payload) != struct.unpack("<I", body[size:])[0]:
                    raise ValueError(f"damaged record at {o} of {self.name}")
                doc, flags, n = _HEAD.unpack_from(payload)
                yield (None if flags & 1 else doc), np.frombuffer(payload, "<u4" if flags & 2 else "<u2", n, _HEAD.size)
                at = o + 16 + size


def read_back(folder: str, manifest: DataFrame) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens and ids_crc32, from the files.

    The manifest has one row for each file, so its running sum is the one thing worked out on the driver.
    """
    spark = manifest.sparkSession
    files, base, total = [], [], 0
    for r in sorted(manifest.collect(), key=lambda r: r["part"]):
        files.append(r["file"])
        base.append(total)
        total += r["tokens"]
    if not files:
        return spark.createDataFrame([], "doc_id long, start long, n_tokens long, ids_crc32 long")
    todo = spark.createDataFrame(list(zip(files, base)), "file string, base long").repartition(len(files))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, at in zip(batch.column("file").to_pylist(), batch.column("base").to_pylist()):
                source = RecordFile(folder, name)
                offsets = source.index()[:, 0].tolist()
                for lo in range(0, len(offsets), 4096):
                    rows = []
                    for doc, ids in source.read(offsets[lo : lo + 4096]):
                        rows.append((doc, at, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                        at += len(ids)
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return todo.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op7_token_records(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return read_back(*write_records(docs, public_tokenizers.path("word_bpe_49k.json")))
