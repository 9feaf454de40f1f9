"""Token ids in fixed-width bit-packed segments.

Every id takes the fewest bits that hold the vocabulary.  Ids are packed in blocks of
``BLOCK`` ids that start at whole bytes; a segment keeps the byte offset of each block
and the place of each document, so any document or range of ids is unpacked with numpy
from the few blocks that hold it.

Layout of a segment, little-endian: the magic ``FFPACK01``; as unsigned 64-bit integers
bits per id, ids per block, number of ids, of documents and of blocks; then as unsigned
64-bit integers the end of each document (in ids) and the start of each block (in bytes
of the payload); then the payload.

Tasks reach the cluster's storage through Spark's writers, so segments are rows of a
Parquet table in the shared folder: written once each, committed as a whole, and whole
again after lost executors.  Rows of a partition are in the order of document ids.
"""

from __future__ import annotations

import os
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from footfall.llm.common import DOCUMENTS, batches_of, settled, table, text_batches
from footfall.session import work_dir

MAGIC = b"FFPACK01"
BLOCK = 4096
#: A segment is closed when it has this many ids; a document is never divided.
SEGMENT_IDS = 1 << 18
#: Bytes of distinct words and their parts remembered by a task before it starts afresh.
REMEMBERED = 96 << 20
#: Bytes that an entry takes beside its word and its ids.
ENTRY = 180
#: Segments that Spark hands to Python at once.
SEGMENTS = 8
#: Latin-1 letters, then ASCII signs other than the apostrophe: split alike by any case.
PLAIN = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([!-&(-/:-@\[-`{-~]*)")


def bits_for(vocabulary: int) -> int:
    return max(1, (vocabulary - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    """``ids`` in ``bits`` bits each, most significant bit first, padded to whole bytes."""
    if bits == 16:
        return ids.astype(">u2").tobytes()
    spread = np.unpackbits(ids.astype(">u4").view(np.uint8).reshape(-1, 4), axis=1)
    return np.packbits(spread[:, 32 - bits:]).tobytes()


def unpack(data, count: int, bits: int) -> np.ndarray:
    if bits == 16:
        return np.frombuffer(data, ">u2", count).astype(np.uint32)
    ones = np.unpackbits(np.frombuffer(data, np.uint8), count=count * bits).reshape(count, bits)
    wide = np.zeros((count, 32), np.uint8)
    wide[:, 32 - bits:] = ones
    return np.packbits(wide, axis=1).view(">u4").reshape(-1).astype(np.uint32)


def segment(documents: list[np.ndarray], bits: int) -> bytes:
    ends = np.cumsum([len(d) for d in documents], dtype=np.uint64)
    ids = np.concatenate(documents) if documents else np.zeros(0, np.uint32)
    payload = [pack(ids[i:i + BLOCK], bits) for i in range(0, len(ids), BLOCK)]
    starts = np.cumsum([0, *map(len, payload)], dtype=np.uint64)[:-1]
    head = np.array([bits, BLOCK, len(ids), len(documents), len(payload)], "<u8")
    return b"".join([MAGIC, head.tobytes(), ends.astype("<u8").tobytes(),
                     starts.astype("<u8").tobytes(), *payload])


class Segment:
    """Reads documents or ranges of ids from the bytes of a segment, or a map of them."""

    def __init__(self, data):
        view = memoryview(data)
        if bytes(view[:8]) != MAGIC:
            raise ValueError("not a segment of packed ids")
        self.bits, self.block, self.ids, self.documents, blocks = (
            int(x) for x in np.frombuffer(view, "<u8", 5, 8))
        self.ends = np.frombuffer(view, "<u8", self.documents, 48).astype(np.int64)
        self.starts = np.frombuffer(view, "<u8", blocks, 48 + 8 * self.documents).astype(np.int64)
        self.payload = view[48 + 8 * (self.documents + blocks):]

    def range(self, start: int, end: int) -> np.ndarray:
        if start >= end:
            return np.zeros(0, np.uint32)
        first, last = start // self.block, (end - 1) // self.block
        upto = min((last + 1) * self.block, self.ids)
        got = unpack(self.payload[self.starts[first]:], upto - first * self.block, self.bits) \
            if self.block * self.bits % 8 == 0 else np.concatenate([
                unpack(self.payload[self.starts[b]:],
                       min((b + 1) * self.block, self.ids) - b * self.block, self.bits)
                for b in range(first, last + 1)])
        return got[start - first * self.block:end - first * self.block]

    def document(self, i: int) -> np.ndarray:
        return self.range(int(self.ends[i - 1]) if i else 0, int(self.ends[i]))


class Encoder(dict):
    """Ids of texts; where the tokenizer drops white space, word by word and remembered.

    Such a tokenizer never joins words, so a text's ids are those of its words in turn.
    Whether it is one is tried on a probe; if not, texts are encoded whole.
    """

    def __init__(self, path: str):
        super().__init__()
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.vocabulary = self.tokenizer.get_vocab_size()
        self.dtype = np.dtype("<u2" if self.vocabulary <= 1 << 16 else "<u4")
        self.format = "H" if self.dtype.itemsize == 2 else "I"
        probe = ["Ab,", "c1's", "dé", "́x"]
        self.by_word = self._whole(" \n ".join(probe) + "\t") == sum(map(self._whole, probe), [])
        self.held = 0
        signs = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 255 and b != 173]
        signs += [b for b in range(256) if b not in signs]  # bytes in the order of their signs
        self.signs = {b: chr(b if i < 188 else 256 + i - 188) for i, b in enumerate(signs)}
        probe = ["abc", "été", "über", "àñß", "!!", ".", "***"]
        self.direct = all(self._model(p) == self._whole(p) for p in probe)

    def _model(self, text: str) -> list[int]:
        """Ids of one lower-case word or run of signs, past the tokenizer's preparation."""
        mapped = text.encode().decode("latin-1").translate(self.signs)
        return [t.id for t in self.model.tokenize(mapped)]

    def _whole(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def _bytes(self, ids: list[int]) -> bytes:
        return struct.pack(f"<{len(ids)}{self.format}", *ids)

    def __missing__(self, word: bytes) -> bytes:
        if word.isalpha():  # of bytes: A-Z and a-z only
            lower = word.lower()
            if lower != word:
                ids = self[lower]
            elif self.direct:  # such letters stand for themselves
                ids = self._bytes([t.id for t in self.model.tokenize(word.decode())])
            else:
                ids = self._bytes(self._whole(word.decode()))
        else:
            text = word.decode("utf-8", "replace")
            if not (plain := PLAIN.fullmatch(text)):
                ids = self._bytes(self._whole(text))
            elif plain[2]:
                ids = self[plain[1].lower().encode()] + self[plain[2].encode()]
            elif (lower := text.lower()) != text:
                ids = self[lower.encode()]
            else:
                ids = self._bytes(self._model(text) if self.direct else self._whole(text))
        if len(word) <= 64:
            if self.held >= REMEMBERED:
                self.clear()
                self.held = 0
            self[word] = ids
            self.held += ENTRY + len(word) + len(ids)
        return ids

    def ids(self, text: bytes) -> np.ndarray:
        if not self.by_word:
            return np.array(self._whole(text.decode("utf-8", "replace")), np.uint32)
        return np.frombuffer(b"".join(map(self.__getitem__, text.split())),
                             self.dtype).astype(np.uint32)


_READY: dict[str, Encoder] = {}


def _encoder(path: str) -> Encoder:
    if path not in _READY:
        _READY[path] = Encoder(path)
    return _READY[path]


def write_token_ids(docs: DataFrame, path: str, end_id: int = 1, folder: str | None = None) -> str:
    """Writes the ids of every text, ``end_id`` after each, and returns the folder.

    Documents are in ascending order of doc_id, those without one first, rows that share
    an id by their text.  Null texts count as empty and hold only the end id.  Only doc_id
    and text are read.  ``path`` names the tokenizer's file on every executor.
    """
    folder = folder or work_dir(docs.sparkSession, "token-ids")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part = _encoder(path), TaskContext.get().partitionId()
        bits = bits_for(max(encoder.vocabulary, end_id + 1))
        number, inside, size, held, names = 0, 0, 0, [], []

        def closed():
            return pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int32()), pa.array([number], pa.int32()),
                 pa.array([inside], pa.int64()), pa.array([size], pa.int64()), pa.array([names], pa.list_(pa.int64())),
                 pa.array([segment(held, bits)], pa.binary())],
                ["part", "number", "inside", "n_ids", "doc_ids", "packed"])

        for batch, texts in text_batches(batches):
            for name, text in zip(batch.column(0).to_pylist(), texts, strict=True):
                held.append(np.append(encoder.ids(text), np.uint32(end_id)))
                names.append(name)
                size += len(held[-1])
                if size >= SEGMENT_IDS:
                    yield closed()
                    number, inside, size, held, names = number + 1, inside + size, 0, [], []
        if held:
            yield closed()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text",
                       F.xxhash64("text").alias("tie"))
    with batches_of(docs.sparkSession, DOCUMENTS):
        (rows.repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie", "text")
         .select("doc_id", "text")
         .mapInArrow(run, "part int, number int, inside long, n_ids long, doc_ids array<long>, "
                          "packed binary")
         .write.option("compression", "none").parquet(folder))
    return folder


def read_token_ids(spark: SparkSession, folder: str) -> DataFrame:
    """The segments in order: start (ids before), n_ids, doc_ids and packed.

    A segment knows the ids before it in its partition; what the partitions before hold is
    a running sum over one row for each, small enough to be broadcast by its size on disk,
    so the segments themselves are not shuffled.
    """
    rows = spark.read.parquet(folder)
    parts = settled(rows.groupBy("part").agg(F.sum("n_ids").alias("ids")).select("part", (
        F.sum("ids").over(Window.orderBy("part")) - F.col("ids")).alias("before")), "id-parts")
    return rows.join(parts, "part").select(
        "part", "number", (F.col("before") + F.col("inside")).alias("start"), "n_ids", "doc_ids",
        "packed")


def documents_of(segments: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of each document in the segments."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, names, packed in zip(*(batch.column(i) for i in range(3)), strict=True):
                read = Segment(packed.as_buffer())
                ids = read.range(0, read.ids).astype("<u4")
                begins = np.concatenate(([0], read.ends[:-1])) if read.documents else read.ends
                sums = [zlib.crc32(ids[a:b]) for a, b in zip(begins, read.ends, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [names.values, pa.array(begins + start.as_py(), pa.int64()),
                     pa.array(read.ends - begins, pa.int64()), pa.array(sums, pa.int64())],
                    ["doc_id", "start", "n_tokens", "ids_crc32"])

    return segments.select("start", "doc_ids", "packed").mapInArrow(
        run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def token_ids(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Writes the ids of ``docs`` and reads the digest of each document back from the files."""
    spark = docs.sparkSession
    folder = write_token_ids(docs, path or vocabulary_path())
    with batches_of(spark, SEGMENTS):
        return settled(documents_of(read_token_ids(spark, folder)), "token-digests")


def op4_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_ids(table(spark, sf_dir, "documents"))
