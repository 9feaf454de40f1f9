"""Removal of repeated passages through merged Burrows-Wheeler transforms.

A byte goes if a string of ``length`` bytes that covers it also starts earlier.  The
bytes of a whole corpus cannot be merged in so many rounds, so strings that can be equal
are brought together first, without losing any:

1. Of the 24-byte grams in each string of ``length`` bytes, the one with the least hash
   is its anchor; equal strings have equal anchors at equal places.  The strings of a
   document that share an anchor form one stretch.
2. Anchors are counted over the corpus.  A bitmap of fixed size, with those that occur
   more than once, drops the rest where they are found; what it lets through by chance
   costs time but changes nothing.
3. Of stretches with equal bytes (told by a 128-bit digest) around one anchor, all but the
   first go as a whole.
4. First stretches that share an anchor but differ elsewhere are the only places where
   a repeated string is not known yet.  They form shards; the shards' transforms are
   merged by interleave refinement, and blocks with ``length`` common bytes are repeats.
   An anchor with more than ``group_texts`` such stretches is not held in one task: its
   strings are told apart by a 128-bit digest and grouped by Spark.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from footfall.llm.bitmap import bitmap, marked
from footfall.llm.bwt import repeated
from footfall.llm.common import row_key, settled, table, text_batches

GRAM = 24
#: String starts of a long text that are looked at together, with their places in 20 bits.
SEGMENT = 1 << 19
#: Bytes of stretches whose transforms are merged at once.
CHUNK = 1 << 18
SALTS = 64
_PLACES = np.uint64((1 << 20) - 1)
_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], np.uint64)


def _gram_hashes(data: np.ndarray) -> np.ndarray:
    """64-bit hash of each 24-byte gram."""
    words = np.ndarray((len(data) - 7,), "<u8", data, strides=(1,)).astype(np.uint64)
    n = len(data) - GRAM + 1
    out = words[:n] * _MIX[0]
    for i, by in ((8, _MIX[1]), (16, _MIX[2])):
        out ^= out >> np.uint64(29)
        out += words[i:i + n]
        out *= by
    out ^= out >> np.uint64(32)
    return out


def stretches(text: bytes, length: int) -> tuple[np.ndarray, ...]:
    """(anchor hash, anchor place, first start, last start) of a text's stretches."""
    found: list[list[np.ndarray]] = []
    data = np.frombuffer(text, np.uint8)
    width = length - GRAM + 1
    for at in range(0, max(0, len(data) - length + 1), SEGMENT):
        part = data[at:at + SEGMENT + length - 1]
        hashes = _gram_hashes(part)
        least = (hashes & ~_PLACES) | np.arange(len(hashes), dtype=np.uint64)
        span = 1
        while span * 2 <= width:
            least = np.minimum(least[:-span], least[span:])
            span *= 2
        starts = len(part) - length + 1
        least = np.minimum(least[:starts], least[width - span:width - span + starts])
        place = (least & _PLACES).astype(np.int64)
        cuts = np.flatnonzero(place[1:] != place[:-1]) + 1
        first, last = np.concatenate(([0], cuts)), np.concatenate((cuts - 1, [starts - 1]))
        place = place[first]
        found.append([hashes[place].view(np.int64), place + at, first + at, last + at])
    if not found:
        return (np.zeros(0, np.int64),) * 4
    return tuple(np.concatenate(c) for c in zip(*found, strict=True))


def _firsts(rows: DataFrame, keys: list[str], name: str) -> DataFrame:
    """``rows`` without ``keys`` but with ``later``: whether an equal row comes before.

    Two steps, the first by a share of each group, so that no task meets a large group;
    in the second only the first rows of the shares meet.  Rows at one ``place`` of one
    document are equally early.
    """
    order = [F.asc_nulls_first("doc_id"), F.asc("row_key"), F.asc("first")]
    share = Window.partitionBy(*keys, F.pmod("place", F.lit(SALTS))).orderBy(*order)
    rows = (rows.withColumn("later", F.rank().over(share) > 1)
            .withColumn("spread", F.when(F.col("later"), F.col("place"))))
    last = Window.partitionBy(*keys, "spread").orderBy(*order)
    rows = rows.withColumn("later", F.col("later") | (F.rank().over(last) > 1))
    return settled(rows.drop("spread", *(k for k in keys if k != "anchor")), name)


def _places(doc_id: pa.Array, row_key: pa.Array, first: np.ndarray) -> np.ndarray:
    """64 bits of the place of a stretch."""
    out = doc_id.fill_null(-1).to_numpy().view(np.uint64) * _MIX[0]
    out ^= row_key.to_numpy().view(np.uint64)
    out ^= out >> np.uint64(31)
    out = (out + first.astype(np.uint64)) * _MIX[1]
    out ^= out >> np.uint64(29)
    out *= _MIX[2]
    return (out ^ out >> np.uint64(32)).view(np.int64)


SPANS = "doc_id long, row_key long, start long, end long"


def _merged_repeats(length: int):
    """Spans of repeated strings among the stretches of whole anchors, chunk by chunk."""
    def spans(held: pd.DataFrame) -> pa.RecordBatch:
        held = held.drop_duplicates(["doc_id", "row_key", "first", "anchor"]).reset_index(drop=True)
        text, start, block = repeated(list(held["bytes"]), length)
        ids = held["doc_id"].astype("Float64").fillna(-np.inf).astype(float)
        doc = held.assign(id=ids).groupby(["id", "row_key"], sort=True).ngroup().to_numpy()
        place = start + held["first"].to_numpy()[text]
        order = np.lexsort((place, doc[text], block))
        block = block[order]
        again = order[1:][block[1:] == block[:-1]]
        # places that overlap make one span
        order = again[np.lexsort((place[again], doc[text[again]]))]
        at, place = text[order], place[order]
        cut = (doc[at][1:] != doc[at][:-1]) | (place[1:] > place[:-1] + length)
        begins = np.flatnonzero(np.concatenate(([len(at) > 0], cut)))
        ends = np.append(begins[1:] - 1, len(at) - 1)[:len(begins)]
        return pa.RecordBatch.from_arrays(
            [pa.array(held["doc_id"].to_numpy()[at[begins]], pa.int64(), from_pandas=True),
             pa.array(held["row_key"].to_numpy()[at[begins]], pa.int64()),
             pa.array(place[begins], pa.int64()), pa.array(place[ends] + length, pa.int64())],
            ["doc_id", "row_key", "start", "end"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, rest = [], 0, None
        for batch in batches:
            frame = batch.to_pandas()
            frame["doc_id"] = frame["doc_id"].astype("Int64") if batch.column(
                0).null_count else frame["doc_id"]
            if rest is not None:
                frame = pd.concat([rest, frame])
            cut = frame["anchor"] != frame["anchor"].iloc[-1]  # the last anchor may go on
            rest, frame = frame[~cut], frame[cut]
            for _, group in frame.groupby("anchor", sort=False):
                held.append(group)
                size += group["bytes"].str.len().sum()
                if size >= CHUNK:
                    yield spans(pd.concat(held))
                    held, size = [], 0
        if rest is not None:
            yield spans(pd.concat([*held, rest]))

    return run


def repeated_spans(docs: DataFrame, length: int, group_texts: int) -> DataFrame:
    """Spans (doc_id, row_key, start, end) that cover every byte to be removed."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), row_key().alias("row_key"),
                       "text")

    def anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, texts in text_batches(batches):
            found = np.concatenate([stretches(t, length)[0] for t in texts])
            yield pa.RecordBatch.from_arrays([pa.array(found)], ["anchor"])

    counted = settled(rows.select("text").mapInArrow(anchors, "anchor long").groupBy("anchor")
                      .count().where("count > 1").select("anchor"), "anchors")
    shipped = docs.sparkSession.sparkContext.broadcast(bitmap(counted))

    def thinned(batches: Iterator[pa.RecordBatch], chosen=None) -> Iterator[pa.RecordBatch]:
        """Stretches whose anchors may be shared, by digest; with ``chosen``, a bitmap of
        places and of documents, those at such places, with their bytes."""
        bits = shipped.value
        if chosen is not None:  # texts that have none of them are not looked at again
            batches = (b.filter(pa.array(marked(chosen.value, b.column(1).to_numpy())))
                       for b in batches)
        for batch, texts in text_batches(batches):
            out, data = [], []
            for i, text in enumerate(texts):
                anchor, place, first, last = stretches(text, length)
                may = marked(bits, anchor)
                first, last = first[may], last[may]
                out.append((np.full(len(first), i), anchor[may], place[may] - first, first, last + length))
                if chosen is None:
                    data += [xxhash.xxh3_128_digest(text[s:e]) for s, e in zip(
                        first.tolist(), (last + length).tolist(), strict=True)]
            at, anchor, ahead, first, end = (np.concatenate(c) for c in zip(*out, strict=True))
            names = [batch.column(c).take(pa.array(at)) for c in (0, 1)]
            place = _places(*names, first)
            if chosen is None:
                digest = np.frombuffer(b"".join(data), "<i8").reshape(-1, 2)
                yield pa.RecordBatch.from_arrays(
                    [*names, pa.array(anchor), pa.array(ahead, pa.int32()), pa.array(first, pa.int32()),
                     pa.array(end, pa.int32()), pa.array(place), pa.array(digest[:, 0]),
                     pa.array(digest[:, 1])],
                    ["doc_id", "row_key", "anchor", "ahead", "first", "end", "place", "d1", "d2"])
                continue
            take = np.flatnonzero(marked(chosen.value, place))
            yield pa.RecordBatch.from_arrays(
                [*(n.take(pa.array(take)) for n in names), pa.array(anchor[take]),
                 pa.array(first[take], pa.int32()),
                 pa.array([texts[i][s:e] for i, s, e in zip(
                     at[take].tolist(), first[take].tolist(), end[take].tolist(), strict=True)],
                     pa.binary())], ["doc_id", "row_key", "anchor", "first", "bytes"])

    placed = rows.mapInArrow(thinned, "doc_id long, row_key long, anchor long, ahead int, "
                                      "first int, end int, place long, d1 long, d2 long")
    # anchors that the bitmap lets through though they occur once drop out below
    known = _firsts(placed, ["anchor", "ahead", "d1", "d2"], "stretches")
    whole = known.where("later").select("doc_id", "row_key", F.col("first").alias("start"), "end")
    firsts = known.where(~F.col("later"))
    sizes = settled(firsts.groupBy("anchor").count().where("count > 1"), "shared-anchors")
    # the bytes are taken from the texts again, of these stretches only; a place that the
    # bitmap lets through by chance is one more true stretch and changes nothing
    still = firsts.join(sizes, "anchor").select(F.explode(F.array("place", "row_key")).alias("hash"))
    chosen = docs.sparkSession.sparkContext.broadcast(bitmap(still))
    shared = settled(
        rows.mapInArrow(lambda batches: thinned(batches, chosen),
                        "doc_id long, row_key long, anchor long, first int, bytes binary"),
        "open-stretches").join(sizes, "anchor")
    small = (shared.where(F.col("count") <= group_texts)
             .select("doc_id", "row_key", "anchor", "first", "bytes")
             .repartition("anchor").sortWithinPartitions("anchor"))

    def strings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            firsts_, data = batch.column(2).to_numpy(), batch.column(3).to_pylist()
            at = np.repeat(np.arange(len(data)), [len(d) - length + 1 for d in data])
            start = np.concatenate([f + np.arange(len(d) - length + 1)
                                    for f, d in zip(firsts_, data, strict=True)])
            digests = [hashlib.blake2b(d[i:i + length], digest_size=16).digest()
                       for d in data for i in range(len(d) - length + 1)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(at)), batch.column(1).take(pa.array(at)),
                 pa.array(start), pa.array(digests, pa.binary())],
                ["doc_id", "row_key", "first", "digest"])

    large = _firsts(
        shared.where(F.col("count") > group_texts).select("doc_id", "row_key", "first", "bytes")
        .mapInArrow(strings, "doc_id long, row_key long, first long, digest binary")
        .withColumn("place", F.xxhash64("doc_id", "row_key", "first")), ["digest"], "strings")
    return (whole.unionByName(small.mapInArrow(_merged_repeats(length), SPANS))
            .unionByName(large.where("later").select(
                "doc_id", "row_key", F.col("first").alias("start"),
                (F.col("first") + length).alias("end"))))


def remove_repeats(docs: DataFrame, length: int = 100, group_texts: int = 4096) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256 and kept.

    Texts are UTF-8 bytes; null counts as empty.  Documents are in the order of doc_id,
    those without one first, those that share an id by a hash of their text; rows alike
    in id and text count as one document and get the same result.  ``kept`` is what
    remains, in bytes.  Only doc_id and text are read.  An empty table gives none.
    """
    both = F.shiftleft("start", 32).bitwiseOR(F.col("end"))  # one long for each span
    spans = (repeated_spans(docs, length, group_texts).groupBy("doc_id", "row_key")
             .agg(F.collect_list(both).alias("spans"))
             .withColumnsRenamed({"doc_id": "__id", "row_key": "__key"}))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in text_batches(batches):
            out = []
            for name, text, found in zip(batch.column(0).to_pylist(), texts, batch.column(2),
                                         strict=True):
                cover = np.zeros(len(text) + 1, np.int64)
                if found.is_valid:
                    packed = found.values.to_numpy()
                    np.add.at(cover, packed >> 32, 1)
                    np.subtract.at(cover, packed & 0xFFFFFFFF, 1)
                gone = np.cumsum(cover)[:-1] > 0
                begins = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum()) if len(gone) else 0
                kept = np.frombuffer(text, np.uint8)[~gone].tobytes()
                out.append((name, len(text), int(gone.sum()), begins,
                            hashlib.sha256(kept).hexdigest(), kept))
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*out, strict=True), [
                    *[pa.int64()] * 4, pa.string(), pa.binary()], strict=True)],
                ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), row_key().alias("row_key"),
                       "text")
    return (rows.join(spans, F.col("doc_id").eqNullSafe(F.col("__id"))
                      & (F.col("row_key") == F.col("__key")), "left")
            .select("doc_id", "text", "spans")
            .mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, "
                             "kept_sha256 string, kept binary"))


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents")).drop("kept")
