"""Benchmark decontamination by latent semantic retrieval.

Benchmark passages are cut into pieces of at most 72 words.  Pieces become vectors over
hashed words, each entry the root of the word's inverse document frequency in the whole
corpus, so products of vectors add weights.  A distributed randomised SVD gives their
latent space: tasks multiply their pieces with a random block and its transpose, twice
refined, and only the small factors meet on the driver.  Windows of every document are
folded into the space and compared with all pieces by a cosine in which a window is no
longer than the piece, so foreign words around a copy count nothing.  Passages with a
piece above the cosine are checked word by word: the longest common subsequence, weighted
like the words, and how much of the passage's last sentence (its answer) occurs.

The benchmark is the query set: it is taken in blocks of ``block_items`` passages, each
against all documents.  A window holds every run of as many words as its pieces have, and
what a subsequence takes of a passage it takes of some piece at least; so with ``cosine``
up to ``similar`` no passage without words put in between is passed over.
"""

from __future__ import annotations

import itertools
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from footfall.llm.common import row_key, settled, table, text_batches, without_rows

TERMS = 1 << 18
SLICE = 1 << 15
#: Words of a piece at most, and words of the windows for such pieces; the next window
#: starts a quarter further.
SIZES = ((24, 32), (72, 96))
#: Words summed at once, and words of a text taken at once; both divide as strides need.
STEP, CHUNK = 8, 960
_SIGNS = bytes(c for c in range(128) if not chr(c).isalnum())
_PLAIN = bytes.maketrans(_SIGNS + bytes(range(65, 91)), b" " * len(_SIGNS) + bytes(range(97, 123)))


def terms(text: bytes) -> np.ndarray:
    """The hashed term of each word, lower-cased, without ASCII signs."""
    words = text.translate(_PLAIN).split()
    return np.fromiter(map(zlib.crc32, words), np.uint32, len(words)).astype(np.int64) % TERMS


def term_weights(docs: DataFrame) -> np.ndarray:
    """Inverse document frequency of each term over all documents, never below log 2.

    Each task sends its counts in slices of a fixed size; slices are added in two rounds.
    """
    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(TERMS + 1, np.int64)  # the last place counts documents
        for _, texts in text_batches(batches):
            for text in texts:
                seen[np.unique(terms(text))] += 1
            seen[TERMS] += len(texts)
        for i in range(0, TERMS + 1, SLICE):
            if (part := seen[i:i + SLICE]).any():
                yield pa.RecordBatch.from_arrays(
                    [pa.array([i // SLICE], pa.int32()),
                     pa.array([zlib.compress(part.tobytes(), 1)], pa.binary())], ["slice", "n"])

    def added(key: tuple, rows: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: np.ndarray | int = 0
        for frame in rows:
            for part in frame["n"]:
                total = total + np.frombuffer(zlib.decompress(part), np.int64)
        yield pd.DataFrame({"slice": [key[0]], "n": [zlib.compress(total.tobytes(), 1)]})

    schema = "slice int, n binary"
    parts = docs.select("text").mapInArrow(counted, schema).withColumn(
        "turn", F.spark_partition_id() % 64)
    parts = parts.groupBy("slice", "turn").applyInPandas(added, schema)
    seen = np.zeros(TERMS + 1, np.int64)
    for row in parts.groupBy("slice").applyInPandas(added, schema).toLocalIterator():
        part = np.frombuffer(zlib.decompress(row.n), np.int64)
        seen[row.slice * SLICE:row.slice * SLICE + len(part)] = part
    return np.log1p((seen[TERMS] + 1) / (seen[:TERMS] + 1))


@dataclass
class Passage:
    name: int
    words: np.ndarray         # hashed terms
    answer: set[int]
    pieces: list[tuple[int, bytes]]  # size (its place in SIZES) and text of each

    @classmethod
    def of(cls, name: int, text: bytes) -> Passage:
        last = re.split(rb"[.?!]+\s+", text.strip(b" .?!\n\t"))[-1]
        words = text.translate(_PLAIN).split()
        size = 0 if len(words) <= SIZES[0][0] else 1
        parts = -(-len(words) // SIZES[size][0])
        cuts = [len(words) * i // parts for i in range(parts + 1)] if parts else []
        return cls(name, terms(text), set(terms(last).tolist()),
                   [(size, b" ".join(words[a:b])) for a, b in itertools.pairwise(cuts)])


@dataclass
class Space:
    """The latent space of one block of passages."""

    weights: np.ndarray       # (terms,) inverse document frequencies
    place: np.ndarray         # (terms,) row of the term in ``folded``, the last if it has none
    folded: np.ndarray        # (block terms + 1, pieces) root of the weight times the term's
    #                           vector times that of each piece, the last row zero
    lengths: np.ndarray       # (pieces,) root of the weight of its words
    sizes: list[slice]        # pieces of each of SIZES
    owners: np.ndarray        # (pieces,) passage of each
    passages: list[Passage]
    words: np.ndarray         # terms of all passages, one after the other
    cuts: np.ndarray          # where each passage starts there
    longest: int              # words of a passage

    def possible(self, near: np.ndarray, share: float) -> np.ndarray:
        """Of each passage, whether its words among ``near`` have that share of its weight."""
        present = np.zeros(TERMS, bool)
        present[near] = True
        by = self.weights[self.words]
        return (np.add.reduceat(by * present[self.words], self.cuts)
                >= share * np.add.reduceat(by, self.cuts) * 0.999)


def randomised_svd(passages: DataFrame, place: np.ndarray, weights: np.ndarray, size: int,
                   rank: int, refine: int = 2) -> np.ndarray:
    """(size, rank) right singular vectors of the matrix of ``passages`` (text), which has
    the weights of the different terms of each.

    Each pass multiplies the matrix and its transpose with a thin block; partial products
    have ``size`` by ``rank`` numbers, both bounded by the block of passages.
    """
    def product(block: np.ndarray, square: bool) -> np.ndarray:
        shipped = passages.sparkSession.sparkContext.broadcast(block.astype(np.float32))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held = shipped.value
            total = np.zeros((held.shape[1] if square else len(held), held.shape[1]))
            for _, texts in text_batches(batches):
                for text in texts:
                    at = np.unique(terms(text))
                    rows, by = place[at], weights[at]
                    row = by @ held[rows]
                    if square:
                        total += np.outer(row, row)
                    else:
                        np.add.at(total, rows, by[:, None] * row)
            packed = zlib.compress(total.astype(np.float32).tobytes(), 1)
            yield pa.RecordBatch.from_arrays([pa.array([packed], pa.binary())], ["sum"])

        out = sum(np.frombuffer(zlib.decompress(r[0]), np.float32).astype(float)
                  for r in passages.mapInArrow(run, "sum binary").toLocalIterator())
        shipped.unpersist()
        return np.reshape(out, (-1, block.shape[1]))

    block = np.linalg.qr(np.random.default_rng(7).standard_normal((size, min(rank + 8, size))))[0]
    for _ in range(refine):
        block = np.linalg.qr(product(block, False))[0]
    values, turn = np.linalg.eigh(product(block, True))
    return block @ turn[:, np.argsort(-values)[:rank]]


def _space(spark: SparkSession, passages: list[Passage], weights: np.ndarray) -> Space:
    pieces = sorted(((size, n, text) for n, p in enumerate(passages) for size, text in p.pieces),
                    key=lambda piece: piece[:2])
    words = [terms(text) for _, _, text in pieces]
    own = np.unique(np.concatenate(words))
    place = np.full(TERMS, len(own), np.int64)
    place[own] = np.arange(len(own))
    roots = np.sqrt(weights)
    rows = spark.createDataFrame([(text.decode(),) for _, _, text in pieces], "text string")
    vectors = randomised_svd(rows.repartition(2), place, roots, len(own),
                             min(len(pieces), len(own)))
    items = np.stack([roots[w] @ vectors[place[w]] for w in map(np.unique, words)])
    folded = roots[own, None] * (vectors @ items.T)
    cuts = np.searchsorted([size for size, _, _ in pieces], range(len(SIZES) + 1))
    return Space(weights.astype(np.float32), place,
                 np.vstack([folded, np.zeros((1, len(pieces)))]).astype(np.float32),
                 np.sqrt([weights[w].sum() for w in words]).astype(np.float32),
                 [slice(a, b) for a, b in itertools.pairwise(cuts.tolist())],
                 np.array([n for _, n, _ in pieces]), passages,
                 np.concatenate([p.words for p in passages]),
                 np.cumsum([0, *(len(p.words) for p in passages[:-1])]),
                 max(len(p.words) for p in passages))


def common_share(item: list[int], text: np.ndarray, weights: np.ndarray) -> float:
    """Weight of the heaviest common subsequence, as a share of the item's weight."""
    total = float(weights[item].sum())
    if not total:
        return 0.0
    best = np.zeros(len(text) + 1, np.float64)
    for word in item:
        taken = np.where(text == word, best[:-1] + weights[word], 0.0)
        best[1:] = np.maximum.accumulate(np.maximum(best[1:], taken))
    return float(best[-1]) / total


def candidates(at: np.ndarray, space: Space, cosine: float,
               share: float) -> Iterator[tuple]:
    """(start, end, piece, cosine) of the windows of the terms ``at`` close to a piece.

    Sums over steps of a text, folded in, give those of its windows.  Passages whose words
    near the windows cannot have ``share`` of their weight are left out, which loses none.
    """
    rows = space.place[at]
    square = np.concatenate(([0], np.cumsum(space.weights[at], dtype=np.float64)))
    none = len(space.folded) - 1
    widest = max(window for _, window in SIZES)
    for c in range(0, len(at), CHUNK):
        part = rows[c:c + CHUNK + widest]
        if (part == none).all():
            continue
        able = space.possible(at[max(0, c - space.longest):c + CHUNK + widest + space.longest],
                              share)[space.owners]
        if not able.any():
            continue
        part = np.pad(part, (0, -len(part) % STEP), constant_values=none)
        steps = space.folded[np.ix_(part, able)].reshape(-1, STEP, able.sum()).sum(axis=1)
        upto = np.concatenate((np.zeros_like(steps[:1]), np.cumsum(steps, axis=0)))
        for (_, window), pieces in zip(SIZES, space.sizes, strict=True):
            stride = window // 4
            starts = np.arange(c, min(c + CHUNK, max(1, len(at) - window + stride)), stride)
            which = np.flatnonzero(able[pieces]) + pieces.start
            if not len(which) or not len(starts):
                continue
            ends = np.minimum(starts + window, len(at))
            some = slice(np.count_nonzero(able[:pieces.start]),
                         np.count_nonzero(able[:pieces.stop]))
            dots = upto[-((c - ends) // STEP), some] - upto[(starts - c) // STEP, some]
            own = space.lengths[which]
            length = np.sqrt(square[ends] - square[starts]).astype(np.float32)
            close = dots / (own * np.minimum(length[:, None], own))
            for n, piece in np.argwhere(close >= cosine - 1e-3):
                yield (int(starts[n]), int(ends[n]), int(which[piece]),
                       min(1.0, float(close[n, piece])))


def found_in(text: bytes, space: Space, cosine: float, same: float, similar: float,
             answered: float) -> list[tuple]:
    """(item number, cosine, common share, answer share) of each passage found in a text."""
    at = terms(text)
    found: dict[int, tuple] = {}
    for a, b, piece, close in candidates(at, space, cosine, min(same, similar)):
        item = int(space.owners[piece])
        if item in found:
            continue
        passage = space.passages[item]
        words, answer = passage.words, passage.answer
        near = at[max(0, a - len(words)):b + len(words)]
        by = space.weights[words]
        if by[np.isin(words, near)].sum() < min(same, similar) * by.sum() * 0.999:
            continue  # more than any subsequence has
        share = common_share(words.tolist(), near, space.weights)
        has = len(answer & set(near.tolist())) / len(answer) if answer else 0.0
        if share >= same or share >= similar and has >= answered:
            found[item] = (item, close, share, has)
    return list(found.values())


def _blocks(items: Iterator, most: int) -> Iterator[list[Passage]]:
    """Passages with ``most`` pieces together, or one that has more."""
    block: list[Passage] = []
    for row in items:
        passage = Passage.of(row.item_id, row.text.encode())
        if not passage.pieces:
            continue
        if block and sum(len(p.pieces) for p in block) + len(passage.pieces) > most:
            yield block
            block = []
        block.append(passage)
    if block:
        yield block


def contaminated(docs: DataFrame, benchmark: DataFrame, cosine: float = 0.3, same: float = 0.65,
                 similar: float = 0.5, answered: float = 0.5, rank: int = 256,
                 block_items: int = 256) -> DataFrame:
    """Rows (doc_id, row_key, item_id, cosine, common, answer), one per document and passage.

    A document is hit by a passage if the common subsequence has ``same`` of the passage's
    weight, or ``similar`` with ``answered`` of its last sentence's words.  Null and empty
    texts are never hit, null or blank passages hit nothing; repeated rows and passages
    repeat.  Empty tables give an empty result.  Only doc_id, text and item_id, text are
    read.  A block has at most ``rank`` pieces of passages, or one passage, and its
    space as many dimensions as pieces, so it loses nothing and results don't depend on ``block_items`` or on the benchmark's size.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), row_key().alias("row_key"),
                       "text")
    schema = ("doc_id long, row_key long, item_id long, cosine double, common double, "
              "answer double")
    weights = term_weights(docs)
    out = None
    items = (benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text")
             .where(F.length(F.trim(F.coalesce("text", F.lit("")))) > 0)
             .orderBy("item_id", "text").toLocalIterator())
    for block in _blocks(items, min(block_items, rank)):
        shipped = spark.sparkContext.broadcast(_space(spark, block, weights))

        def run(batches: Iterator[pa.RecordBatch], shipped=shipped) -> Iterator[pa.RecordBatch]:
            space = shipped.value
            for batch, texts in text_batches(batches):
                ids, keys = batch.column(0).to_pylist(), batch.column(1).to_pylist()
                hits = [(ids[i], keys[i], space.passages[h[0]].name, *h[1:])
                        for i, text in enumerate(texts)
                        for h in found_in(text, space, cosine, same, similar, answered)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(
                        list(zip(*hits, strict=True)) or [()] * 6,
                        [pa.int64()] * 3 + [pa.float64()] * 3, strict=True)],
                    ["doc_id", "row_key", "item_id", "cosine", "common", "answer"])

        hits = rows.mapInArrow(run, schema)
        out = hits if out is None else settled(out, "hits").union(hits)
    return out if out is not None else spark.createDataFrame([], schema)


def clean_rows(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """``docs`` without the documents that a passage hits; all columns are kept."""
    hits = contaminated(docs, benchmark, **options).select("doc_id", "row_key").dropDuplicates()
    return without_rows(docs, settled(hits, "hits"))


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop(
        "row_key")
