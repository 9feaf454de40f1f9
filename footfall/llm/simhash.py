"""SimHash near-duplicates through a vantage-point tree.

Fingerprints are split by their Hamming distance from vantage points: within the radius
to the inner branch, else to the outer one.  A query goes down both branches where its
ball crosses the radius (triangle inequality), else one is pruned, so all pairs within
the distance are found.  The upper tree, built from a bounded sample, assigns shards; a
fingerprint lives in one shard and queries others that its ball touches.  A shard
builds its own lower tree, and its queries stream through.

Copies share a fingerprint and enter the tree once.  A shard reports no pairs but a
spanning set of links: a query is linked once to each group of members not yet known
to be connected.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from footfall.llm.common import row_key, settled, table, text_batches, unused
from footfall.llm.components import components
from footfall.llm.prefix_join import class_of, jaccard_components, shingles

SEED = 42
#: Members of a local leaf, which are compared one by one.
LEAF = 256
#: Queries compared at once; bounds the memory of a comparison.
QUERIES = 4096


def fingerprint(text: bytes, words_per_shingle: int) -> int:
    """64-bit SimHash: a bit is set if over half the shingles' XXH64 have it."""
    words = text.lower().split()  # of bytes: A-Z only, ASCII white space only
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= words_per_shingle:
        hashes = np.array([xxhash.xxh64_intdigest(joined, SEED)], dtype="<u8")
    else:
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
        starts = np.concatenate(([0], ends[:-1] + 1))
        digest = xxhash.xxh64_intdigest
        hashes = np.array([digest(joined[a:b], SEED) for a, b in zip(
            starts[:1 - words_per_shingle].tolist(), ends[words_per_shingle - 1:].tolist(),
            strict=True)], dtype="<u8")
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 14):
        part = hashes[at:at + (1 << 14)].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, words_per_shingle: int) -> DataFrame:
    """(doc_id, row_key, fp) of each row, fp as a signed long."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in text_batches(batches):
            fps = np.array([fingerprint(t, words_per_shingle) for t in texts], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(fps.view(np.int64))],
                ["doc_id", "row_key", "fp"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), row_key().alias("row_key"),
                       "text")
    return rows.mapInArrow(run, "doc_id long, row_key long, fp long")


def _distance(a: np.ndarray, b) -> np.ndarray:
    return np.bitwise_count(np.bitwise_xor(a, b))


def upper_tree(sample: np.ndarray, depth: int):
    """Nested (vantage, radius, inner, outer) with shard numbers as leaves, in order."""
    count = iter(range(1 << depth))

    def grow(points: np.ndarray, left: int):
        if not left:
            return next(count)
        vantage = points[0] if len(points) else np.uint64(0)
        away = _distance(points, vantage)
        radius = int(np.median(away)) if len(points) else 32
        return (vantage, radius, grow(points[away <= radius], left - 1),
                grow(points[away > radius], left - 1))

    return grow(sample, depth)


def route(node, fps: np.ndarray, home: np.ndarray, within: int):
    """Yields (shard, fps, whether each lives there) for every shard to be asked.

    A pair across a border is found from one side: what lives inside asks the outer branch
    if its ball crosses the radius, what lives outside doesn't ask the inner one.  A
    fingerprint that is only asking goes down every branch its ball touches.
    """
    if not len(fps):
        return
    if not isinstance(node, tuple):
        yield node, fps, home
        return
    vantage, radius, inner, outer = node
    away = _distance(fps, vantage).astype(np.int16)
    near = away <= np.where(home, radius, radius + within)
    far = away > radius - within
    yield from route(inner, fps[near], home[near], within)
    yield from route(outer, fps[far], home[far] & (away[far] > radius), within)


class Shard:
    """The members of one shard in a vantage-point tree, and what links they have."""

    def __init__(self, members: np.ndarray, within: int):
        self.members, self.within = members, within
        self.group = np.arange(len(members))
        self.tree = self._grow(np.arange(len(members)), 0)

    def _grow(self, at: np.ndarray, depth: int):
        if len(at) <= LEAF or depth > 40:
            return at
        vantage = self.members[at[len(at) // 2]]
        away = _distance(self.members[at], vantage)
        radius = int(np.median(away))
        if (away <= radius).all():
            radius -= 1
        if not (away <= radius).any():
            return at
        return (vantage, radius, self._grow(at[away <= radius], depth + 1),
                self._grow(at[away > radius], depth + 1))

    def _hits(self, node, fps: np.ndarray, rows: np.ndarray):
        if not len(rows):
            return
        if not isinstance(node, tuple):
            step = max(1, (1 << 20) // max(1, len(node)))
            for i in range(0, len(rows), step):
                q, m = np.nonzero(_distance(fps[rows[i:i + step], None],
                                            self.members[node][None, :]) <= self.within)
                yield rows[i:i + step][q], node[m]
            return
        vantage, radius, inner, outer = node
        away = _distance(fps[rows], vantage).astype(np.int16)
        yield from self._hits(inner, fps, rows[away <= radius + self.within])
        yield from self._hits(outer, fps, rows[away > radius - self.within])

    def links(self, fps: np.ndarray):
        """Links of the queries ``fps`` to groups of members; joins the groups they meet."""
        for q, m in self._hits(self.tree, fps, np.arange(len(fps))):
            if not len(q):
                continue
            pairs = np.unique(np.stack([q, self.group[m]], axis=1), axis=0)
            rows, roots = pairs[:, 0], pairs[:, 1]
            apart = fps[rows] != self.members[roots]
            yield fps[rows[apart]], self.members[roots[apart]]
            again = np.flatnonzero(rows[1:] == rows[:-1])
            for i in again:  # two groups that one query meets become one
                a, b = self._root(roots[i]), self._root(roots[i + 1])
                self.group[max(a, b)] = min(a, b)
            if len(again):
                while not np.array_equal(flat := self.group[self.group], self.group):
                    self.group = flat

    def _root(self, at: int) -> int:
        while self.group[at] != at:
            at = self.group[at]
        return at


def _routed(tree, within: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = batch.column(0).to_numpy().view(np.uint64)
            for shard, touched, home in route(tree, fps, np.ones(len(fps), bool), within):
                both = np.concatenate([touched[home], touched])
                asks = np.arange(len(both)) >= home.sum()
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(both), shard, np.int32)), pa.array(asks),
                     pa.array(both.view(np.int64))], ["shard", "asks", "fp"])
    return run


def _searched(within: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held, shard = None, [], None
        for batch in batches:
            numbers, asks = batch.column(0).to_numpy(), batch.column(1).to_numpy(
                zero_copy_only=False)
            fps = batch.column(2).to_numpy().view(np.uint64)
            cuts = np.flatnonzero(numbers[1:] != numbers[:-1]) + 1
            for a, b in zip([0, *cuts], [*cuts, len(numbers)], strict=True):
                if a == b:
                    continue
                if numbers[a] != at:
                    at, held, shard = numbers[a], [], None
                members, queries = fps[a:b][~asks[a:b]], fps[a:b][asks[a:b]]
                if len(members):
                    held.append(members)
                if not len(queries) or not held and shard is None:
                    continue
                if shard is None:
                    shard, held = Shard(np.concatenate(held), within), []
                for i in range(0, len(queries), QUERIES):
                    for u, v in shard.links(queries[i:i + QUERIES]):
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(u.view(np.int64)), pa.array(v.view(np.int64))], ["u", "v"])
    return run


def links(distinct: DataFrame, within: int = 4, shard_rows: int = 32_768,
          sample_rows: int = 16_384) -> DataFrame:
    """Links (u, v) that connect all fingerprints of ``distinct`` (fp) within the distance."""
    rows = distinct.count()
    depth = max(0, int(np.ceil(np.log2(max(1, rows) / shard_rows))))
    sample = [r[0] for r in distinct.orderBy(F.xxhash64("fp", F.lit("sample")), "fp")
              .limit(sample_rows).collect()]  # bounded: 16,384 longs
    tree = upper_tree(np.array(sample, dtype=np.int64).view(np.uint64), depth)
    routed = distinct.select("fp").mapInArrow(_routed(tree, within),
                                              "shard int, asks boolean, fp long")
    return (routed.repartition(1 << depth, "shard").sortWithinPartitions("shard", "asks")
            .mapInArrow(_searched(within), "u long, v long"))


def near_duplicates(docs: DataFrame, words_per_shingle: int = 4, within: int = 4,
                    shard_rows: int = 32_768) -> DataFrame:
    """One row per document: doc_id, row_key, fp (long), fingerprint (hex), component_id
    and root, the component's least fingerprint.

    Texts of fewer words are one shingle; null, empty and blank texts have fingerprint
    zero and are linked like any other.  ``component_id`` is the smallest non-null id of
    the component (null if it has none).  Repeated rows come out repeated.  Only doc_id
    and text are read.  An empty table gives an empty result.
    """
    rows = settled(fingerprints(docs, words_per_shingle), "fingerprints")
    distinct = settled(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    found = components(links(distinct, within, shard_rows))
    labelled = distinct.join(found, distinct["fp"] == found["node"], "left").select(
        "fp", "least", F.coalesce("root", "fp").alias("root"))
    heads = labelled.groupBy("root").agg(F.min("least").alias("component_id"))
    of = settled(labelled.join(heads, "root"), "components").select("fp", "root", "component_id")
    return rows.join(of, "fp").select("doc_id", "row_key", "fp", "root", "component_id",
                                      _hexed(F.col("fp")).alias("fingerprint"))


def _hexed(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def _first_of_groups(docs: DataFrame, grouped: DataFrame) -> DataFrame:
    """``docs`` with one row of each group of ``grouped`` (doc_id, row_key, root)."""
    key, turn, one, other = unused(docs, "row__key", "turn__", "one__id", "one__key")
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "row_key")
    kept = (grouped.groupBy("root").agg(F.min(order).alias("first"))
            .select(F.col("first.doc_id").alias(one), F.col("first.row_key").alias(other)))
    alike = Window.partitionBy("doc_id", key).orderBy(F.xxhash64(*docs.columns))
    return (docs.withColumn(key, row_key()).withColumn(turn, F.row_number().over(alike))
            .where(F.col(turn) == 1)
            .join(kept, F.col("doc_id").eqNullSafe(F.col(one))
                  & (F.col(key) == F.col(other)), "left_semi")
            .select(*docs.columns))


def kept_rows(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with one row of each near-duplicate group: that with the smallest id.

    Rows without an id come last; rows that share the smallest id are told apart by their
    text, and of rows alike in both one stays, by a hash of all columns.  All columns of
    ``docs`` are kept.
    """
    return _first_of_groups(docs, near_duplicates(docs, **options))


def verified_copies(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, row_key, root) of each row: the groups that rows alike are linked into.

    Rows are linked if the sets of their shingles of ``words`` words have a Jaccard
    similarity of ``percent`` or more; equal sets always are, so texts without words form
    one group, and texts of fewer words are one shingle.  All such links count: no distance
    of fingerprints holds every pair at 80 % (14 bits miss one in some fifteen, and vantage
    points prune nothing there), so the candidates are the prefix-tree join's, which misses
    none.  Texts are read whole; rows alike come out repeated.  An empty table gives none.
    """
    blank = class_of(shingles(b"", words))
    return jaccard_components(docs, words, percent).select(
        "doc_id", "row_key", F.coalesce("root", F.lit(blank)).alias("root"))


def distinct_rows(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with one row of each group of :func:`verified_copies`, as :func:`kept_rows`."""
    return _first_of_groups(docs, verified_copies(docs, **options))


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents")).select(
        "doc_id", "fingerprint", "component_id")
