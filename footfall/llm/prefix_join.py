"""Jaccard join of n-gram sets through prefix trees.

The distinct shingles of a text, as 64-bit hashes, are put in one global order, rare ones
first, by counts over all documents.  Two sets that are alike enough share a shingle among
the first of each (the prefix), so the sets are dealt by their prefixes' shared shingles
and every pair to be found meets in some shard.  Equal sets are one class and enter once.
Of twice as many first shingles such sets share more than half, so a class that has fewer in
common with any others is left out before.

A shard stores its sets in a trie.  A set goes down the tree with the overlap that it has
with the path so far, which all sets below share; a subtree is left out as soon as the
sizes in it, the shingles already missed or those that remain cannot reach the threshold,
and where all of it is known to be connected with the set already.

Only connections are wanted, so shards run in two rounds.  First those of the shingle that
most others share with a class, for each class; then the shards of sets that aren't known
to be connected and haven't all met in one shard before.  A shingle shared by very many is
dealt in blocks: block by block in the first round, each two blocks in the second.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from footfall.llm.bitmap import Packed, bitmap, marked
from footfall.llm.common import DOCUMENTS, batches_of, row_key, settled, table, text_batches
from footfall.llm.components import components

#: Counts that order the shingles, by their lowest bits; of fixed size.
COUNTS = 1 << 20
SLICE = 1 << 16
#: Shingles of the sets that a shard holds; beyond it a group is dealt in blocks.
SHARD = 1 << 21
#: Tokens that a task packs at once, and the lowest bits that a bucket's tokens differ in.
PACKED, BUCKET = 1 << 18, 52
_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F], np.uint64)


def shingles(text: bytes, words: int) -> np.ndarray:
    """Distinct hashes of ``words`` words in a row, ascending; of all words where fewer."""
    found = text.lower().split()  # of bytes: A-Z only, ASCII white space only
    if not found:
        return np.zeros(0, np.uint64)
    digest = xxhash.xxh3_64_intdigest
    each = np.fromiter(map(digest, found), np.uint64, len(found))
    width = min(words, len(each))
    out = np.full(len(each) - width + 1, width, np.uint64)
    for i in range(width):
        out += each[i:len(each) - width + 1 + i]
        out *= _MIX[0]
        out ^= out >> np.uint64(29)
        out *= _MIX[1]
        out ^= out >> np.uint64(32)
    return np.unique(out)


def class_of(found: np.ndarray) -> int:
    """64 bits of a set, as a signed long."""
    return xxhash.xxh3_64_intdigest(found.tobytes()) - (1 << 63)


def ordered(found: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """``found`` in the global order: the rarer shingle first, then by hash."""
    return found[np.argsort(counts[found & np.uint64(COUNTS - 1)], kind="stable")]


def prefix(n: int, percent: int) -> int:
    """How many first shingles a set of ``n`` needs, so that a set alike enough has one."""
    return n + 1 - -(-percent * n // 100)


def in_common(n: int, percent: int) -> int:
    """Of the first shingles of a set of ``n``, twice its prefix: how many it has in common
    with any set alike enough, at least (which is by the smallest such set)."""
    least = -(-percent * n // 100)
    return min(2 * prefix(least, percent), least) - prefix(least, percent) + 1


def least_overlap(a: int, b: int, percent: int) -> int:
    """The least intersection of sets of these sizes that are alike enough."""
    return -(-percent * (a + b) // (100 + percent))


def shingled(rows: DataFrame, words: int) -> DataFrame:
    """(doc_id, row_key, n, cid) of each of ``rows``; and from each task, where ``slice`` isn't
    null, in how many of its texts the shingles of each place occur."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "row_key", "n", "cid", "slice", "data"]
        out = np.zeros(COUNTS, np.int64)
        for batch, texts in text_batches(batches):
            found = [shingles(t, words) for t in texts]
            np.add.at(out, (np.concatenate(found) & np.uint64(COUNTS - 1)).astype(np.int64), 1)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(list(map(len, found)), pa.int32()),
                 pa.array(list(map(class_of, found)), pa.int64()),
                 pa.nulls(len(found), pa.int32()), pa.nulls(len(found), pa.binary())], names)
        for i in range(0, COUNTS, SLICE):
            if (part := out[i:i + SLICE]).any():
                yield pa.RecordBatch.from_arrays(
                    [pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.int32()),
                     pa.nulls(1, pa.int64()), pa.array([i // SLICE], pa.int32()),
                     pa.array([zlib.compress(part.tobytes(), 1)], pa.binary())], names)

    return rows.mapInArrow(
        run, "doc_id long, row_key long, n int, cid long, slice int, data binary")


def shingle_counts(parts: DataFrame) -> np.ndarray:
    """The sum of the ``parts`` (slice, data): in how many texts the shingles of a place occur."""
    def added(key: tuple, rows: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(SLICE, np.int64)
        for frame in rows:
            for data in frame["data"]:
                total += np.frombuffer(zlib.decompress(data), np.int64)
        yield pd.DataFrame({"slice": [key[0]], "data": [zlib.compress(total.tobytes(), 1)]})

    schema = "slice int, data binary"
    parts = parts.withColumn("turn", F.spark_partition_id() % 64)
    parts = parts.groupBy("slice", "turn").applyInPandas(added, schema)
    out = np.zeros(COUNTS, np.int64)
    for row in parts.groupBy("slice").applyInPandas(added, schema).toLocalIterator():
        out[row.slice * SLICE:(row.slice + 1) * SLICE] = np.frombuffer(
            zlib.decompress(row.data), np.int64)
    return out


def repeats(lists: DataFrame) -> DataFrame:
    """(token) of all that occurs more than once in ``lists``, one column of lists of longs.

    Tokens travel sorted and packed, in buckets by their highest bits; of one that a task has
    often, two go.
    """
    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def out():
            tokens = np.sort(np.concatenate(held).view(np.uint64))
            often = np.zeros(len(tokens), bool)
            often[2:] = tokens[2:] == tokens[:-2]
            tokens = tokens[~often]
            bucket = (tokens >> np.uint64(BUCKET)).astype(np.int32)
            starts = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1])))
            ends = np.append(starts, len(tokens)).astype(np.int32) * 8
            return pa.RecordBatch.from_arrays(
                [pa.array(bucket[starts]), pa.Array.from_buffers(
                    pa.binary(), len(starts), [None, pa.py_buffer(ends), pa.py_buffer(tokens)])],
                ["bucket", "tokens"])

        for batch in batches:
            held.append(batch.column(0).flatten().to_numpy())
            size += len(held[-1])
            if size >= PACKED:
                yield out()
                held, size = [], 0
        if size:
            yield out()

    def twice(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []

        def out():
            tokens = np.sort(np.frombuffer(b"".join(held), np.int64))
            return pa.RecordBatch.from_arrays(
                [pa.array(np.unique(tokens[1:][tokens[1:] == tokens[:-1]]))], ["token"])

        for batch in batches:
            for bucket, tokens in zip(*(batch.column(i).to_pylist() for i in (0, 1)), strict=True):
                if bucket != now and held:
                    yield out()
                    held = []
                now = bucket
                held.append(tokens)
        if held:
            yield out()

    return (lists.mapInArrow(packed, "bucket int, tokens binary").repartition("bucket")
            .sortWithinPartitions("bucket").mapInArrow(twice, "token long"))


class Node:
    """A run of shingles that all sets below share, and the sizes of those sets."""

    __slots__ = ("run", "children", "ends", "low", "high", "group")

    def __init__(self, run: np.ndarray, size: int, group: int):
        self.run, self.children, self.ends = run, {}, None
        self.low = self.high = size
        self.group = group  # what all sets below are connected with; None where they aren't


class Trie:
    """Sets in the global order as paths, and which of them are known to be connected."""

    def __init__(self, percent: int):
        self.percent = percent
        self.top: dict[int, Node] = {}
        self.parent: dict[int, int] = {}

    def root(self, at: int) -> int:
        parent = self.parent
        parent.setdefault(at, at)
        while parent[at] != at:
            parent[at] = at = parent[parent[at]]
        return at

    def insert(self, name: int, group: int, found: np.ndarray) -> None:
        size, at, children = len(found), 0, self.top
        while True:
            node = children.get(int(found[at]))
            if node is None:
                node = children[int(found[at])] = Node(found[at:], size, group)
                node.ends = name
                return
            same = min(len(node.run), size - at)
            apart = np.flatnonzero(node.run[:same] != found[at:at + same])
            same = int(apart[0]) if len(apart) else same
            if same < len(node.run):  # the run is cut: what follows becomes a child
                rest = Node(node.run[same:], 0, node.group)
                rest.children, rest.ends, rest.low, rest.high = (
                    node.children, node.ends, node.low, node.high)
                node.run, node.children, node.ends = node.run[:same], {int(rest.run[0]): rest}, None
            node.low, node.high = min(node.low, size), max(node.high, size)
            if node.group is not None and self.root(node.group) != self.root(group):
                node.group = None
            at += same
            if at == size:
                node.ends = name
                return
            children = node.children

    def links(self, name: int, group: int, found: np.ndarray) -> Iterator[tuple[int, int]]:
        """Links that connect a set with all sets of the trie that are alike enough."""
        size, percent = len(found), self.percent
        least, most = -(-percent * size // 100), size * 100 // percent
        places = dict(zip(found.tolist(), range(size)))
        stack = [(node, 0, 0) for node in self.top.values()]
        while stack:
            node, depth, overlap = stack.pop()
            if node.high < least or node.low > most or (
                    node.group is not None and self.root(node.group) == self.root(group)):
                continue
            high, low = min(node.high, most), max(node.low, least)
            missable = high - least_overlap(size, high, percent)
            need = least_overlap(size, low, percent)
            if self._walked(node.run, places, depth, overlap, high, missable, need, size):
                continue
            overlap += self.shared
            depth += len(node.run)
            if node.ends is not None and overlap >= least_overlap(size, depth, percent):
                yield name, node.ends
                self.parent[self.root(self.of[node.ends])] = self.root(group)
            stack += [(child, depth, overlap) for child in node.children.values()]

    def _walked(self, run, places, depth, overlap, high, missable, need, size) -> bool:
        """Follows a run; true where nothing below can be alike enough.  Sets ``shared``."""
        shared = 0
        for i in range(0, len(run), 64):
            for token in run[i:i + 64].tolist():
                depth += 1
                place = places.get(token)
                if place is None:
                    if depth - overlap - shared > missable:
                        return True
                else:
                    shared += 1
                    if overlap + shared + min(high - depth, size - place - 1) < need:
                        return True
        self.shared = shared
        return False

    of: dict[int, int]


def joined(rows: list[tuple[int, int, int, np.ndarray]], percent: int) -> Iterator[tuple[int, int]]:
    """Links among the sets (block, name, known group, shingles) of a shard.

    Sets of one block are joined with each other; with two blocks, those of the second
    with the first.
    """
    trie = Trie(percent)
    trie.of = {name: group for _, name, group, _ in rows}
    first = rows[0][0]
    alone = rows[-1][0] == first
    done = set()
    for block, name, group, found in rows:
        if name in done:
            continue
        done.add(name)
        if alone or block != first:
            yield from trie.links(name, group, found)
        if block == first:
            trie.insert(name, group, found)


def _searched(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, []

        def out():
            found = list(joined(held, percent)) if len(held) > 1 else []
            if found:
                u, v = zip(*found, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())],
                                                 ["u", "v"])

        for batch in batches:
            keys = zip(*(batch.column(c).to_pylist() for c in ("token", "i", "j")), strict=True)
            rest = zip(*(batch.column(c).to_pylist() for c in ("block", "cid", "root", "tokens")),
                       strict=True)
            for now, (block, cid, root, tokens) in zip(keys, rest, strict=True):
                if now != key:
                    yield from out()
                    key, held = now, []
                held.append((block, cid, root, np.frombuffer(tokens, np.uint64)))
        yield from out()
    return run


def _written(df: DataFrame, name: str) -> DataFrame:
    """:func:`settled`, where rows hold whole texts, prefixes or sets: few reach Python at once."""
    with batches_of(df.sparkSession, DOCUMENTS):
        return settled(df, name)


def _shards(dealt: DataFrame, sets: DataFrame, percent: int, name: str) -> DataFrame:
    """Links (u, v) found in the shards of ``dealt`` (token, i, j, block, cid, root).

    Both sides are shuffled even where one is small, so a plan and its disk are the same in
    proportion at any size.
    """
    rows = (dealt.join(sets.hint("merge"), "cid").repartition("token", "i", "j")
            .sortWithinPartitions("token", "i", "j", "block", "n"))
    return _written(rows.select("token", "i", "j", "block", "cid", "root", "tokens")
                    .mapInArrow(_searched(percent), "u long, v long"), name)


def _chosen(batches: Iterator[pa.RecordBatch], found) -> Iterator[pa.RecordBatch]:
    """The rows whose first column, a hash, may be in the bitmap ``found``, a broadcast."""
    for batch in batches:
        yield batch.filter(pa.array(marked(found.value, batch.column(0).to_numpy())))


def _block(salt: int) -> Column:
    return F.pmod(F.xxhash64("cid", F.lit(salt)), F.col("blocks")).cast("int")


def jaccard_components(docs: DataFrame, words: int = 3, percent: int = 90,
                       shard: int = SHARD) -> DataFrame:
    """One row per document: doc_id, row_key, n_shingles, component_id and root, a long that
    only the rows of one component share (null without shingles).

    Texts are lower-cased (A-Z) and cut at ASCII white space.  A text of fewer words than
    ``words`` is one shingle; null, empty and blank texts have none and are linked with
    nothing.  Sets are linked if ``100 * intersection >= percent * union``; equal sets
    always are.  ``component_id`` is the smallest non-null doc_id reachable by links, null
    if there's none; rows that share an id are rows of their own, rows alike come out
    repeated.  Texts are read whole.  Shingles and sets count as equal if their 64-bit
    hashes are.  Only doc_id and text are read.  An empty table gives an empty result.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), row_key().alias("row_key"),
                       "text")
    context = docs.sparkSession.sparkContext
    read = _written(shingled(rows, words), "shingled")
    counts = context.broadcast(Packed(shingle_counts(
        read.where("slice IS NOT NULL").select("slice", "data"))))
    given = read.where("slice IS NULL").select("doc_id", "row_key", "n", "cid")
    # classes of equal sets; a large one is merged map-side
    order = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "row_key")
    classes = settled(
        given.where("n > 0").groupBy("cid").agg(F.min(order).alias("least"), F.max("n").alias("n"))
        .select("cid", "n", "least.doc_id", "least.row_key"), "classes")
    heads = context.broadcast(bitmap(classes.select("row_key")))

    def prefixed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Prefixes of one row of each class; of a few more that the bitmap lets through."""
        for _, texts in text_batches(_chosen(batches, heads)):
            found = [f for f in (shingles(t, words) for t in texts) if len(f)]
            first = [ordered(f, counts.value.array)[:2 * prefix(len(f), percent)].view(np.int64)
                     for f in found]
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(map(class_of, found)), pa.int64()),
                 pa.array(list(map(len, found)), pa.int32()),
                 pa.array(first, pa.list_(pa.int64()))], ["cid", "n", "prefix"])

    prefixes = _written(rows.select("row_key", "text").mapInArrow(
        prefixed, "cid long, n int, prefix array<long>"), "prefixes")
    shipped = context.broadcast(bitmap(_written(repeats(prefixes.select("prefix")), "repeats")))

    def enough(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Prefixes, shingle by shingle, of classes that may have enough in common."""
        bits = shipped.value
        for batch in batches:
            lists = batch.column(2)
            ends = lists.offsets.to_numpy()
            found = lists.values.to_numpy()
            may = marked(bits, found)
            upto = np.concatenate(([0], np.cumsum(may)))
            n = batch.column(1).to_numpy()
            least = np.fromiter((in_common(x, percent) for x in n.tolist()), np.int64, len(n))
            good = upto[ends[1:]] - upto[ends[:-1]] >= least
            row = np.repeat(np.arange(len(n)), np.diff(ends))
            places = np.arange(ends[0], ends[-1])
            take = may[places] & good[row]
            row, places = row[take], places[take]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(row)), batch.column(1).take(pa.array(row)),
                 pa.array((places - ends[row]).astype(np.int32)), pa.array(found[places])],
                ["cid", "n", "at", "token"])

    # exact now: of the shingles that are left, those that occur in several classes
    met = (prefixes.mapInArrow(enough, "cid long, n int, at int, token long")
           .repartition("token").dropDuplicates(["token", "cid"]))
    by_token = Window.partitionBy("token")
    met = _written(met.withColumn("classes", F.count("*").over(by_token)).where("classes > 1")
                   .drop("classes"), "in-common")
    length = F.expr(f"n + 1 - ({percent} * n + 99) div 100")  # as in prefix, in_common
    kept = settled(
        met.groupBy("cid", "n").agg(F.count("*").alias("common"))
        .withColumn("small", F.expr(f"({percent} * n + 99) div 100"))
        .withColumn("length", F.expr(f"small + 1 - ({percent} * small + 99) div 100"))
        .where("common > least(2 * length, small) - length").select("cid"), "classes-left")
    having = met.where(F.col("at") < length).join(kept, "cid").select("cid", "n", "token")
    # shingles that the same classes share make the same shard: one of them is enough
    shared = settled(
        having.groupBy("token").agg(
            F.count("*").alias("sharing"), F.sum("n").alias("weight"),
            F.bit_xor(F.xxhash64("cid")).alias("a"), F.bit_xor(F.xxhash64("cid", F.lit(1))).alias("b"))
        .where("sharing > 1").groupBy("sharing", "weight", "a", "b")
        .agg(F.min("token").alias("token"))
        .select("token", "sharing", F.ceil(F.col("weight") / shard).cast("int").alias("blocks")),
        "shards")
    members = settled(having.select("cid", "token").join(shared, "token"), "members")

    # whole sets, from the texts again, of one row of each class that shares something; a row
    # that the bitmap lets through by chance finds no shard
    wanted = members.select("cid").distinct().join(classes, "cid").select("row_key")
    chosen = context.broadcast(bitmap(wanted))

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, texts in text_batches(_chosen(batches, chosen)):
            found = [shingles(t, words) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(map(class_of, found)), pa.int64()),
                 pa.array(list(map(len, found)), pa.int32()),
                 pa.array([ordered(f, counts.value.array).tobytes() for f in found], pa.binary())],
                ["cid", "n", "tokens"])

    sets = _written(rows.select("row_key", "text").mapInArrow(
        whole, "cid long, n int, tokens binary"), "sets")

    best = members.groupBy("cid").agg(F.max(F.struct("sharing", "blocks", "token")).alias("best"))
    first = settled(members.join(best.select("best.token").distinct(), "token", "left_semi"),
                    "members-first")
    places = F.when(F.col("blocks") == 1, F.array(F.lit(0))).otherwise(
        F.array(_block(1), F.col("blocks") + _block(2)))
    dealt = (first.select("cid", "token", F.explode(places).alias("i"))
             .select("cid", "token", "i", F.col("i").alias("j"), F.col("i").alias("block"),
                     F.col("cid").alias("root")))
    near = _shards(dealt, sets, percent, "links-first")
    known = settled(components(near), "components-first")
    grouped = settled(members.join(known.withColumnRenamed("node", "cid"), "cid", "left")
                      .withColumn("root", F.coalesce("root", "cid")), "members-known")
    open_ = grouped.join(grouped.groupBy("token").agg(F.min("root").alias("a"), F.max("root").alias("b"))
                         .where("a <> b").select("token"), "token", "left_semi")
    # a shingle whose classes all met in one shard of the first round has nothing to add
    whole_ = first.where("blocks = 1").select("cid", F.col("token").alias("shard"))
    covered = (open_.join(whole_, "cid").groupBy("token", "sharing", "shard").count()
               .where("count = sharing").select("token").distinct())
    pairs = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda j: F.struct(
        F.least("block", j).alias("i"), F.greatest("block", j).alias("j")))
    dealt = (open_.join(covered, "token", "left_anti").withColumn("block", _block(3))
             .select("cid", "token", "root", "block", F.inline(pairs)))
    found = components(near.union(_shards(dealt, sets, percent, "links")))

    labelled = classes.join(found.withColumnRenamed("node", "cid"), "cid", "left").select(
        "cid", "doc_id", F.coalesce("root", "cid").alias("root"))
    heads = labelled.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    of = settled(labelled.join(heads, "root").select("cid", "root", "component_id"),
                 "class-components")
    return given.join(of, "cid", "left").select(
        "doc_id", "row_key", F.col("n").cast("long").alias("n_shingles"), "root",
        F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def op13_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents")).drop("row_key", "root")


SQL = r"""
WITH RECURSIVE cut AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 1),
      lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) END AS s FROM cut),
sizes AS (SELECT doc_id, len(s) AS n FROM sets),
each AS (SELECT doc_id, unnest(s) AS t FROM sets),
links AS (
  SELECT u, v FROM (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS shared FROM each a
    JOIN each b ON a.t = b.t AND a.doc_id <> b.doc_id GROUP BY 1, 2)
  JOIN sizes x ON x.doc_id = u JOIN sizes y ON y.doc_id = v
  WHERE 100 * shared >= 90 * (x.n + y.n - shared)),
reached AS (
  SELECT doc_id AS u, doc_id AS v FROM sets
  UNION
  SELECT r.u, l.v FROM reached r JOIN links l ON l.u = r.v)
SELECT doc_id, n AS n_shingles, component_id
FROM sizes JOIN (SELECT u, min(v) AS component_id FROM reached GROUP BY 1) ON u = doc_id
"""
