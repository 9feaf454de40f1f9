"""Merkle manifest of a dataset, built by incremental witnesses.

Every row is a leaf.  The leaves of a source, in order, and then the sources' subroots are
folded three by three up to one root.  Leaves are appended one after the other: a node
joins an open run, takes the siblings before it as the next part of the witness of every
leaf beneath it, and extends the witnesses of those siblings by itself; a run that is full
closes to a node of the next level.  So a witness is whole when the last node is appended,
and nothing is walked again.

Appends are aligned to blocks of 3^7 leaves, each one stream in one task, however many
rows a source has.  The roots of the blocks are appended in the same way, round by round,
until a source is one node; what a round adds to a block's root is added to the witness of
every leaf in it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from footfall.llm.common import settled, table

#: Nodes that close to one of the next level.
FAN = 3
#: Nodes of a block, seven levels that one task folds.
BLOCK = FAN ** 7
#: Rows handed back at once.
ROWS = 4096
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def parent(run: Sequence[bytes]) -> bytes:
    """The digest of a run's digests, taken over their lowercase hex text."""
    return hashlib.sha256(b"".join(run).hex().encode()).digest()


class Appender:
    """Appends the nodes of a block of ``nodes`` and keeps the witness of each.

    A witness is the digests of the siblings, level by level, left to right.
    """

    def __init__(self, nodes: int):
        self.levels = 0
        while FAN ** self.levels < nodes:
            self.levels += 1
        self.open: list[list[tuple[bytes, list[bytearray]]]] = [[] for _ in range(self.levels + 1)]
        self.witnesses: list[bytearray] = []

    def append(self, node: bytes) -> None:
        self.witnesses.append(bytearray())
        self._join(0, node, self.witnesses[-1:])

    def _join(self, level: int, node: bytes, beneath: list[bytearray]) -> None:
        run = self.open[level]
        before = b"".join(n for n, _ in run)
        for witness in beneath:
            witness += before
        for _, leaves in run:
            for witness in leaves:
                witness += node
        run.append((node, beneath))
        if len(run) == FAN and level < self.levels:
            self._close(level)

    def _close(self, level: int) -> None:
        run, self.open[level] = self.open[level], []
        self._join(level + 1, parent([n for n, _ in run]), [w for _, ws in run for w in ws])

    def root(self) -> bytes:
        """Closes the runs that have fewer nodes; no more can be appended."""
        for level in range(self.levels):
            if self.open[level]:
                self._close(level)
        return self.open[-1][0][0]


def fold(node: bytes, witness: bytes, at: int, nodes: int) -> tuple[bytes, bytes]:
    """The root that ``node``, number ``at`` of ``nodes``, gives with its witness, and what
    of the witness lies above that root."""
    while nodes > 1:
        first = at // FAN * FAN
        others = 32 * (min(FAN, nodes - first) - 1)
        left = 32 * (at - first)
        node = parent([witness[:left], node, witness[left:others]])
        witness, at, nodes = witness[others:], at // FAN, -(-nodes // FAN)
    return node, witness


def leaf(fields: Sequence[Column]) -> Column:
    """Digest of a row: ``-`` for null, else byte count, a colon and the value's text."""
    def framed(value: Column) -> Column:
        text = value.cast("string")
        return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text),
                          F.lit("-"))

    return F.unhex(F.sha2(F.concat(*map(framed, fields)).cast("binary"), 256))


def positions(rows: DataFrame, order: Sequence[str], name: str) -> DataFrame:
    """``rows`` with ``at``, the place in ``order`` (nulls first) within ``group``, and
    ``nodes``, the rows of the group.

    Rows are range-partitioned, so a large group is spread over tasks; a row's place is its
    place in its partition plus the group's rows in partitions before.
    """
    keys = ["group", *order]
    placed = settled(
        rows.repartitionByRange(*[F.asc_nulls_first(k) for k in keys])
        .sortWithinPartitions(*[F.asc_nulls_first(k) for k in keys])
        .withColumn("turn", F.monotonically_increasing_id()), name)
    part = F.shiftright("turn", 33)
    parts = placed.groupBy("group", part.alias("part")).agg(
        F.min("turn").alias("first"), F.count("*").alias("rows"))
    whole = Window.partitionBy("group")
    parts = settled(parts.select(
        "group", "part", "first", F.sum("rows").over(whole).alias("nodes"),
        (F.sum("rows").over(whole.orderBy("part")) - F.col("rows")).alias("before")), "group-parts")
    return (placed.withColumn("part", part).join(parts, ["group", "part"])
            .withColumn("at", F.col("turn") - F.col("first") + F.col("before"))
            .drop("turn", "part", "first", "before"))


def _appended(size: int):
    """Blocks in order -> their rows with ``witness`` and the block's ``root``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        witnesses: list[bytearray] = []
        roots: list[bytes] = []
        key, tree = None, None

        def close():
            if tree is not None:
                roots.extend([tree.root()] * len(tree.witnesses))
                witnesses.extend(tree.witnesses)

        def done():
            rows = pa.Table.from_batches(held)
            n = len(roots)
            ready = rows.slice(0, n).append_column("witness", pa.array(witnesses, pa.binary()))
            yield from ready.append_column("root", pa.array(roots, pa.binary())).to_batches(ROWS)
            held[:] = rows.slice(n).to_batches()
            witnesses.clear()
            roots.clear()

        for batch in batches:
            held.append(batch)
            for group, at, nodes, node in zip(*(batch.column(c).to_pylist() for c in (
                    "group", "at", "nodes", "node")), strict=True):
                if (group, at // size) != key:
                    close()
                    key = group, at // size
                    tree = Appender(min(nodes, size))
                tree.append(node)
            if len(roots) >= ROWS:
                yield from done()
        close()
        if roots:
            yield from done()

    return run


def witnessed(nodes: DataFrame, name: str, size: int) -> DataFrame:
    """``nodes`` (group, at, nodes, node and more) with witness and root of their group."""
    block = F.floor(F.col("at") / size)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in nodes.schema)
    rows = settled(
        nodes.repartition("group", block).sortWithinPartitions("group", "at")
        .mapInArrow(_appended(size), f"{fields}, witness binary, root binary"), name)
    most = rows.agg(F.max("nodes")).first()[0]
    if most is None or most <= size:
        return rows
    blocks = rows.where(F.col("at") % size == 0).select(
        "group", block.alias("at"), F.ceil(F.col("nodes") / size).alias("nodes"),
        F.col("root").alias("node"))
    above = witnessed(blocks, name, size).select(
        "group", F.col("at").alias("block"), F.col("witness").alias("more"),
        F.col("root").alias("top"))
    return (rows.withColumn("block", block).join(above, ["group", "block"])
            .select(*nodes.columns, F.concat("witness", "more").alias("witness"),
                    F.col("top").alias("root")))


def manifest(docs: DataFrame, claim: Column | None = None, size: int = BLOCK) -> DataFrame:
    """One row per document: its place, leaf, witness, subroot and root.

    Columns: doc_id, source, ``at`` and ``nodes`` (the leaf's place and the leaves of its
    source), ``source_at`` and ``sources`` (the source's place), leaf, subroot, root and
    witness (all binary; the witness leads over the subroot to the root).  ``claim``, an
    expression over ``docs``, is another leaf to be checked against the manifest; null
    stands for the leaf itself.  ``size``, a power of three, is the leaves of a block.

    Leaves of a source are in the order of doc_id, those without one first, those that
    share one by their digest; rows alike have equal leaves and places next to each other.
    A null source is one of its own and comes first.  Null and empty texts are different
    leaves, texts are read whole.  Only the five columns of a leaf are read.  An empty
    table has no root and gives no rows.
    """
    rows = settled(docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.concat(F.lit("="), "source"), F.lit("")).alias("group"),
        leaf([F.col(c) for c in FIELDS]).alias("node"),
        (F.lit(None).cast("binary") if claim is None else claim).alias("claim")), "leaves")
    leaves = witnessed(positions(rows, ["doc_id", "node"], "leaves-ordered"), "witnesses", size)
    heads = leaves.where("at = 0").select(F.lit("").alias("group"), F.col("group").alias("of"),
                                          F.col("root").alias("node"))
    sources = witnessed(positions(heads, ["of"], "sources-ordered"), "source-witnesses",
                        size).select(
        F.col("of").alias("group"), F.col("at").alias("source_at"),
        F.col("nodes").alias("sources"), F.col("witness").alias("last"), F.col("root").alias("top"))
    return leaves.join(sources, "group").select(
        "doc_id", F.when(F.col("group") != "", F.substring("group", 2, 1 << 30)).alias("source"),
        "at", "nodes", "source_at", "sources", F.col("node").alias("leaf"), "claim",
        F.col("root").alias("subroot"), F.col("top").alias("root"),
        F.concat("witness", "last").alias("witness"))


def verified(rows: DataFrame) -> DataFrame:
    """Manifest rows with digests in hex, ``proof_sha256``, ``folded_root`` and ``verified``.

    Each claim (or leaf, where there's none) is folded with the leaf's own witness.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                witness = row["witness"]
                node, rest = fold(row["leaf"] if row["claim"] is None else row["claim"],
                                  witness, row["at"], row["nodes"])
                node, _ = fold(node, rest, row["source_at"], row["sources"])
                out.append((row["doc_id"], row["leaf"].hex(), row["subroot"].hex(),
                            row["root"].hex(), hashlib.sha256(witness.hex().encode()).hexdigest(),
                            node.hex(), node == row["root"]))
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*out, strict=True), [
                    pa.int64(), *[pa.string()] * 5, pa.bool_()], strict=True)],
                ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"])

    return rows.mapInArrow(
        run, "doc_id long, leaf string, subroot string, root string, proof_sha256 string, "
             "folded_root string, verified boolean")


def without_line_breaks(docs: DataFrame) -> Column:
    """The leaf of a row whose text lost its line breaks, for every second row by crc32 of
    its doc_id; null where that changes nothing.  Rows without doc_id are left alone."""
    chosen = F.crc32(docs["doc_id"].cast("string").cast("binary")) % 2 == 0
    fields = [F.replace("text", F.lit("\n"), F.lit("")) if c == "text" else F.col(c)
              for c in FIELDS]
    return F.when(chosen & F.contains("text", F.lit("\n")), leaf(fields))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return verified(manifest(docs, without_line_breaks(docs)))


def _framed(name: str) -> str:
    return f"coalesce(strlen({name}::VARCHAR) || ':' || {name}::VARCHAR, '-')"


def _folds(name: str, base: str, by: str) -> str:
    """Recursion over every leaf's node: the run's three nodes by window, then their digest."""
    return f"""{name} AS (
  SELECT * FROM {base}
  UNION ALL
  SELECT doc_id, source, leaf, spot // 3, (n + 2) // 3, sha256(h0 || h1 || h2),
    proof || CASE spot % 3 WHEN 0 THEN h1 || h2 WHEN 1 THEN h0 || h2 ELSE h0 || h1 END,
    sha256(CASE spot % 3 WHEN 0 THEN folded || h1 || h2 WHEN 1 THEN h0 || folded || h2
           ELSE h0 || h1 || folded END)
  FROM (SELECT *, coalesce(max(CASE WHEN spot % 3 = 0 THEN h END) OVER run, '') AS h0,
          coalesce(max(CASE WHEN spot % 3 = 1 THEN h END) OVER run, '') AS h1,
          coalesce(max(CASE WHEN spot % 3 = 2 THEN h END) OVER run, '') AS h2
        FROM {name} WHERE n > 1 WINDOW run AS (PARTITION BY {by} spot // 3)))"""


_BITS = """flatten(list_transform(string_split(doc_id::VARCHAR, ''), lambda c:
      list_transform(range(8), lambda k: (ascii(c)::BIGINT >> k::INT) & 1)))"""

SQL = f"""
WITH RECURSIVE cut AS (
  SELECT *, CASE WHEN list_reduce(list_prepend(4294967295::BIGINT, {_BITS}), lambda c, b:
      xor(c // 2, 3988292384 * (xor(c, b) % 2))) % 2 = 1 THEN replace(text, chr(10), '')
      ELSE text END AS cut_text
  FROM documents),
leaves AS (
  SELECT doc_id, source, sha256({' || '.join(map(_framed, FIELDS))}) AS leaf,
    sha256({' || '.join(_framed(c if c != 'text' else 'cut_text') for c in FIELDS)}) AS claim
  FROM cut),
placed AS (
  SELECT doc_id, source, leaf,
    row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS spot,
    count(*) OVER (PARTITION BY source) AS n, leaf AS h, '' AS proof, claim AS folded
  FROM leaves),
{_folds('inner_fold', 'placed', 'source,')},
heads AS (
  SELECT doc_id, source, h AS leaf,
    dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS spot,
    (SELECT count(*) FROM (SELECT DISTINCT source FROM documents)) AS n, h, proof, folded, leaf AS own
  FROM inner_fold WHERE n = 1),
tops AS (SELECT doc_id, source, own || leaf AS leaf, spot, n, h, proof, folded FROM heads),
{_folds('outer_fold', 'tops', '')}
SELECT doc_id, leaf[:64] AS leaf, leaf[65:] AS subroot, h AS root, sha256(proof) AS proof_sha256,
  folded AS folded_root, folded = h AS verified
FROM outer_fold WHERE n = 1
"""
