"""The manifest against a plain recursive tree, and its SQL on the given tables."""

import hashlib
import random
import zlib

import duckdb

from footfall.llm import merkle
from footfall.llm.merkle import (
    Appender, fold, manifest, op11_merkle_manifest, verified, without_line_breaks)
from tests.llm.rows import awkward


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


def plain_leaf(row):
    return digest("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def plain_tree(nodes):
    """The root and each node's siblings, as (left text, right text) by level."""
    paths, of, level = [[] for _ in nodes], [[i] for i in range(len(nodes))], list(nodes)
    while len(level) > 1:
        runs = [range(i, min(i + 3, len(level))) for i in range(0, len(level), 3)]
        for run in runs:
            for j in run:
                for i in of[j]:
                    paths[i].append(("".join(level[k] for k in run if k < j),
                                     "".join(level[k] for k in run if k > j)))
        of = [[i for j in run for i in of[j]] for run in runs]
        level = [digest("".join(level[j] for j in run)) for run in runs]
    return (level[0] if level else None), paths


def plain_manifest(rows):
    """(doc_id, source, lang, n_chars, text) rows -> the columns of op11."""
    sources = {}
    for row in rows:
        sources.setdefault(row[1], []).append(row)
    order = sorted(sources, key=lambda s: (s is not None, (s or "").encode()))
    held = {s: sorted(sources[s], key=lambda r: (r[0] is not None, r[0] or 0, plain_leaf(r)))
            for s in order}
    trees = {s: plain_tree([plain_leaf(r) for r in held[s]]) for s in order}
    root, above = plain_tree([trees[s][0] for s in order])
    out = []
    for s, up in zip(order, above, strict=True):
        for row, path in zip(held[s], trees[s][1], strict=True):
            claim = row
            if row[0] is not None and row[4] and zlib.crc32(str(row[0]).encode()) % 2 == 0:
                claim = (*row[:4], row[4].replace("\n", ""))
            node = plain_leaf(claim)
            for left, right in path + up:
                node = digest(left + node + right)
            proof = digest("".join(a + b for a, b in path + up))
            out.append((row[0], plain_leaf(row), trees[s][0], root, proof, node, node == root))
    return sorted(out, key=repr)


def test_witnesses_of_every_size():
    for n in [*range(1, 30), 81, 82, 243, 500]:
        nodes = [hashlib.sha256(str(i).encode()).digest() for i in range(n)]
        tree = Appender(n)
        for node in nodes:
            tree.append(node)
        root, paths = plain_tree([x.hex() for x in nodes])
        assert tree.root().hex() == root
        for i, (node, witness, path) in enumerate(zip(nodes, tree.witnesses, paths, strict=True)):
            assert witness.hex() == "".join(a + b for a, b in path)
            assert fold(node, bytes(witness), i, n) == (tree.open[-1][0][0], b"")


def test_blocks_of_blocks(spark):
    """Blocks of nine leaves, so a source of some hundred rows takes three rounds."""
    rng = random.Random(1)
    rows = [(i, rng.choice(["hot"] * 4 + [f"s{rng.randrange(20)}", None, ""]), "en", i,
             f"text\n{i}" if rng.random() < .7 else None) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string")
    got = verified(manifest(docs, without_line_breaks(docs), size=9)).collect()
    assert sorted((tuple(r) for r in got), key=repr) == plain_manifest(rows)


def test_awkward_rows(spark):
    docs = awkward(spark)
    got = verified(manifest(docs, without_line_breaks(docs))).collect()
    rows = [(r.doc_id, r.source, r.lang, r.n_chars, r.text) for r in docs.collect()]
    assert sorted((tuple(r) for r in got), key=repr) == plain_manifest(rows)
    assert sum(not r.verified for r in got) == sum(
        r[0] is not None and "\n" in (r[4] or "") and zlib.crc32(str(r[0]).encode()) % 2 == 0
        for r in rows)
    assert verified(manifest(docs.limit(0))).count() == 0
    one = verified(manifest(docs.where("doc_id = 8"))).first()
    assert one.leaf == one.subroot == one.root == one.folded_root and one.verified
    assert one.proof_sha256 == digest("")


def test_against_sql(spark, sf_dir):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf_dir}/documents.parquet'")
    names = "doc_id leaf subroot root proof_sha256 folded_root verified".split()
    want = con.execute(f"SELECT {', '.join(names)} FROM ({merkle.SQL})").fetchall()
    got = op11_merkle_manifest(spark, sf_dir).select(*names).collect()
    assert sorted(map(tuple, got)) == sorted(want)
    assert {r.verified for r in got} == {True, False}
