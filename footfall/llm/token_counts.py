"""Word-piece counts by a linear longest-match automaton.

A trie over the vocabulary gets failure links: where a node has no branch for the next
byte, its link leads to the node that remains after the longest pieces are taken off,
and a precomputed number says how many pieces that took.  A word is read once from left
to right and its pieces are counted without building any of them.  Each distinct word
of a task is counted once.
"""

from __future__ import annotations

import base64
from collections import deque
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from footfall.llm.common import table, text_batches

#: Distinct words remembered by a task before it starts afresh.
REMEMBERED = 500_000


class LongestMatch:
    """Counts of greedy longest-match pieces over one set of pieces (bytes)."""

    def __init__(self, pieces: Iterable[bytes]):
        self.next: dict[int, int] = {}
        whole = [False]
        for piece in pieces:
            node = 0
            for byte in piece:
                key = node << 8 | byte
                if key not in self.next:
                    self.next[key] = len(whole)
                    whole.append(False)
                node = self.next[key]
            whole[node] = bool(piece)
        self.fail, self.popped = [-1] * len(whole), [0] * len(whole)
        below: dict[int, list[tuple[int, int]]] = {}
        for key, child in self.next.items():
            below.setdefault(key >> 8, []).append((key & 255, child))
        queue = deque([0])
        while queue:  # by depth, so a node's link is known before its branches'
            node = queue.popleft()
            for byte, child in below.get(node, ()):
                queue.append(child)
                if whole[child]:
                    self.fail[child], self.popped[child] = 0, 1
                    continue
                at, taken = self.fail[node], self.popped[node]
                while at >= 0 and at << 8 | byte not in self.next:
                    taken, at = taken + self.popped[at], self.fail[at]
                if at >= 0:
                    self.fail[child], self.popped[child] = self.next[at << 8 | byte], taken

    def count(self, word: bytes) -> int:
        """Number of pieces, or -1 if the pieces cannot spell the word."""
        branch, fail, popped = self.next.get, self.fail, self.popped
        node = taken = 0
        for byte in word:
            while (after := branch(node << 8 | byte)) is None:
                if fail[node] < 0:
                    return -1
                taken += popped[node]
                node = fail[node]
            node = after
        while node:
            if fail[node] < 0:
                return -1
            taken += popped[node]
            node = fail[node]
        return taken


def rank_file(path: str) -> list[bytes]:
    """The pieces of a rank file: base64 piece and rank on each line."""
    with open(path, "rb") as lines:
        return [base64.b64decode(line.split()[0]) for line in lines if line.strip()]


class _Words(dict):
    def __init__(self, automaton: LongestMatch):
        self.automaton = automaton

    def __missing__(self, word: bytes) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        pieces = self.automaton.count(b" " + word)
        if len(word) <= 64:
            self[word] = pieces
        return pieces


_READY: dict[str, _Words] = {}


def token_counts(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_words, n_tokens and n_unknown of each row.

    A word (a run of anything but ASCII white space) is spelled with a leading space,
    greedily by the longest piece; a word that the pieces cannot spell is one unknown
    token.  Null, empty and blank texts have no tokens; rows alike get equal counts.
    Only doc_id and text are read.  ``path`` names the rank file on every executor.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if path not in _READY:
            _READY[path] = _Words(LongestMatch(rank_file(path)))
        known = _READY[path]
        for batch, texts in text_batches(batches):
            out = np.zeros((3, len(texts)), np.int64)
            for i, text in enumerate(texts):
                words = text.split()
                counts = np.fromiter(map(known.__getitem__, words), np.int64, len(words))
                unknown = int((counts < 0).sum())
                out[:, i] = len(words), int(np.abs(counts).sum()), unknown
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *[pa.array(x) for x in out]],
                ["doc_id", "n_words", "n_tokens", "n_unknown"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(run, "doc_id long, n_words long, n_tokens long, n_unknown long")


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts(table(spark, sf_dir, "documents"),
                        public_tokenizers.path("byte_bpe_50k.tiktoken"))
