"""Burrows-Wheeler transforms of small sets of texts, merged by interleave refinement.

A shard is a list of texts, each ended by a sign of its own that sorts first.  The merge
starts from the shards laid side by side.  Each round sorts the interleave, stably, by
the sign before each suffix and follows that sign back, so after r rounds suffixes are
in the order of their first r bytes; where a border between neighbours appears in round
r, their common prefix has r - 1 bytes.  No suffix is compared or sorted again.
"""

from __future__ import annotations

import numpy as np


def _joined(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Signs (0 ends a text, else byte + 1; UTF-8 has no byte 255) and the texts' starts."""
    signs = np.frombuffer(b"\0".join(texts) + b"\0", np.uint8).astype(np.int16) + 1
    ends = np.cumsum([len(t) + 1 for t in texts]) - 1
    signs[ends] = 0
    return signs.astype(np.uint8), np.concatenate(([0], ends[:-1] + 1))


def suffix_order(signs: np.ndarray) -> np.ndarray:
    """Suffixes in order, by doubling; end signs differ and sort by place.

    Four signs fit in one key, so the first sort is by four, and later sorts look only at
    suffixes that share their rank with others.
    """
    n = len(signs)
    ends = np.flatnonzero(signs == 0)
    key = signs.astype(np.int64) + len(ends)
    key[ends] = np.arange(len(ends))
    step, most = 1, len(ends) + 257
    while step < 4 and most ** 2 < 1 << 62:
        wide = key * (most + 1)
        wide[:-step] += key[step:] + 1
        key, step, most = wide, 2 * step, (most + 1) ** 2
    order = np.argsort(key)
    fresh = np.empty(n, bool)
    fresh[0] = True
    held = key[order]
    np.not_equal(held[1:], held[:-1], out=fresh[1:])
    # a rank is the place of the first suffix that shares it, so it stays when others split
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(fresh, np.arange(n), 0))
    at = np.flatnonzero(~(fresh & np.append(fresh[1:], True)))
    while len(at):
        open_ = order[at]
        ahead = open_ + step
        key = rank[open_] * (n + 2)
        key += np.where(ahead < n, rank[np.minimum(ahead, n - 1)] + 1, 0)
        turn = np.argsort(key)
        order[at] = open_ = open_[turn]
        held = key[turn]
        fresh = np.empty(len(at), bool)
        fresh[0] = True
        np.not_equal(held[1:], held[:-1], out=fresh[1:])
        rank[open_] = at[np.maximum.accumulate(np.where(fresh, np.arange(len(at)), 0))]
        at = at[~(fresh & np.append(fresh[1:], True))]
        step *= 2
    return order


class Shard:
    """The transform of a list of texts, and where each row's sign leads back to."""

    def __init__(self, texts: list[bytes]):
        signs, starts = _joined(texts)
        self.texts = len(texts)
        self.order = suffix_order(signs)
        before = self.order - 1
        first = np.zeros(len(signs), bool)
        first[starts] = True
        self.transform = np.where(first[self.order], 0, signs[before]).astype(np.uint8)
        row = np.empty(len(signs), np.int64)
        row[self.order] = np.arange(len(signs))
        self.back = row[before]  # rows of whole texts lead to end signs, which are laid anew


#: Rounds that sort the whole interleave; later ones look only at what the last one changed.
WHOLE_ROUNDS = 6


def merged(shards: list[Shard], rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows, block): the shards' rows, numbered on, gathered by block.

    Rows share a block if their suffixes have ``rounds`` bytes in common before any end.
    """
    offsets = np.cumsum([0, *[len(s.transform) for s in shards]])
    transform = np.concatenate([s.transform for s in shards])
    back = np.concatenate([s.back + o for s, o in zip(shards, offsets[:-1], strict=True)]).astype(
        np.int32)
    # rows of end signs come first in each shard, and in the merge
    dollars = np.concatenate([np.arange(s.texts) + o for s, o in zip(
        shards, offsets[:-1], strict=True)]).astype(np.int32)
    rows = np.arange(len(transform), dtype=np.int32)
    block = np.zeros(len(transform), np.int32)
    fresh = np.empty(len(transform), bool)
    for _ in range(min(rounds, WHOLE_ROUNDS)):
        signs = transform[rows]
        turn = np.argsort(signs, kind="stable")
        signs, held = signs[turn], block[turn]
        fresh[0] = True
        np.logical_or(signs[1:] != signs[:-1], held[1:] != held[:-1], out=fresh[1:])
        fresh[:len(dollars) + 1] = True
        block = np.cumsum(fresh, dtype=np.int32)
        rows = back[rows[turn]]
        rows[:len(dollars)] = dollars
    label = np.empty(len(rows), np.int64)
    label[rows] = block
    _split_further(label, transform, back, rounds - WHOLE_ROUNDS)
    rows = np.argsort(label, kind="stable")
    return rows, label[rows]


def _split_further(label: np.ndarray, transform: np.ndarray, back: np.ndarray,
                   rounds: int) -> None:
    """Refines the blocks in ``label`` (of each row) by ``rounds`` more bytes, in place.

    A block can only split in a round if a block that its suffixes lead to split in the
    round before, so a round follows the changed rows one sign back and no others.  The
    part that leads to unchanged rows, or else the largest, keeps its label.
    """
    size = np.zeros(2 * len(label) + 2, np.int64)
    counts = np.bincount(label)
    size[:len(counts)] = counts
    names = len(counts)
    changed = np.arange(len(label))
    for _ in range(rounds):
        ahead = changed[transform[changed] > 0]
        rows = back[ahead]
        open_ = size[label[rows]] > 1
        ahead, rows = ahead[open_], rows[open_]
        if not len(rows):
            return
        key = label[rows] * len(size) + label[ahead]
        turn = np.argsort(key)
        rows, key = rows[turn], key[turn]
        starts = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
        sizes = np.diff(np.append(starts, len(rows)))
        of = key[starts] // len(size)
        # groups of one block follow each other; by size, the largest last
        turn = np.lexsort((sizes, of))
        last = np.empty(len(of), bool)
        last[-1] = True
        np.not_equal(of[turn][1:], of[turn][:-1], out=last[:-1])
        total = np.bincount(of, sizes, names).astype(np.int64)
        keeps = np.zeros(len(of), bool)
        keeps[turn] = last & (total[of[turn]] == size[of[turn]])
        fresh = np.flatnonzero(~keeps)
        if not len(fresh):
            return
        np.subtract.at(size, of[fresh], sizes[fresh])
        named = names + np.arange(len(fresh))
        size[named] = sizes[fresh]
        names += len(fresh)
        moved = np.repeat(~keeps, sizes)
        changed = rows[moved]
        label[changed] = np.repeat(named, sizes[fresh])


def repeated(texts: list[bytes], length: int, shards: int = 4) -> tuple[np.ndarray, ...]:
    """(text, start, block) of each place whose ``length`` bytes occur at another place too."""
    parts = [texts[i::shards] for i in range(min(shards, len(texts)))]
    built = [Shard(p) for p in parts]
    rows, block = merged(built, length)
    alike = np.flatnonzero(np.concatenate(([False], block[1:] == block[:-1])))
    alike = np.union1d(alike, alike - 1)
    rows, block = rows[alike], block[alike]
    offsets = np.cumsum([0, *[len(s.transform) for s in built]])
    shard = np.searchsorted(offsets, rows, side="right") - 1
    text, start = np.empty(len(rows), np.int64), np.empty(len(rows), np.int64)
    for i, s in enumerate(built):
        mine = shard == i
        place = s.order[rows[mine] - offsets[i]]
        begins = np.cumsum([0, *[len(t) + 1 for t in parts[i]]])
        which = np.searchsorted(begins, place, side="right") - 1
        text[mine], start[mine] = which * shards + i, place - begins[which]
    return text, start, block
