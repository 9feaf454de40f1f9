import hashlib
import random
from collections import defaultdict

import numpy as np
import pytest

from footfall.llm.bwt import repeated
from footfall.llm.suffix_dedup import remove_repeats
from tests.llm.rows import TEXTS, awkward, documents


def removed(texts, length=100):
    """(n_bytes, n_removed, n_spans, kept_sha256) of texts in order, by looking at every string."""
    seen, out = set(), []
    for data in ((t or "").encode() for t in texts):
        gone = np.zeros(len(data) + 1, bool)
        for i in range(len(data) - length + 1):
            string = data[i:i + length]
            if string in seen:
                gone[i:i + length] = True
            seen.add(string)
        spans = int((gone[1:] & ~gone[:-1]).sum()) + int(gone[0])
        kept = bytes(b for b, g in zip(data, gone, strict=False) if not g)
        out.append((len(data), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return out


def test_merged_transforms_find_all_repeats():
    rng = random.Random(1)
    for _ in range(100):
        length = rng.choice([3, 5, 8])
        texts = [bytes(rng.choices(b"ab", k=rng.randint(0, 40))) for _ in range(rng.randint(1, 9))]
        got, want = defaultdict(set), defaultdict(set)
        for text, start, block in zip(*repeated(texts, length), strict=True):
            got[block].add((int(text), int(start)))
        for i, text in enumerate(texts):
            for j in range(len(text) - length + 1):
                want[text[j:j + length]].add((i, j))
        assert ({frozenset(v) for v in got.values()}
                == {frozenset(v) for v in want.values() if len(v) > 1})


def rows_of(frame, docs):
    return {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256)
            for r in frame.drop("kept").collect()}


@pytest.mark.parametrize("group_texts", [2, 4096])
def test_equals_brute_force(spark, group_texts):
    rng = random.Random(4)
    line = "".join(rng.choices("abcdefgh é", k=170))
    texts = ["".join(rng.choices("abcdefghijk lmnoé", k=rng.randint(0, 700))) for _ in range(40)]
    texts += [texts[i][:300] + "#" + texts[i][200:] for i in range(8)]
    texts += [f"{t[:60]}{line[rng.randint(0, 40):]}{t[60:]}" for t in texts[:20]]
    texts += ["ab" * 300, "x" * 150, "x" * 99, texts[3], texts[3], None, ""]
    got = rows_of(remove_repeats(documents(spark, texts), group_texts=group_texts), texts)
    assert [got[i] for i in range(len(texts))] == removed(texts)


def test_awkward_rows(spark):
    rows = remove_repeats(awkward(spark)).collect()
    assert len(rows) == len(TEXTS)
    long = [r for r in rows if r.doc_id in (6, 7)]
    assert len({(r.n_removed, r.n_bytes) for r in long if r.doc_id == 7}) == 1
    assert all(r.n_removed == r.n_bytes for r in long if r.doc_id == 7)
    assert all(r.n_removed == 0 for r in rows if not r.n_bytes)
    for r in rows:
        assert r.n_bytes - r.n_removed == len(r.kept or b"")
    assert remove_repeats(awkward(spark).limit(0)).count() == 0


def test_only_open_suffixes_are_sorted_again(monkeypatch):
    from footfall.llm import bwt

    rng = random.Random(8)
    texts = [bytes(rng.randrange(97, 123) for _ in range(400)) for _ in range(20)]
    texts += [texts[0][:200] + texts[1][200:], b"", b"a", texts[2]]
    signs, _ = bwt._joined(texts)
    place = np.cumsum(signs == 0)  # end signs differ and sort by place
    want = sorted(range(len(signs)), key=lambda i: [
        (int(s), int(p) if not s else 0) for s, p in zip(signs[i:i + 500], place[i:i + 500], strict=True)])
    argsort, sorted_ = np.argsort, []
    monkeypatch.setattr(np, "argsort", lambda a, **k: sorted_.append(len(a)) or argsort(a, **k))
    assert bwt.suffix_order(signs).tolist() == want
    assert sum(sorted_) < 3 * len(signs)
