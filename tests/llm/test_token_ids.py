import zlib

import numpy as np
import pytest

from footfall.llm import token_ids as t
from tests.llm.rows import TEXTS, awkward

pytest.importorskip("public_tokenizers")


def test_round_trip_of_packing():
    rng = np.random.default_rng(1)
    for bits in (1, 3, 16, 17, 31):
        ids = rng.integers(0, 1 << bits, 9001).astype(np.uint32)
        parts = [ids[:5], ids[5:5], ids[5:5000], ids[5000:]]
        read = t.Segment(t.segment(parts, bits))
        for i, part in enumerate(parts):
            assert (read.document(i) == part).all()
        assert (read.range(4000, 8200) == ids[4000:8200]).all()
    assert t.bits_for(49_408) == 16 and t.bits_for(2) == 1 and t.bits_for(65_537) == 17
    with pytest.raises(ValueError):
        t.Segment(b"no segment here")


def encoded(texts):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(t.vocabulary_path())
    return [np.array(tokenizer.encode(x or "", add_special_tokens=False).ids + [1], "<u4")
            for x in texts]


def test_words_alone_give_the_ids_of_texts():
    texts = ["It's the THE!! dog's (déjà-vu) ÀÉÎ", "1234 a1b2 :-) <|endoftext|>  x y",
             "é ́e ﬁne ǅ İ ΑΣ. 日本語 ***", "don't  I'LL we're|a|b"]
    encoder = t.Encoder(t.vocabulary_path())
    for text, ids in zip(texts, encoded(texts), strict=True):
        assert encoder.ids(text.encode()).tolist() == ids[:-1].tolist()


def test_awkward_rows(spark):
    docs = awkward(spark)
    rows = t.token_ids(docs).collect()
    ids = {}
    for (doc_id, _, _), found in zip(TEXTS, encoded([x for _, x, _ in TEXTS]), strict=True):
        ids.setdefault(doc_id, []).append((len(found), zlib.crc32(found)))
    got, at = {}, 0
    for r in sorted(rows, key=lambda r: r.start):
        assert r.start == at
        at += r.n_tokens
        got.setdefault(r.doc_id, []).append((r.n_tokens, r.ids_crc32))
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in ids.items()}
    order = [r.doc_id for r in sorted(rows, key=lambda r: r.start)]
    assert order == sorted(order, key=lambda i: (i is not None, i or 0))
    assert t.token_ids(docs.limit(0)).count() == 0


def test_words_and_their_parts_are_remembered_once():
    encoder = t.Encoder(t.vocabulary_path())
    ids = encoder.ids("alpha Alpha alpha, été ÉTÉ. x1 #!".encode())
    assert ids.tolist() == encoder._whole("alpha Alpha alpha, été ÉTÉ. x1 #!")
    assert {w.decode() for w in encoder} == {
        "alpha", "Alpha", "alpha,", ",", "été", "ÉTÉ.", ".", "x1", "#!"}
    assert encoder.held == sum(t.ENTRY + len(w) + len(i) for w, i in encoder.items())
