import random

import numpy as np

from footfall.llm.decontamination import common_share, contaminated, clean_rows
from tests.llm.rows import awkward


def corpus(spark):
    rng = random.Random(9)
    words = ["".join(rng.choices("abcdefghij", k=rng.randint(3, 9))) for _ in range(4000)]
    items = [" ".join(rng.choices(words, k=rng.randint(12, 40))) + "." for _ in range(30)]
    texts, planted = [], set()
    for i in range(300):
        text = rng.choices(words, k=rng.randint(20, 200))
        if i % 5 == 0:
            item = i // 5 % 30
            passage = items[item].split()
            if i % 2:  # a paraphrase: every seventh word is another one
                passage = [rng.choice(words) if k % 7 == 3 else w for k, w in enumerate(passage)]
            at = rng.randrange(len(text))
            text[at:at] = passage
            planted.add((i, item))
        texts.append(" ".join(text))
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)],
                                 "doc_id long, text string, item_id string")
    return docs, spark.createDataFrame(list(enumerate(items)), "item_id long, text string"), planted


def test_finds_planted_passages_and_no_others(spark):
    docs, benchmark, planted = corpus(spark)
    for block in (7, 1024):
        got = {(r.doc_id, r.item_id) for r in contaminated(docs, benchmark,
                                                           block_items=block).collect()}
        assert got == planted
    kept = clean_rows(docs, benchmark)
    assert kept.columns == docs.columns
    assert kept.count() == docs.count() - len({d for d, _ in planted})


def test_common_share_is_a_subsequence():
    weights = np.ones(10)
    assert common_share([1, 2, 3, 4], np.array([0, 1, 9, 2, 4, 3]), weights) == 0.75
    assert common_share([1, 2], np.array([2, 1]), weights) == 0.5
    assert common_share([], np.array([1]), weights) == 0.0


def test_awkward_rows(spark):
    docs = awkward(spark)
    items = spark.createDataFrame([(1, None), (None, ""), (2, " \n"), (3, "unheard of words alone")],
                                  "item_id long, text string")
    assert contaminated(docs, items).count() == 0
    assert contaminated(docs, items.limit(0)).count() == 0
    assert contaminated(docs.limit(0), items).count() == 0
    assert clean_rows(docs, items).count() == docs.count()


def test_large_benchmarks_are_searched_in_whole_spaces(spark):
    """Every one of 640 passages is planted; the settings of blocks must not matter."""
    rng = random.Random(4)
    words = ["".join(rng.choices("abcdefghij", k=rng.randint(3, 9))) for _ in range(4000)]
    items = [" ".join(rng.choices(words, k=rng.randint(12, 40))) for _ in range(640)]
    docs = spark.createDataFrame([(i, " ".join([*rng.choices(words, k=40), p, *rng.choices(
        words, k=40)])) for i, p in enumerate(items)], "doc_id long, text string")
    benchmark = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    for options in ({}, {"block_items": 1024, "rank": 200}):
        got = [(r.doc_id, r.item_id) for r in contaminated(docs, benchmark, **options).collect()]
        assert sorted(got) == [(i, i) for i in range(640)]


def random_words(rng, count):
    return ["".join(rng.choices("abcdefghij", k=rng.randint(3, 9))) for _ in range(count)]


def test_common_passages_are_found(spark):
    """A passage in a third of all rows, and one in the only row there is."""
    rng = random.Random(5)
    words = random_words(rng, 4000)
    item = " ".join(rng.choices(words, k=16))
    texts = [rng.choices(words, k=60) for _ in range(300)]
    for text in texts[::3]:
        text[24:24] = [item]
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)],
                                 "doc_id long, text string")
    benchmark = spark.createDataFrame([(1, item)], "item_id long, text string")
    assert sorted(r.doc_id for r in contaminated(docs, benchmark).collect()) == [*range(0, 300, 3)]
    assert contaminated(docs.where("doc_id = 0"), benchmark).count() == 1


def test_passages_of_all_lengths_are_found(spark):
    """Verbatim and with 30 % of the words replaced; short common ones beside rare words."""
    rng = random.Random(6)
    words, common = random_words(rng, 4000), random_words(rng, 40)
    items = [rng.choices(words, k=n) for n in (24, 25, 73, 150, 400, 1200)]
    items.append(rng.sample(common, 12))
    texts = []
    for k, item in enumerate(items):
        for changed in (0, 0.3 * (k < 6)):
            swapped = set(rng.sample(range(len(item)), int(changed * len(item))))
            texts.append(rng.choices(words, k=70 + 3 * k) + [
                f"new{rng.random()}" if i in swapped else w for i, w in enumerate(item)]
                + [f"rare{rng.random()}" for _ in range(50)])
    hit = len(texts)
    texts += [rng.choices(words, k=30) + rng.choices(common, k=3) for _ in range(100)]
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)],
                                 "doc_id long, text string")
    benchmark = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(items)],
                                      "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in contaminated(docs, benchmark).collect()}
    assert got == {(i, i // 2) for i in range(hit)}
