"""Ranked search: against scoring every pair, with either way to the postings; ties, repeats, nulls."""

import math
import random
import re
from collections import Counter

import pytest

from larkspool.llm import search

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def every_pair(docs, items, k):
    bags = [Counter(terms(t)) for _, t in docs]
    sizes = [sum(b.values()) for b in bags]
    n, total = sum(s > 0 for s in sizes), sum(sizes)
    df = Counter(w for b in bags for w in b)
    weight = {w: math.floor(1000 * math.log((2 * n + 2) / (2 * c + 1))) for w, c in df.items()}
    out = []
    for item, text in items:
        scored = []
        for (i, _), bag, size in zip(docs, bags, sizes):
            if size:
                m = 100 - 75 + 75 * size * n // total
                score = sum(weight[w] * (1_000_000_000 * bag[w] // (1000 * bag[w] + 8 * m)) for w in terms(text) if w in bag)
                if score > 0:
                    scored.append((-score, i is None, i or 0, i))
        out += [(item, r + 1, i, -s) for r, (s, _, _, i) in enumerate(sorted(scored, key=lambda x: x[:3])[:k])]
    return sorted(out, key=repr)


def tables(seed=12):
    rng = random.Random(seed)
    common, rare = ["the", "of", "The", "and", "a"], [f"w{i}" for i in range(300)] + ["über", "日本", "日本語", "É", "é", "x9"]

    def text(n):
        return rng.choice([" ", ", ", "-"]).join(rng.choice(common) if rng.random() < 0.5 else rng.choice(rare) for _ in range(n))

    docs = [(i, text(rng.randrange(0, 60))) for i in range(400)]
    docs += [(1000 + i, docs[7][1]) for i in range(30)] + [(5, docs[5][1]), (5, "w1 w2"), (None, docs[7][1]), (None, None), (2000, None), (2001, ""), (2002, " .!"), (2003, text(30_000))]
    items = [(i, text(rng.randrange(1, 40))) for i in range(30)] + [(3, docs[7][1]), (None, "w1 w1 w2"), (50, None), (51, "..."), (52, "nowhere"), (53, "the"), (54, "THE The the of")]
    return docs, items


@pytest.mark.parametrize("k", [1, 10])
@pytest.mark.parametrize("broadcast", [True, False])
def test_equals_every_pair(spark, monkeypatch, k, broadcast):
    if not broadcast:
        monkeypatch.setattr(search, "BROADCAST_ROWS", 0)  # more terms than may go to the tasks
    docs, items = tables()
    d = spark.createDataFrame([(*r, "z", 1, 2) for r in docs], "doc_id long, text string, term string, row int, q int").repartition(5)
    i = spark.createDataFrame([(*r, "z") for r in items], "item_id long, text string, doc_id string")
    got = search.search(d, i, k).collect()
    assert sorted(map(tuple, got), key=repr) == every_pair(docs, items, k)


def test_few_documents_are_looked_up(spark, monkeypatch):
    """Most documents share common terms with a query; the thresholds leave a small part of all pairs."""
    made = {}
    real = search.materialize
    monkeypatch.setattr(search, "materialize", lambda df, name, keep=False: made.setdefault(name, real(df, name, keep)))
    rng = random.Random(3)
    docs = [(i, " ".join(rng.choices(["the", "of", "and", *[f"w{rng.randrange(2000)}" for _ in range(6)]], k=40))) for i in range(2000)]
    items = [(i, docs[i * 40][1]) for i in range(30)]
    got = search.search(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), 3).collect()
    assert sorted(map(tuple, got), key=repr) == every_pair(docs, items, 3)
    assert made["left"].count() < 0.05 * len(docs) * len(items)


def test_equal_hashes_are_told_apart(spark, monkeypatch):
    """Where all words have one of two hashes, entries are still those of equal words."""
    real = search.word_hashes

    def weak(*a, **k):
        h, *rest = real(*a, **k)
        return h % 2, *rest

    monkeypatch.setattr(search, "word_hashes", weak)
    vocabulary = search._Vocabulary([0, 1], ["cat", "horse"])
    import numpy as np

    data = np.frombuffer(b"cat dog cow horse mouse cat", np.uint8)
    h, _, starts, ends = weak(data, np.array([0, len(data)]), apart=search._APART)
    hit, number = vocabulary.find(h, data, starts, ends)
    if vocabulary.distinct():
        assert (hit.tolist(), number.tolist()) == ([0, 3, 5], [0, 1, 0])


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    some = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert search.search(none, some).count() == 0
    assert search.search(spark.createDataFrame([(1, "a b")], "doc_id long, text string"), some.limit(0)).count() == 0
