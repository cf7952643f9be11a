import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from opsweave.llm import search as se
from tests.llm.data import documents, empty, sentence, texts

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
ITEMS = "item_id long, text string"


def words(text):
    return [] if text is None else [t.translate(LOW) for t in TERM.findall(text)]


def brute(docs, items, k):
    """Every document scored for every item."""
    held = [(i, Counter(w), len(w)) for i, w in ((i, words(t)) for i, t in docs) if w]
    n_docs, n_terms = len(held), sum(n for *_, n in held)
    df = Counter(t for _, c, _ in held for t in c)
    out = []
    for item, text in items:
        scored = []
        for i, count, n in held:
            m = 100 - 25 + (25 * n * n_docs) // n_terms
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
                        * ((10 ** 9 * count[t]) // (1000 * count[t] + 12 * m)) for t in words(text) if t in count)
            if score > 0:
                scored.append((-score, i is None, i or 0, i))
        out += [(item, r + 1, i, -s) for r, (s, _, _, i) in enumerate(sorted(scored, key=lambda x: x[:3])[:k])]
    return sorted(out, key=repr)


def compare(spark, docs, items, k=20, df=None):
    df = documents(spark, [(i, t, "en", "s", 0) for i, t in docs]) if df is None else df
    got = se.search(df, spark.createDataFrame(items, ITEMS), k)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted((tuple(r) for r in got.collect()), key=repr) == brute(docs, items, k)


@pytest.mark.parametrize("shard, step", [(7, 1), (64, 3), (4096, 64)])
def test_equals_brute_force(spark, monkeypatch, shard, step):
    monkeypatch.setattr(se, "SHARD", shard)
    monkeypatch.setattr(se, "STEP", step)
    rng = random.Random(shard)
    docs = [(i * 2, sentence(rng, rng.randrange(1, 60))) for i in range(300)]
    docs += [(1000 + i, docs[5][1]) for i in range(50)]  # copies: ties at the worst place
    rng.shuffle(docs)
    compare(spark, docs, [(i, sentence(rng, 12) + " " + docs[i][1]) for i in range(6)] + [(9, docs[5][1])], k=8)


def test_odd_rows(spark):
    docs = [(i * 3, t) for i, t in enumerate(texts())] + [(9, texts()[3]), (None, "amber no key"), (None, "amber no key"),
                                                          (70000, "amber stone " * 50000), (5, "amber"), (5, "amber")]
    items = [(1, "AMBER Stone1, ünï ÜNÏ 漢字\tx"), (2, None), (3, ""), (3, "amber amber"), (3, "amber"), (None, "a"),
             (4, "nowhere"), (4, "nowhere"), (5, "Ünï")]
    compare(spark, docs, items)
    assert se.search(empty(spark), spark.createDataFrame(items, ITEMS)).collect() == []
    assert se.search(documents(spark), spark.createDataFrame([], ITEMS)).collect() == []


def test_clashing_columns(spark):
    df = documents(spark, extra=True)
    for name in ("bare", "n", "terms", "tf", "score", "rank", "item", "item_id", "salt", "name"):
        df = df.withColumn(name, df["n_chars"])
    docs = [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]
    compare(spark, docs, [(1, "amber basin1 end line many"), (2, "key here")], df=df)


def test_items_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(se, "BLOCK_TERMS", 10)
    rng = random.Random(4)
    compare(spark, [(i, sentence(rng, 30)) for i in range(80)], [(i, sentence(rng, 6)) for i in range(5)], k=3)


def test_bounds_spare_documents():
    """A document far ahead of all others is found without scoring them."""
    rng = np.random.default_rng(0)
    terms, docs = np.repeat(np.arange(3), 2000), np.tile(np.arange(2000), 3)
    score = rng.integers(1, 50, 6000)
    score[docs == 1234] = 1000
    lists, found = se.Postings(terms, docs, score, 2000, 3), []
    names = [(-i, i) for i in range(2000)]
    assert lists.search(np.arange(3), np.array([1, 2, 1]), 1, found, names) < 200
    assert found == [(4000, -1234, 1234)]
    assert lists.search(np.arange(3), np.array([1, 2, 1]), 1, found, names) <= 2


def test_range_maxima():
    rng = np.random.default_rng(1)
    terms = np.sort(rng.integers(0, 5, 400))
    docs = np.concatenate([np.sort(rng.permutation(1000)[:n]) for n in np.bincount(terms, minlength=5)])
    score = rng.integers(0, 9, 400)
    lists = se.Postings(terms, docs, score, 1000, 5)
    for _ in range(300):
        t = rng.integers(0, 5)
        lo, hi = sorted(rng.integers(lists.at[t], lists.at[t + 1] + 1, 2))
        place, most = lists.maxima(np.array([[lo]]), np.array([[hi]]))
        assert most[0, 0] == (score[lo:hi].max() if hi > lo else 0)
        assert hi == lo or (lo <= place[0, 0] < hi and score[place[0, 0]] == most[0, 0])
