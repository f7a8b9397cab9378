"""Ranked search against scores of every document."""

import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Row

from vitalshare.llm import ranked_search

TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def terms(text):
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(TERM, lowered)


def brute(docs, items, k=10):
    held = [(doc_id, Counter(terms(text))) for doc_id, text in docs]
    n = [sum(c.values()) for _, c in held]
    total, every = sum(1 for x in n if x), sum(n)
    df = Counter(t for _, c in held for t in c)
    out = []
    for item_id, text in items:
        scores = []
        for (doc_id, c), size in zip(held, n):
            score = 0
            for t in terms(text):
                if t in c:
                    m = 25 + (75 * size * total) // every
                    w = math.floor(1000 * math.log((2 * total + 2) / (2 * df[t] + 1)))
                    score += w * ((1_000_000_000 * c[t]) // (1000 * c[t] + 8 * m))
            if score > 0:
                scores.append((-score, (doc_id is not None, doc_id or 0), doc_id))
        for place, (score, _, doc_id) in enumerate(sorted(scores)[:k], 1):
            out.append((item_id, place, doc_id, -score))
    return sorted(out, key=repr)


def corpus(rng, n):
    vocabulary = [f"T{i}" if i % 3 else f"é{i}" for i in range(60)]
    weights = [1 / (i + 1) for i in range(60)]
    return [
        (i, " -".join(rng.choices(vocabulary, weights, k=rng.choice([0, 1, 5, 40, 200])))) for i in range(n)
    ]


def ranked(spark, docs, items, k=10):
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    i = spark.createDataFrame(items, "item_id long, text string")
    return sorted(map(tuple, ranked_search.rank(d, i, k).collect()), key=repr)


def test_ranking_equals_scores_of_all(spark, monkeypatch):
    rng = random.Random(3)
    docs, items = corpus(rng, 300), corpus(rng, 25)
    docs += [docs[5], (None, docs[6][1]), (900, None), (901, "...")]
    items += [(700, None), (701, "nowhere"), (702, "t1 T1 t1 é0")]
    want = brute(docs, items)
    assert ranked(spark, docs, items) == want
    monkeypatch.setattr(ranked_search, "BLOCK", 200)  # several passes
    assert ranked(spark, docs, items) == want
    assert ranked(spark, docs, items, k=3) == [x for x in want if x[1] <= 3]


def test_ties_go_to_smaller_ids(spark):
    docs = [(i, "same words here") for i in range(30, 0, -1)]
    found = ranked(spark, docs + [(99, "other")], [(1, "words")])
    assert [x[2] for x in sorted(found, key=lambda x: x[1])] == list(range(1, 11))


def test_shards_of_any_size_and_early_stop(monkeypatch):
    rng = np.random.default_rng(1)
    n, t = 5000, 6
    tfs = rng.geometric(0.3, (n, t)) * (rng.random((n, t)) < 0.5)
    counts = (tfs > 0).sum(axis=1)
    which = np.nonzero(tfs)
    m = rng.integers(30, 400, n)
    shard = ranked_search.Shard(np.arange(n), m, counts, which[1], tfs[which])
    impact = np.where(tfs > 0, (1_000_000_000 * tfs) // (1000 * tfs + 8 * m[:, None]), 0)
    weights = np.array([5, 100, 1, 40, 7, 2000])
    score = impact @ weights
    docs, scores, read = shard.top(np.arange(t), weights, 10)
    want = np.lexsort((np.arange(n), -score))[:10]
    assert docs.tolist() == want.tolist() and scores.tolist() == score[want].tolist()
    assert read < counts.sum() / 2


def test_terms_of_odd_texts(odd_docs):
    texts = [r.text for r in odd_docs.select("text").collect()]
    codes, begin, names = ranked_search.term_lists(pa.array(texts).slice(1))
    for i, text in enumerate(texts[1:]):
        assert [names[c].as_py() for c in codes[begin[i] : begin[i + 1]]] == terms(text)


def test_odd_and_empty_tables(spark, odd_docs, no_docs):
    rows = [(r.doc_id, r.text) for r in odd_docs.select("doc_id", "text").collect()]
    items = [(1, "the word x a"), (1, "the word x a"), (None, "日本語 id"), (3, "")]
    i = spark.createDataFrame(items, "item_id long, text string")
    found = sorted(map(tuple, ranked_search.rank(odd_docs, i).collect()), key=repr)
    assert found == brute(rows, items)
    assert ranked_search.rank(no_docs, i).count() == 0
    assert ranked_search.rank(odd_docs, i.limit(0)).count() == 0
