"""Removal of repeated strings against a count of all strings."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import Row

from vitalshare.llm import repeats


def brute(rows, length):
    data = [(doc_id, (text or "").encode()) for doc_id, text in rows]
    seen = Counter(t[i : i + length] for _, t in data for i in range(len(t) - length + 1))
    out = []
    for doc_id, t in data:
        gone = bytearray(len(t))
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        kept = bytes(b for b, g in zip(t, gone) if not g)
        spans = sum(1 for i, g in enumerate(gone) if g and (not i or not gone[i - 1]))
        out.append((doc_id, len(t), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def removed(spark, rows, length):
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    return sorted(map(tuple, repeats.remove(docs, length).collect()), key=repr)


def passages(rng, n, size, alphabet):
    shared = ["".join(rng.choices(alphabet, k=rng.randint(size // 2, 3 * size))) for _ in range(6)]
    texts = []
    for _ in range(n):
        parts = []
        for _ in range(rng.randint(0, 6)):
            own = "".join(rng.choices(alphabet, k=rng.randint(0, size)))
            parts += [own, rng.choice(shared)] if rng.random() < 0.6 else [own]
        text = list("".join(parts))
        for _ in range(rng.randint(0, 3)):
            if text:
                text[rng.randrange(len(text))] = rng.choice(alphabet)
        texts.append("".join(text))
    return texts


@pytest.mark.parametrize("length,alphabet", [(400, "abcdefé "), (50, "ab"), (7, "abc"), (1, "abcdefghij")])
def test_removal_equals_counting_all_strings(spark, monkeypatch, length, alphabet):
    monkeypatch.setattr(repeats, "SLICE", 3000)
    rng = random.Random(length)
    texts = passages(rng, 40, max(length, 3), alphabet)
    rows = list(enumerate(texts)) + [(100, texts[3]), (101, "ab" * 700), (102, "z" * 900), (103, None), (104, "")]
    rows += [(None, texts[5] + "q"), (105, "x" + texts[4] + "y"), (3, texts[3])]
    assert removed(spark, rows, length) == brute(rows, length)


def test_edges_of_repetitions_are_exact(spark):
    rng = random.Random(2)
    letters = "abcdefghijklmnopqrstuvwxyz"
    base = "".join(rng.choices(letters, k=3000))
    other = lambda n: "".join(rng.choices(letters, k=n))
    rows = [(0, base)]
    for i in range(1, 60):
        a = rng.randrange(2500)
        rows.append((i, other(rng.randint(0, 500)) + base[a : a + rng.randint(380, 430)] + other(rng.randint(0, 500))))
    assert removed(spark, rows, 400) == brute(rows, 400)


def test_string_that_meets_itself(spark):
    rows = [(0, "abc" * 200), (1, "q" * 401), (2, "r" * 400), (3, "only once " * 3)]
    assert removed(spark, rows, 400) == brute(rows, 400)


def test_text_of_more_than_65536_anchors(spark):
    rng = random.Random(1)
    other = lambda n: "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=n))
    shared = [other(600) for _ in range(4)]
    # in a run of one letter every position is an anchor
    rows = [(0, "a" * 70_000 + "".join(other(300) + x for x in shared))]
    rows += [(i, other(100 + i) + x + other(50)) for i, x in enumerate(shared, 1)]
    assert removed(spark, rows, 400) == brute(rows, 400)


def test_same_strings_have_the_same_anchors():
    rng = np.random.default_rng(4)
    plan = repeats.Plan(400)
    core = rng.integers(0, 4, 400).astype(np.uint8)
    found = []
    for _ in range(30):
        n = int(rng.integers(0, 300))
        data = np.concatenate([rng.integers(0, 4, n), core, rng.integers(0, 4, 350)]).astype(np.uint8)
        _, at, low, many, reach = repeats.anchors(data, np.array([0, len(data)]), plan)
        i = int(np.searchsorted(low, n, side="right")) - 1
        assert low[i] <= n < low[i] + many[i] and reach[i] >= 1
        found.append(tuple(at[i : i + reach[i]] - n))
    shortest = min(map(len, found))
    assert shortest >= 2 and len({x[:shortest] for x in found}) == 1


def test_kept_bytes(spark):
    passage = "the same passage " * 30
    docs = spark.createDataFrame([Row(doc_id=1, text="a" + passage + "é"), Row(doc_id=2, text=passage + "b" * 9)])
    kept = {r.doc_id: bytes(r.kept) for r in repeats.remove(docs, 400, texts=True).collect()}
    assert kept == {1: b"a\xc3\xa9", 2: b"b" * 9}


def test_odd_and_empty_tables(spark, odd_docs, no_docs):
    rows = [(r.doc_id, r.text) for r in odd_docs.select("doc_id", "text").collect()]
    short = [(i, t) for i, t in rows if len(t or "") < 20_000]
    got = sorted(map(tuple, repeats.remove(odd_docs).collect()), key=repr)
    assert [x for x in got if x[0] not in (7, 8)] == brute(short, 400)
    by_id = {x[0]: x for x in got}
    assert by_id[7][1:4] == (150_000, 150_000, 1) and by_id[8][1:4] == (20_000, 20_000, 1)
    assert repeats.remove(no_docs).count() == 0
