"""Periodic runs against a brute-force search."""

import hashlib
import random
import re
import zlib
from fractions import Fraction

import numpy as np
from pyspark.sql import Row

from vitalshare.llm import word_runs

SPACE = r"[^\x20\x09-\x0D]+"


def brute_runs(words):
    """(start, length, smallest period) of all maximal runs."""
    out = {}
    for q in range(1, len(words) // 3 + 1):
        i = 0
        while i < len(words) - q:
            j = i
            while j < len(words) - q and words[j] == words[j + q]:
                j += 1
            if j > i and j + q - i >= max(24, 3 * q):
                out.setdefault((i, j + q), q)
            i = max(j, i + 1)
    return sorted((s, e - s, q) for (s, e), q in out.items())


def brute_row(doc_id, text, alter):
    words = re.findall(SPACE, text or "")
    n = len(words)
    if alter and doc_id is not None and n:
        h = zlib.crc32(str(doc_id).encode())
        if h % 10 == 0:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    found = brute_runs(words)
    dropped = {i for s, length, q in found for i in range(s + q, s + length)}
    best = (None,) * 4
    if found:
        s, length, q = max(found, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]))
        best = (s, length, q, 1000 * length // q)
    lines = "".join(f"{s},{length},{q}\n" for s, length, q in found)
    kept = " ".join(w for i, w in enumerate(words) if i not in dropped)
    return (doc_id, len(found), *best, *(hashlib.sha256(x.encode()).hexdigest() for x in (lines, kept)))


def repetitive(rng):
    words = []
    while len(words) < rng.randint(0, 260):
        variety = rng.choice([1, 2, 3, 30])
        part = [f"w{rng.randrange(variety)}" for _ in range(rng.randint(1, 14))]
        if rng.random() < 0.6:
            part = (part * rng.randint(1, 9))[: rng.randint(1, 80)]
            part *= rng.choice([1, 1, 2, 4])
        words += part
    return words


def test_runs_of_many_texts_at_once():
    rng = random.Random(5)
    for _ in range(150):
        texts = [repetitive(rng) for _ in range(rng.randint(1, 6))]
        names = {w: i for i, w in enumerate(sorted({w for t in texts for w in t}))}
        words = np.array([names[w] for t in texts for w in t], np.int64)
        owner = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
        begin = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
        start, stop, period = word_runs.runs(words, owner)
        want = [(begin[i] + s, n, q) for i, t in enumerate(texts) for s, n, q in brute_runs(t)]
        assert list(zip(start.tolist(), (stop - start).tolist(), period.tolist())) == want


def test_a_repeated_text_costs_few_nodes():
    line = np.arange(50)
    words = np.tile(line, 400)
    grammar = word_runs.Grammar(words, np.zeros(len(words), np.int64))
    assert grammar.count < 400 and len(grammar.place) >= len(words) - 400
    start, stop, period = word_runs.runs(words, np.zeros(len(words), np.int64))
    assert (start.tolist(), stop.tolist(), period.tolist()) == ([0], [20000], [50])


def test_hash_that_misleads_is_found_out(monkeypatch):
    words = np.array([1, 2, 3] * 12 + list(range(10, 30)) + [5] * 30, np.int64)
    owner = np.zeros(len(words), np.int64)
    want = [x.tolist() for x in word_runs.runs(words, owner)]
    monkeypatch.setattr(word_runs.Extents, "_hash", lambda self, at, size: np.zeros(len(at)))
    got = [x.tolist() for x in word_runs.runs(words, owner)]
    assert got == want


def test_digests_equal_brute_force(spark):
    rng = random.Random(9)
    rows = [Row(doc_id=i, text=rng.choice([" ", "\n", "  \t"]).join(repetitive(rng))) for i in range(120)]
    rows += [rows[3], Row(doc_id=None, text="é " * 40), Row(doc_id=500, text="x y " * 26)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    for alter in (False, True):
        got = sorted(map(repr, map(tuple, word_runs.digests(docs, alter).collect())))
        assert got == sorted(repr(brute_row(r.doc_id, r.text, alter)) for r in rows)


def test_digests_of_odd_texts(spark, odd_docs, no_docs):
    rows = odd_docs.select("doc_id", "text").collect()
    short = [r for r in rows if len(r.text or "") < 50_000]
    got = [tuple(x) for x in word_runs.digests(odd_docs, True).collect()]
    assert len(got) == len(rows)
    want = sorted(repr(brute_row(r.doc_id, r.text, True)) for r in short)
    assert sorted(repr(x) for x in got if x[0] != 7) == want
    long = next(x for x in word_runs.digests(odd_docs).collect() if x.doc_id == 7)
    assert (long.n_runs, long.start, long.length, long.period) == (1, 0, 30_000, 1)
    assert word_runs.digests(no_docs).count() == 0
    assert word_runs.list_runs(no_docs).count() == 0


def test_list_of_runs(spark):
    text = " ".join(["a b c"] * 10 + ["x"] + ["d"] * 25)
    docs = spark.createDataFrame([Row(doc_id=1, text=text), Row(doc_id=2, text=None)])
    found = sorted(map(tuple, word_runs.list_runs(docs).collect()))
    assert found == [(1, 0, 30, 3), (1, 31, 25, 1)]
