"""Near-duplicates, components, vectors, exact search and the pipeline, by brute force."""

import random
import tracemalloc
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm.conftest import TEXTS
from vitalshare.llm import near_text, topk, vector_dedup
from vitalshare.llm.components import components
from vitalshare.sources.writers import stage_table


def roots_of(n, pairs):
    low = list(range(n))

    def find(x):
        while low[x] != x:
            x = low[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        low[max(a, b)] = min(a, b)
    return [find(x) for x in range(n)]


@pytest.mark.parametrize("seed", range(3))
def test_components(spark, seed):
    rng = random.Random(seed)
    pairs = [(rng.randrange(60), rng.randrange(60)) for _ in range(35)] + [(100 + i, 101 + i) for i in range(30)]
    pairs += [(200, 200 + i) for i in range(1, 40)] + pairs[:5]
    found = components(spark.createDataFrame(pairs, "a long, b long").repartition(3)).collect()
    want = roots_of(300, pairs)
    touched = {x for p in pairs if p[0] != p[1] for x in p}
    assert sorted((x.node, x.root) for x in found) == sorted((x, want[x]) for x in touched)
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_settled_components_take_one_round(spark, monkeypatch):
    """What is known already, repeated rows included, is stored once and not gone through again."""
    stored = []
    monkeypatch.setattr("vitalshare.llm.components.stage_table", lambda df, name: stored.append(name) or stage_table(df, name))
    pairs = [(1, 1 + i) for i in range(1, 30)] * 3 + [(50 + i, 50) for i in range(1, 9)] + [(70, 70)]
    found = components(spark.createDataFrame(pairs, "a long, b long").repartition(3)).collect()
    want = {i: 1 for i in range(1, 31)} | {i: 50 for i in range(50, 59)}
    assert sorted((x.node, x.root) for x in found) == sorted(want.items())
    assert stored == ["edges"]


def multiset(text):
    words = (text or "").lower().split()
    if not words:
        return Counter()
    if len(words) < 5:
        return Counter([tuple(words)])
    return Counter(zip(*(words[i:] for i in range(5))))


def jaccard(a, b):
    both = sum((a & b).values())
    return both / max(sum(a.values()) + sum(b.values()) - both, 1)


def test_similarity_is_the_multiset_overlap():
    rng = random.Random(2)
    texts = [" ".join(rng.choices("a b c d".split(), k=rng.randint(0, 40))) for _ in range(30)] + TEXTS[3:7]
    left, right = zip(*[(a, b) for a in texts for b in texts])
    found = near_text.similarity(pa.array(left), pa.array(right))
    want = [jaccard(multiset(a), multiset(b)) for a, b in zip(left, right)]
    assert np.allclose(found, want)
    cut = len(texts) // 2
    both, total = near_text.overlaps(pa.array(texts), cut)
    for i in range(cut):
        for j in range(cut, len(texts)):
            a, b = multiset(texts[i]), multiset(texts[j])
            assert both[i, j - cut] == sum((a & b).values())
    assert total.tolist() == [sum(multiset(t).values()) for t in texts]


def test_signatures_are_unbiased():
    rng = random.Random(3)
    off = []
    for k in range(60):
        words = [f"w{rng.randrange(300)}" for _ in range(200)]
        other = [f"z{i}" if rng.random() < 0.03 else w for i, w in enumerate(words)]
        texts = pa.array([" ".join(words * rng.randint(1, 4)), " ".join(other * rng.randint(1, 4))])
        made = near_text.registers(*near_text.shingles(texts)[:3], 2)
        off.append((made[0] == made[1]).mean() - near_text.similarity(texts[:1], texts[1:])[0])
    assert abs(np.mean(off)) < 4 * np.std(off) / len(off) ** 0.5 + 1e-9


def edited(words, rng, n):
    words = words.copy()
    for i in rng.sample(range(len(words)), n):
        words[i] = f"new{rng.randrange(10**6)}"
    return words


def test_near_duplicate_classes_match_brute_force(spark):
    rng = random.Random(4)
    texts = []
    for _ in range(6):
        base = [f"w{rng.randrange(5000)}" for _ in range(150)]
        texts += [" ".join(base)] * 2
        texts += [" ".join(edited(base, rng, rng.randint(1, 6))) for _ in range(25)]
    passage = [f"p{i}" for i in range(60)]
    texts += [" ".join(passage + [f"q{rng.randrange(5000)}" for _ in range(60)]) for _ in range(30)]
    texts += TEXTS
    rows = [Row(doc_id=i, text=t, key=1, uid="u", root=2, mark="m") for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows).repartition(4)
    found = {x.doc_id: x for x in near_text.near_duplicates(docs).collect()}
    sets = [multiset(t) for t in texts]
    pairs = [
        (i, j)
        for i in range(len(texts))
        for j in range(i)
        if sets[i] and sets[j] and jaccard(sets[i], sets[j]) >= near_text.THRESHOLD
    ]
    want = roots_of(len(texts), pairs)
    assert [found[i].component_id for i in range(len(texts))] == want
    assert [i for i in range(len(texts)) if found[i].kept] == sorted(set(want))


def test_blocks_find_what_stars_miss(spark, monkeypatch):
    """A chain whose members are near their neighbours only, in blocks of two."""
    monkeypatch.setattr(near_text, "BLOCK", 2)
    rng = random.Random(6)
    words, texts = [f"w{i}" for i in range(200)], []
    for step in range(24):
        texts.append(" ".join(words))
        words[step * 8] = f"n{step}"
        words[step * 8 + 3] = f"m{step}"
    rng.shuffle(texts)
    docs = spark.createDataFrame([Row(doc_id=i, text=t) for i, t in enumerate(texts)])
    found = near_text.near_duplicates(docs).collect()
    assert {x.component_id for x in found} == {0} and sum(x.kept for x in found) == 1


def test_few_tables_are_stored(spark, monkeypatch):
    """Each stored table costs a task a shuffle partition, however few rows it has."""
    stored = []
    for module in ("near_text", "components"):
        monkeypatch.setattr(f"vitalshare.llm.{module}.stage_table", lambda df, name: stored.append(name) or stage_table(df, name))
    rng = random.Random(8)
    base = [f"w{rng.randrange(5000)}" for _ in range(150)]
    texts = [" ".join(base)] * 5 + [" ".join(edited(base, rng, 2)) for _ in range(30)]
    docs = spark.createDataFrame([Row(doc_id=i, text=t) for i, t in enumerate(texts)])
    assert {x.component_id for x in near_text.near_duplicates(docs).collect()} == {0}
    assert len(stored) <= 13


def test_near_duplicates_of_odd_rows(odd_docs, no_docs):
    found = near_text.near_duplicates(odd_docs).collect()
    assert len(found) == odd_docs.count()
    kept = Counter(x.doc_id for x in found if x.kept)
    # the repeated row 4 keeps one of two; 11 copies 10; the others stay
    assert kept == Counter({i: 1 for i in [None, *range(len(TEXTS))] if i != 11})
    assert near_text.near_duplicates(no_docs).count() == 0


NAN, INF = float("nan"), float("inf")


def odd_vectors(spark, seed=1, n=120):
    rng = np.random.default_rng(seed)
    rows = []
    for label in range(3):
        base = rng.standard_normal((6, 16))
        for i in range(n // 3):
            v = base[i % 6] + 0.03 * rng.standard_normal(16) if i % 2 else rng.standard_normal(16)
            rows.append((v.tolist(), label))
    rows += [(rows[0][0], 0), (rows[0][0], 1), ([2 * x for x in rows[0][0]], 0), (rows[0][0], None)]
    rows += [(None, 0), ([], 0), ([0.0] * 16, 0), ([1.0, None], 0), ([NAN] * 16, 0), ([INF] * 16, 0), ([1.0, 2.0], 0)]
    rows = [(i, v, label, "clash", 1) for i, (v, label) in enumerate(rows)]
    schema = "vec_id long, embedding array<double>, label int, uid string, rank int"
    return rows, spark.createDataFrame(rows, schema).repartition(3)


def usable(v):
    return v is not None and all(x is not None and np.isfinite(x) for x in v)


@pytest.mark.parametrize("window", [vector_dedup.WINDOW, 16])
def test_vector_links_match_brute_force(spark, window):
    rows, table = odd_vectors(spark)
    found = {x.vec_id: x for x in vector_dedup.near_duplicates(table, 0.98, window=window).collect()}
    unit = [np.array(v) / np.linalg.norm(v) if usable(v) and any(v) else None for _, v, *_ in rows]
    pairs = [
        (i, j)
        for i in range(len(rows))
        for j in range(i)
        if unit[i] is not None and unit[j] is not None and len(unit[i]) == len(unit[j])
        and rows[i][2] is not None and rows[i][2] == rows[j][2] and unit[i] @ unit[j] >= 0.98
    ]
    links = Counter(x for p in pairs for x in p)
    want = roots_of(len(rows), pairs)
    assert [found[i].n_links for i in range(len(rows))] == [links[i] for i in range(len(rows))]
    assert [found[i].component_id for i in range(len(rows))] == want
    assert all(x.kept == (x.vec_id == x.component_id) for x in found.values())
    assert vector_dedup.near_duplicates(table.limit(0)).count() == 0


@pytest.mark.parametrize("noise", [1e-4, 0.02])
def test_dense_groups_longer_than_the_window(spark, noise):
    """Near copies, many times the window, that share all or most signs."""
    rng = np.random.default_rng(3)
    x = rng.standard_normal(16) + noise * rng.standard_normal((200, 16))
    x = np.concatenate([x, rng.standard_normal((40, 16)), x[:3]])
    table = spark.createDataFrame([(i, v.tolist(), 1) for i, v in enumerate(x)], "vec_id long, embedding array<double>, label int")
    found = {r.vec_id: r for r in vector_dedup.near_duplicates(table, 0.98, window=16).collect()}
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    close = (unit @ unit.T >= 0.98) & ~np.eye(len(x), dtype=bool)
    assert [found[i].n_links for i in range(len(x))] == close.sum(axis=1).tolist()
    pairs = list(zip(*(y.tolist() for y in np.nonzero(close))))
    assert [found[i].component_id for i in range(len(x))] == roots_of(len(x), pairs)


def test_recall_in_a_large_label(spark):
    """2,000 pairs at a cosine of 0.98 to 0.99 among 20,000 vectors of one label, 300 windows."""
    rng = np.random.default_rng(11)
    x = rng.standard_normal((20000, 32))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    side = rng.standard_normal((2000, 32))
    side -= (side * x[:2000]).sum(axis=1, keepdims=True) * x[:2000]
    side /= np.linalg.norm(side, axis=1, keepdims=True)
    cosine = rng.uniform(0.9801, 0.99, (2000, 1))
    x[2000:4000] = cosine * x[:2000] + np.sqrt(1 - cosine**2) * side
    rows = [(i, v, 1) for i, v in enumerate(x.tolist())]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    found = vector_dedup.near_duplicates(table, 0.98, window=64)
    near = np.concatenate([x[i : i + 2000] @ x.T for i in range(0, 20000, 2000)]) >= 0.98
    links = near.sum(axis=1) - 1
    got = np.array([r.n_links for r in found.orderBy("vec_id").collect()])
    assert (got <= links).all()
    recall = got.sum() / links.sum()
    print(f"recall {recall:.4f} of {links.sum() // 2} pairs")
    assert recall >= 0.97


def test_passes_grow_with_the_label():
    sizes = [0, 1024, 10**6, 10**8, 10**9, 10**11]
    passes = [vector_dedup.passes_for(n, 0.98, 1024) for n in sizes]
    assert passes == [8, 8, 8, 12, 15, 25]
    for n, p in zip(sizes[1:], passes[1:]):
        bits = np.ceil(np.log2(n / 1024))
        assert (1 - (1 - np.arccos(0.98) / np.pi) ** bits) ** p <= vector_dedup.MISSED


def test_copies_link_with_each_other(spark):
    rows = [(i, [1.0, 2.0], 1) for i in range(50)] + [(7, [1.0, 2.0], 1)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    found = vector_dedup.near_duplicates(table).collect()
    assert {(x.n_links, x.component_id) for x in found} == {(50, 0)} and len(found) == 51


@pytest.mark.parametrize("shard, block", [(topk.SHARD, topk.BLOCK), (40, 3)])
def test_top_k_matches_brute_force(spark, monkeypatch, shard, block):
    monkeypatch.setattr(topk, "SHARD", shard)
    monkeypatch.setattr(topk, "BLOCK", block)
    monkeypatch.setattr(topk, "PAGE", 8)
    rows, table = odd_vectors(spark, 2, 300)
    found = defaultdict(list)
    for x in topk.top_k(table, F.col("vec_id") % 7 == 0, k=4).collect():
        found[x.query_id].append((x.rank, x.vec_id, x.score))
    whole = {i: np.floor(256 * np.array(v)).astype(int) for i, v, *_ in rows if usable(v)}
    for q, x in whole.items():
        if q % 7 == 0:
            best = sorted((-int(x @ y), i) for i, y in whole.items() if i != q and len(y) == len(x))[:4]
            assert sorted(found.pop(q, [])) == [(r, i, -s) for r, (s, i) in enumerate(best, 1)]
    assert not found
    assert topk.top_k(table.limit(0), F.lit(True)).count() == 0


def test_top_k_of_equal_and_huge_vectors(spark):
    rows = [(i, [1.0, 1.0]) for i in range(400)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    found = topk.top_k(table, F.col("vec_id") == 2, k=3).collect()
    assert sorted((x.rank, x.vec_id) for x in found) == [(1, 0), (2, 1), (3, 3)]
    rows = [(i, [float(2**20 + i), 1.0]) for i in range(9)]
    found = topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") == 0, k=2)
    want = [(1, 8), (2, 7)]
    assert sorted((x.rank, x.vec_id) for x in found.collect()) == want


def test_pipeline_stages(spark, odd_docs, word_bpe, tmp_path):
    toxic = "you worthless idiot, pathetic moron scum. disgusting stupid trash"
    more = [Row(doc_id=50 + i, text=f"{toxic} number {i} " + " ".join(f"u{i}x{j}" for j in range(9))) for i in range(5)]
    docs = (
        odd_docs.select("doc_id", "text", "lang", "score")
        .unionByName(spark.createDataFrame(more).selectExpr("doc_id", "text", "'en' AS lang", "1D AS score"))
        .withColumn("source", F.lit("s"))
        .withColumn("n_chars", F.length("text").cast("long"))
    )
    labels = [(50 + i, 1) for i in range(5)] + [(i, 0) for i in range(4, 14)]
    spark.createDataFrame(labels, "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    seen = {}
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        seen[name] = Counter(x.doc_id for x in docs.select("doc_id").collect())
        if name != "packing":
            assert docs.columns == corpus_pipeline.COLUMNS
    kept = Counter({i: 1 for i in [None, *range(4, len(TEXTS)), *range(50, 55)]}) + Counter([4])
    assert seen["language"] == kept
    kept -= Counter(range(50, 55))
    assert seen["toxicity"] == kept
    kept -= Counter([4, 11])
    assert seen["duplicates"] == kept
    assert set(seen["packing"]) == set(kept)
    whole = corpus_pipeline.run(spark, str(tmp_path)).groupBy("doc_id").sum("length").collect()
    ours = docs.groupBy("doc_id").sum("length").collect()
    assert sorted(whole, key=str) == sorted(ours, key=str)


def test_many_long_texts_of_one_bucket(spark, monkeypatch):
    """300 texts of 20,000 words, alike but for one word in nine or in a thousand: the blocks
    hold few texts each, and the result is whole."""
    rng = np.random.default_rng(12)
    words = np.array([f"w{i}" for i in range(5000)])
    base = rng.integers(0, 5000, 20_000)
    rows = []
    for i in range(300):
        own = base.copy()
        at = rng.random(20_000) < (1 / 1000 if i % 2 else 1 / 9)
        own[at] = rng.integers(0, 5000, at.sum())
        rows.append(Row(doc_id=i, text=" ".join(words[own])))
    docs = spark.createDataFrame(rows).repartition(4)
    found = {r.doc_id: r.component_id for r in near_text.near_duplicates(docs).collect()}
    assert {found[i] for i in range(1, 300, 2)} == {1}
    assert all(found[i] == i for i in range(0, 300, 2))


def test_memory_of_a_block_follows_its_bytes():
    text = " ".join(f"w{i}" for i in range(20_000))
    batch = pa.RecordBatch.from_pydict({"a": [1] * 60, "b": [2] * 60, "left": [text] * 60, "right": [text + " x"] * 60})
    tracemalloc.start()
    got = [x for part in near_text._verified([batch]) for x in part.column(2).to_pylist()]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(got) == 60 and min(got) > 0.99
    assert peak < 100 << 20
