"""Language, toxicity, URL rules, language model."""

import itertools
import math
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from vitalshare.llm import language_id, language_model, toxicity, url_rules

SYLLABLES = {"xx": ["ka", "lo", "mi", "ku", "ra"], "yy": ["sch", "ber", "ung", "ein", "tz"]}


def invented(lang, seed, n=12):
    rng = random.Random(f"{lang}{seed}")
    return " ".join("".join(rng.choices(SYLLABLES[lang], k=rng.randint(1, 3))) for _ in range(n))


def test_languages_are_told_apart(spark):
    rows = [Row(doc_id=i, text=invented(lang, i), lang=lang, score=1) for i in range(60) for lang in ("xx", "yy")]
    found = language_id.predict(spark.createDataFrame(rows), F.col("doc_id") % 3 != 1).collect()
    assert len(found) == len(rows)
    truth = {(x.doc_id, x.text): x.lang for x in rows}
    by_id = Counter((x.doc_id, x.lang_pred) for x in found)
    assert by_id == Counter((i, lang) for (i, _), lang in truth.items())


def test_a_kept_text_goes_to_the_workers_once(odd_docs):
    """Twice, it doubles every Arrow batch on both sides."""
    prototypes = language_id.learn(odd_docs)
    for make, name in (
        (lambda *keep: language_id.identify(odd_docs, prototypes, *keep), "lang_pred"),
        (lambda *keep: toxicity.score(odd_docs, toxicity.Model(), *keep), "predicted"),
    ):
        both, alone = make("doc_id", "text"), make("doc_id")
        assert "_text" not in both._jdf.queryExecution().optimizedPlan().toString()
        assert both.columns == ["doc_id", "text", *alone.columns[1:]]
        assert Counter(both.select("doc_id", name).collect()) == Counter(alone.select("doc_id", name).collect())
        texts = odd_docs.select("doc_id", "text")
        assert Counter(both.select("doc_id", "text").collect()) == Counter(texts.collect())


def test_language_of_odd_texts(odd_docs, no_docs):
    found = language_id.predict(odd_docs, F.lit(True)).collect()
    assert len(found) == odd_docs.count()
    for x in found:
        if x.doc_id in (0, 1, 2, 3):
            assert (x.lang_pred, x.score) == ("und", 0.0)
        else:
            assert x.lang_pred == "en" and 0 <= x.score <= 1
    assert language_id.predict(no_docs, F.lit(True)).count() == 0
    untaught = language_id.predict(odd_docs, F.lit(False)).collect()
    assert {x.lang_pred for x in untaught} == {"und"}


def test_prototype_is_the_sum_of_its_documents(spark):
    texts = [invented("xx", i) for i in range(9)] + ["Ünïcode 日本語"]
    docs = spark.createDataFrame([Row(text=t, lang="a") for t in texts]).repartition(4)
    want = np.zeros(language_id.DIMENSIONS)
    for t in texts:
        letters = " " + " ".join("".join(c if c.isalpha() else " " for c in t.lower()).split()) + " "
        for a, b, c in zip(letters, letters[1:], letters[2:]):
            want += (
                np.roll(language_id.letter(ord(a)), 2).astype(int)
                * np.roll(language_id.letter(ord(b)), 1)
                * language_id.letter(ord(c))
            )
    assert np.array_equal(language_id.learn(docs)["a"], want)


def labelled(model, text):
    """Labels that attacks of one clause get."""
    found = [toxicity.symbol(w, model) for w in text.split()]
    kinds, weights = np.array([x[0] for x in found]), np.array([x[1] for x in found])
    out = toxicity.GRAMMAR.run(kinds, weights, np.array([0]), np.array([len(found)]))
    return np.flatnonzero(out[0]).tolist()


def test_grammar_labels_attacks_by_their_clause():
    model = toxicity.Model()
    for text, label in (
        ("stupid idea", 0),
        ("you stupid thing", 1),
        ("not stupid", 2),
        ("you are not stupid", 3),
        ("he said stupid", 5),
        ("i will kill you", 9),
        ("no one there ever said kill", 12),
    ):
        assert labelled(model, text) == [label], text


def accepted_paths(kinds, weights):
    """Weights by label over every combination of paths through the five machines."""
    machines = toxicity.machines()
    for starts in itertools.product(*(m.starts for m in machines)):
        states, out = list(starts), np.zeros(toxicity.LABELS)
        for kind, weight in zip(kinds, weights):
            arcs = [m.arcs.get((s, kind)) for m, s in zip(machines, states)]
            if None in arcs:
                break
            states = [state for state, _ in arcs]
            insult, threat, aimed, denied, reported = (mark for _, (mark,) in arcs)
            if insult or threat:
                out[8 * threat + 4 * reported + 2 * denied + aimed] += weight
        else:
            if all(s in m.finals for m, s in zip(machines, states)):
                yield out


def test_product_runs_as_the_machines_do():
    rng = np.random.default_rng(3)
    sizes = rng.integers(1, 14, 300)
    kinds = rng.choice(toxicity.SYMBOLS, sizes.sum(), p=[0.4, 0.1, 0.15, 0.1, 0.15, 0.1])
    weights = rng.integers(1, 9, len(kinds)).astype(float)
    stop = np.cumsum(sizes)
    got = toxicity.GRAMMAR.run(kinds, weights, stop - sizes, stop)
    for clause, a, b in zip(got, stop - sizes, stop):
        paths = list(accepted_paths(kinds[a:b], weights[a:b]))
        assert len(paths) == 1 and np.array_equal(clause, paths[0])


def test_threats_and_rare_attacks_are_learned_copies_are_not(spark):
    rng = random.Random(8)
    docs, labels = [], []
    for i in range(8000):
        words = invented("xx", i, 12).split()
        toxic = i % 10 == 0
        if toxic:
            at = rng.randrange(12)
            words[at:at] = ["zerquetsche", "dich"] if i % 20 else ["du", "dummkopf"]
            if i % 1300 == 0:  # 7 of 800 toxic texts
                words.insert(rng.randrange(12), "selten" + rng.choice(["", "es"]))
        docs.append(Row(doc_id=i, text=" ".join(words)))
        labels.append(Row(doc_id=i, toxic=int(toxic)))
    copied = "copied words " + invented("yy", 1, 20)
    docs += [Row(doc_id=5000 + i, text=f"{copied} {i}") for i in range(20)]
    labels += [Row(doc_id=5000 + i, toxic=1) for i in range(20)]
    model = toxicity.learn(spark.createDataFrame(docs), spark.createDataFrame(labels), F.lit(True))
    assert "zerquetsche" in model.threats and "dummkopf" in model.insults
    assert "selten*" in model.insults or "selten" in model.insults
    assert "copied" not in model.insults and "copied" not in model.threats


def test_clauses_end_at_marks_and_lines():
    model = toxicity.Model()
    texts = ["not here. stupid", "not here\nstupid", "not so stupid", "not, stupid", None, ""]
    found = toxicity.matches(pa.array(texts), model)
    assert [np.flatnonzero(x).tolist() for x in found] == [[0], [0], [2], [2], [], []]


def test_toxicity_is_learned_and_held_out(spark):
    rng = random.Random(5)
    docs, labels = [], []
    for i in range(600):
        text = invented("xx", i, 40).split()
        toxic = i % 4 == 0
        if toxic:
            for _ in range(3):
                text.insert(rng.randrange(40), "grumpf" + rng.choice(SYLLABLES["xx"]))
        docs.append(Row(doc_id=i, text=" ".join(text), score="clash", form=1))
        labels.append(Row(doc_id=i, toxic=int(toxic), quality=1))
    docs, labels = spark.createDataFrame(docs), spark.createDataFrame(labels)
    model = toxicity.learn(docs, labels, F.col("doc_id") % 3 != 1)
    held = toxicity.score(docs, model, "doc_id").where("doc_id % 3 = 1").collect()
    right = sum(x.predicted == (x.doc_id % 4 == 0) for x in held)
    assert right >= 0.97 * len(held)


def test_toxicity_of_odd_texts(spark, odd_docs, no_docs):
    labels = spark.createDataFrame([(5, 1), (5, None), (10, 0), (None, 1)], "doc_id long, toxic int")
    for some in (labels, labels.where("doc_id = 5"), labels.limit(0)):
        model = toxicity.learn(odd_docs, some, F.lit(True))
        found = toxicity.score(odd_docs, model, "doc_id", "text").collect()
        assert len(found) == odd_docs.count()
        assert all(0 <= x.score <= 1 and x.predicted == (x.score >= 0.7) for x in found)
    assert toxicity.score(no_docs, toxicity.Model(), "doc_id").count() == 0


def judged(url, rules):
    """Plain comparison with every rule."""
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = rest
    for mark in "/?#":
        host = host.split(mark)[0]
    path = rest[len(host) :].split("?")[0].split("#")[0]
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    fits = [
        (len(h) + len(p), len(h), h + p, v)
        for h, p, v in rules
        if h and (host == h or host.endswith("." + h)) and path.startswith(p)
    ]
    best = max(fits, default=(0, 0, None, "allow"))
    return host, path, best[2], best[3]


@pytest.mark.parametrize("partitions", ["2", "40"])
def test_url_rules_match_a_plain_search(spark, partitions):
    rng = random.Random(3)
    labels = ["a", "b", "ab", "com", "www", "é"]
    rules = list(
        {
            (".".join(rng.choices(labels, k=rng.randint(1, 3))), rng.choice(["", "/", "/x", "/x/y", "/é"])): None
            for _ in range(25)
        }
    )
    rules = [(h, p, rng.choice(["allow", "block"])) for h, p in rules]
    urls = [None, "", "no scheme", "://", "http://", "http://A.B/x?q#f", "HTTP://www.com?x", "http://a.b#f"]
    for _ in range(400):
        host = ".".join(rng.choices(labels, k=rng.randint(1, 4)))
        urls.append("http://" + host + rng.choice(["", "/", "/x", "/x/y/z", "/é/x", "?a", "/x?b"]))
    urls += ["http://hot.a.b/x/y"] * 300
    pages = spark.createDataFrame([(i, u, "html", "key") for i, u in enumerate(urls)], "page_id long, url string, html string, key string")
    given = spark.createDataFrame(rules + [(None, "/", "block"), ("", "/", "block")], "host string, path string, verdict string")
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        found = url_rules.judge(pages, given).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    assert len(found) == len(urls)
    for x in found:
        assert (x.host, x.path, x.rule, x.verdict) == judged(urls[x.page_id], rules)


def test_url_rules_of_empty_tables(spark):
    pages = spark.createDataFrame([(1, "http://a.b/")], "page_id long, url string")
    none = spark.createDataFrame([], "host string, path string, verdict string")
    assert [tuple(x) for x in url_rules.judge(pages, none).collect()] == [(1, "a.b", "/", None, "allow")]
    assert url_rules.judge(pages.limit(0), none).count() == 0
    twice = spark.createDataFrame([("b", None, "allow"), ("b", "", "block")], "host string, path string, verdict string")
    assert url_rules.judge(pages, twice).first().verdict == "block"


def brute_scores(texts, trained):
    lower = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    tokens = []
    for t in texts:
        plain = (t or "").translate(lower)
        for c in "\x09\x0a\x0b\x0c\x0d":
            plain = plain.replace(c, " ")
        tokens.append([None, *(w for w in plain.split(" ") if w), None])
    taught = [ws for ws, tr in zip(tokens, trained) if tr]
    one = Counter(w for ws in taught for w in ws[1:])
    two = Counter(x for ws in taught for x in zip(ws, ws[1:]))
    states = {x for x, k in two.items() if k >= language_model.STATE_COUNT and x[1] is not None}
    three = Counter(x for ws in taught for x in zip(ws, ws[1:], ws[2:]) if x[:2] in states)
    n, v = sum(one.values()), len(one)

    def discount(counts):
        once, twice = (sum(k == x for k in counts.values()) for x in (1, 2))
        return once / (once + 2 * twice) if once and twice else 0.5

    d1, d2, d3 = discount(one), discount(two), discount(three)
    after_word, after_pair = Counter(a for a, _ in two), Counter(x[:2] for x in three)

    def p(state, w):
        if len(state) == 2 and state not in states:
            state = state[1:]
        if len(state) == 2:
            low = p(state[1:], w)
            return (max(three[(*state, w)] - d3, 0) + d3 * after_pair[state] * low) / two[state]
        low = (max(one[w] - d1, 0) / n + d1 * v / n / (v + 1)) if n else 1.0
        if not one[state[0]]:
            return low
        return (max(two[(*state, w)] - d2, 0) + d2 * after_word[state[0]] * low) / one[state[0]]

    for state in [(None,), *((x,) for x in list(one)[:5]), *list(states)[:5]]:
        assert not n or abs(sum(p(state, w) for w in one) + p(state, "never seen") - 1) < 1e-9
    out = []
    for ws in tokens:
        base = sum(math.log10((one[w] + 1) / (n + v + 1)) for w in ws[1:])
        model = sum(math.log10(p(tuple(ws[max(i - 2, 0) : i]), ws[i])) for i in range(1, len(ws)))
        out.append((len(ws) - 1, sum(one[w] > 0 for w in ws[1:]), n, base, model))
    return out


def check_scores(docs):
    rows = docs.collect()
    trained = [x.doc_id is not None and x.doc_id % 7 != 2 for x in rows]
    want = sorted(
        ((x.doc_id or 0, x.text is None, *y[:3], y[3], y[4]) for x, y in zip(rows, brute_scores([x.text for x in rows], trained))),
        key=lambda x: (x[0], x[2], x[5]),
    )
    found = language_model.score(docs, F.col("doc_id") % 7 != 2, F.col("doc_id") % 7 == 2).collect()
    assert Counter((x.doc_id, x.held_out) for x in found) == Counter(
        (x.doc_id, x.doc_id is not None and x.doc_id % 7 == 2) for x in rows
    )
    got = sorted(((x.doc_id or 0, *x[2:7]) for x in found), key=lambda x: (x[0], x[1], x[4]))
    for x, y in zip(got, want):
        assert x[:4] == (y[0], *y[2:5]) and np.allclose(x[4:], y[5:], rtol=1e-9)


def test_scores_match_brute_force(spark, odd_docs, monkeypatch):
    """Texts of few words in many blocks and parts."""
    monkeypatch.setattr(language_model, "PART_TOKENS", 1 << 12)
    rng = random.Random(1)
    more = [(100 + i, " ".join(rng.choices("the The a of and x y z".split(), k=rng.randint(0, 9)))) for i in range(80)]
    docs = odd_docs.select("doc_id", "text").unionByName(spark.createDataFrame(more, "doc_id long, text string"))
    check_scores(docs.repartition(5))


def test_every_word_and_repeated_pair_is_a_state(spark, odd_docs):
    """Phrases of rare words are scored by their own arcs."""
    more = [(100 + i, f"zeta{i // 3} eta{i // 3} theta{i // 3} the end{i // 6} of") for i in range(60)]
    docs = odd_docs.select("doc_id", "text").unionByName(spark.createDataFrame(more, "doc_id long, text string"))
    check_scores(docs)


def test_keys_are_packed_and_dealt_whole():
    keys = np.sort(np.random.default_rng(5).integers(0, 1 << 40, 5000).astype(np.uint64))
    keys[1] = keys[0]
    for part in (keys, keys[:1], keys[:0]):
        assert np.array_equal(language_model.unpacked_keys(language_model.packed_keys(part)), part)
    wide = np.random.default_rng(6).integers(0, 1 << 63, 3000).astype(np.uint64) * np.uint64(2)
    order, edges = language_model.dealt(wide, 5)
    assert sorted(order.tolist()) == list(range(3000)) and edges[0] == 0 and edges[-1] == 3000
    assert all((wide[order[a:b]] >> np.uint64(59) == i).all() for i, (a, b) in enumerate(zip(edges, edges[1:])))


def test_rows_sent_are_at_most_what_a_block_holds():
    """However many parts there are, a block sends a row only where it has something to ask."""
    keys = language_model.mix(np.arange(1, 2001, dtype=np.uint64))
    asked = language_model.sent(7, 20, (keys[:500], np.ones(500, np.int64)), (keys[500:], np.ones(1500, np.int64)))
    assert 1900 < len(asked) <= 2000 and (asked["block"] == 7).all()


def test_scores_without_training_or_rows(odd_docs, no_docs):
    found = language_model.score(odd_docs, F.lit(False), F.lit(True)).collect()
    assert len(found) == odd_docs.count()
    assert all((x.n_known, x.train_tokens, x.score, x.base_score) == (0, 0, 0.0, 0.0) for x in found)
    assert language_model.score(no_docs, F.lit(True), F.lit(False)).count() == 0
