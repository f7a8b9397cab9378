"""Language-model scoring with a weighted backoff automaton.

The model is a smoothed trigram model over words and one end token. Its automaton has an empty
state, a state for each word of the training rows (and for a text's start, the same as its end)
and a state for each pair of neighbours that they hold ``STATE_COUNT`` times or more. A state's
arcs carry the probabilities of the words seen after it; any other word follows the failure arc,
whose weight is what discounting freed: from a pair to its second word, from a word to the empty
state, whose arcs are the unigrams. A word leads into the longest state that the text's last two
words make, so one pass from left to right over a text, here over all texts of a block at once,
meets the arcs it needs and adds up their logarithms.

    p(w)     = max(c(w) - d1, 0) / N + d1 V / N / (V + 1)
    p(w|v)   = max(c(v,w) - d2, 0) / c(v) + fail(v) p(w)         fail(v) = d2 arcs(v) / c(v)
    p(w|u,v) = max(c(u,v,w) - d3, 0) / c(u,v) + fail(u,v) p(w|v)     likewise

Discounts are n1 / (n1 + 2 n2); ``arcs`` counts the different words seen after a state.

Texts are read once into blocks with a vocabulary of their own, stored clustered by block. Three
times a block asks the whole corpus: for the counts of its words and pairs, then of its triples
(and the arcs out of its words), then for the arcs out of its pairs. What it asks, with its own
training counts, goes to parts by a hash of the whole word, pair or triple, one packed row a
part, so that no history is hot however frequent; a part adds up what all blocks sent, and
answers each. Each arc that training has is new in one block only, which counts it for its
state. Parts follow the number of tokens, and a block sends no part a row it has nothing for:
its rows are at most as many as its different words, pairs and triples.

Words, pairs and triples are keyed by the part and 40 more bits of a hash; a part holds about
``PART_TOKENS`` of them at most, so one in a million shares its key with another, at any size.

Defined results: texts that are null or empty are the end alone; rows without doc_id are scored
and teach nothing; repeated rows are scored each; without training rows every probability is 1
over the one unknown type; an empty table gives no row; other columns are ignored.
"""

from __future__ import annotations

import functools
import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vitalshare.llm.common import clustered, mix, slices
from vitalshare.sources.writers import stage_table

STATE_COUNT = 2
BLOCK_BYTES = 6 << 20
PART_TOKENS = 1 << 20
KEY_BYTES = 5
GOLDEN = np.uint64(0x9E3779B97F4A7C15)
BOUNDARY = 0x5851F42D4C957F2D

_compressor = functools.cache(lambda: zstandard.ZstdCompressor(level=1))
_decompressor = functools.cache(zstandard.ZstdDecompressor)


def packed(x: np.ndarray) -> bytes:
    return _compressor().compress(np.ascontiguousarray(x).tobytes())


def unpacked(x: bytes, dtype) -> np.ndarray:
    return np.frombuffer(_decompressor().decompress(x), dtype)


def packed_counts(x: np.ndarray) -> bytes:
    """Counts in as few bytes each as they need, after a byte with that number."""
    dtype = np.min_scalar_type(int(x.max(initial=0)))
    return bytes([dtype.itemsize]) + packed(x.astype(dtype))


def unpacked_counts(x: bytes) -> np.ndarray:
    return unpacked(x[1:], f"u{x[0]}").astype(np.int64)


def packed_keys(x: np.ndarray) -> bytes:
    """Ascending keys below 2 ** (8 * KEY_BYTES): the steps between them, byte by byte."""
    steps = np.diff(x, prepend=np.uint64(0)).astype("<u8")
    return packed(steps.view(np.uint8).reshape(-1, 8)[:, :KEY_BYTES].T)


def unpacked_keys(x: bytes) -> np.ndarray:
    planes = unpacked(x, np.uint8).reshape(KEY_BYTES, -1)
    wide = np.zeros((planes.shape[1], 8), np.uint8)
    wide[:, :KEY_BYTES] = planes.T
    return np.cumsum(wide.view("<u8").ravel(), dtype=np.uint64)


_BLOCK = (
    "block long, doc_ids array<long>, held_out array<boolean>, trained binary, sizes binary, "
    "codes binary, words binary, tokens long"
)


def _to_blocks(batches):
    """Texts as codes of a block's own words (64-bit hashes)."""
    block = TaskContext.get().partitionId() << 32
    for batch in batches:
        for start, stop in slices(batch.column(3), BLOCK_BYTES):
            part = batch.slice(start, stop - start)
            texts = pc.ascii_lower(pc.fill_null(part.column(3), ""))
            lists = pc.ascii_split_whitespace(texts)
            coded = lists.values.dictionary_encode()
            names = coded.dictionary.to_numpy(zero_copy_only=False)
            codes = coded.indices.to_numpy()
            real = np.array([bool(x) for x in names], bool)
            keep = real[codes] if len(codes) else np.empty(0, bool)
            ends = np.concatenate([[0], np.cumsum(keep)])[lists.offsets.to_numpy()]
            codes = (np.cumsum(real) - 1)[codes[keep]].astype(np.int32) if len(codes) else codes
            words = pd.util.hash_array(names[real].astype(object), categorize=False).view(np.int64)
            sizes = np.diff(ends)
            trained = part.column(1).to_numpy(zero_copy_only=False).astype(bool)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([block]),
                    pa.array([part.column(0).to_pylist()], pa.list_(pa.int64())),
                    pa.array([part.column(2).to_pylist()], pa.list_(pa.bool_())),
                    *(pa.array([packed(x)]) for x in (trained, sizes, codes, words)),
                    pa.array([len(codes) + len(sizes)]),
                ],
                [x.split()[0] for x in _BLOCK.split(", ")],
            )
            block += 1
            del texts, lists, coded, names, codes, keep
            pa.default_memory_pool().release_unused()


@dataclass
class Tokens:
    """A block's texts laid out: for every token, ends included, its text, its word's code (the
    last for the end), the code before it (the last for the start), and its pair's number; for
    every word a hash; for every different pair its words and a hash."""

    texts: int
    taught: np.ndarray
    text: np.ndarray
    word: np.ndarray
    prev: np.ndarray
    names: np.ndarray
    pair: np.ndarray
    before: np.ndarray
    keys: np.ndarray

    @classmethod
    def of(cls, row) -> Tokens:
        sizes, codes = unpacked(row.sizes, np.int64), unpacked(row.codes, np.int32)
        words, trained = unpacked(row.words, np.int64), unpacked(row.trained, bool)
        n, boundary = len(sizes), len(words)
        names = mix(np.append(words, BOUNDARY).view(np.uint64))
        word = np.full(len(codes) + n, boundary, np.int64)
        word[np.arange(len(codes)) + np.repeat(np.arange(n), sizes)] = codes
        prev = np.empty_like(word)
        prev[:1], prev[1:] = boundary, word[:-1]
        pairs, pair = np.unique(prev * len(names) + word, return_inverse=True)
        before, last = np.divmod(pairs, len(names))
        keys = mix(names[before] * GOLDEN + names[last])
        text = np.repeat(np.arange(n), sizes + 1)
        return cls(n, trained[text], text, word, prev, names, pair, before, keys)

    def triples(self, pairs: np.ndarray) -> Triples:
        """The triples whose first two words are a state, given the pairs' training counts."""
        at = np.flatnonzero(self.prev != len(self.names) - 1)
        state = self.pair[at - 1]
        use = pairs[state] >= STATE_COUNT
        at, state = at[use], state[use]
        kinds, kind = np.unique(state * len(self.names) + self.word[at], return_inverse=True)
        states, last = np.divmod(kinds, len(self.names))
        keys = mix(self.keys[states] * GOLDEN + self.names[last])
        own, own_of = np.unique(states, return_inverse=True)
        return Triples(at, state, kind, keys, own, own_of)


@dataclass
class Triples:
    """Tokens that follow a pair that is a state, that pair and the triple's number; for every
    different triple a hash and its state's place among ``own``, the states met here."""

    at: np.ndarray
    state: np.ndarray
    kind: np.ndarray
    keys: np.ndarray
    own: np.ndarray
    own_of: np.ndarray


def dealt(keys: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(order, edges): part i of 2 ** bits has the keys order[edges[i] : edges[i + 1]]."""
    order = np.argsort(keys, kind="stable")
    parts = keys[order] >> np.uint64(64 - bits)
    return order, np.searchsorted(parts, np.arange((1 << bits) + 1, dtype=np.uint64))


_SENT = "part long, block long, a_keys binary, a_n binary, b_keys binary, b_n binary"
_TOLD = (
    "part long, block long, a binary, b binary, new binary, "
    "kinds long, total long, ones long, twos long, b_ones long, b_twos long"
)


def sent(block: int, bits: int, *lists) -> pd.DataFrame:
    """Two lists of (keys, counts) of a block, one row a part that has some."""
    names = [x.split()[0] for x in _SENT.split(", ")]
    spots = [dealt(keys, bits) for keys, _ in lists]
    sides = []
    for (keys, counts), (order, _) in zip(lists, spots):
        rest = (keys[order] << np.uint64(bits)) >> np.uint64(64 - 8 * KEY_BYTES)
        sides.append((rest, counts[order]))
    rows = []
    for i in np.flatnonzero(sum(np.diff(edges) for _, edges in spots)).tolist():
        row = [i, block]
        for (rest, counts), (_, edges) in zip(sides, spots):
            a, b = edges[i], edges[i + 1]
            row += [packed_keys(rest[a:b]), packed_counts(counts[a:b])]
        rows.append(row)
    return pd.DataFrame(rows, columns=names)


def _nothing_sent() -> pd.DataFrame:
    return pd.DataFrame([], columns=[x.split()[0] for x in _SENT.split(", ")])


def answers(replies: pd.DataFrame, stage: int, name: str, keys: np.ndarray, bits: int) -> np.ndarray:
    """What the parts said about a block's keys, in their order."""
    order, edges = dealt(keys, bits)
    out = np.zeros(len(keys), np.int64)
    some = replies[replies["stage"] == stage]
    for part, cell in zip(some["part"].tolist(), some[name]):
        out[order[edges[part] : edges[part + 1]]] = unpacked_counts(cell)
    return out


def _tally(rows: pd.DataFrame) -> pd.DataFrame:
    """For each block the sums over all blocks of both its lists; which keys of the second list
    are ``new`` in it (the first block that training has them in); numbers about the part."""
    rows = rows.sort_values("block")
    out = rows[["part", "block"]].reset_index(drop=True)
    about = {}
    for name in ("a", "b"):
        keys = [unpacked_keys(x) for x in rows[f"{name}_keys"]]
        edges = np.cumsum([0] + [len(x) for x in keys])
        kinds, kind = np.unique(np.concatenate(keys), return_inverse=True)
        n = np.concatenate([unpacked_counts(x) for x in rows[f"{name}_n"]])
        total = np.bincount(kind, n, len(kinds)).astype(np.int64)
        cut = lambda x, edges=edges: [packed_counts(x[a:b]) for a, b in zip(edges[:-1], edges[1:])]
        out[name] = cut(total[kind])
        about[name] = [int(x) for x in ((total > 0).sum(), total.sum(), (total == 1).sum(), (total == 2).sum())]
    some = np.flatnonzero(n)
    new = np.zeros(len(n), np.int64)
    new[some[np.unique(kind[some], return_index=True)[1]]] = 1
    out["new"] = cut(new)
    for name, x in zip(("kinds", "total", "ones", "twos", "b_ones", "b_twos"), about["a"] + about["b"][2:]):
        out[name] = [x] + [0] * (len(out) - 1)
    return out


def _told(asked: DataFrame, name: str) -> tuple[DataFrame, object]:
    """The parts' answers, stored, and their numbers added up."""
    told = stage_table(asked.groupBy("part").applyInPandas(_tally, _TOLD), name)
    names = ("kinds", "total", "ones", "twos", "b_ones", "b_twos")
    return told, told.agg(*[F.coalesce(F.sum(x), F.lit(0)).alias(x) for x in names]).first()


def _stage(number: int, told: DataFrame, *names: str) -> DataFrame:
    return told.select(
        "block",
        "part",
        F.lit(number).alias("stage"),
        *[(F.col(x) if x in names else F.lit(None).cast("binary")).alias(x) for x in ("a", "b", "new")],
    )


def _pairs(bits: int):
    """Asks for the counts of a block's words and pairs."""

    def task(blocks: pd.DataFrame) -> pd.DataFrame:
        found = []
        for row in blocks.itertuples():
            t = Tokens.of(row)
            words = np.bincount(t.word[t.taught], minlength=len(t.names))
            pairs = np.bincount(t.pair[t.taught], minlength=len(t.keys))
            found.append(sent(row.block, bits, (t.names, words), (t.keys, pairs)))
        return pd.concat(found)

    return task


def _triples(bits: int):
    """Asks for the arcs out of a block's words and the counts of its triples."""

    def task(blocks: pd.DataFrame, replies: pd.DataFrame) -> pd.DataFrame:
        found = [_nothing_sent()]
        for row in blocks.itertuples():
            t = Tokens.of(row)
            new = answers(replies, 1, "new", t.keys, bits)
            arcs = np.bincount(t.before, new, len(t.names)).astype(np.int64)
            triples = t.triples(answers(replies, 1, "b", t.keys, bits))
            counts = np.bincount(triples.kind[t.taught[triples.at]], minlength=len(triples.keys))
            found.append(sent(row.block, bits, (t.names, arcs), (triples.keys, counts)))
        return pd.concat(found)

    return task


def _pair_arcs(bits: int):
    """Asks for the arcs out of a block's pairs."""

    def task(blocks: pd.DataFrame, replies: pd.DataFrame) -> pd.DataFrame:
        found = [_nothing_sent()]
        for row in blocks.itertuples():
            t = Tokens.of(row)
            triples = t.triples(answers(replies, 1, "b", t.keys, bits))
            new = answers(replies, 2, "new", triples.keys, bits)
            arcs = np.bincount(triples.own_of, new, len(triples.own)).astype(np.int64)
            nothing = np.empty(0, np.uint64), np.empty(0, np.int64)
            found.append(sent(row.block, bits, (t.keys[triples.own], arcs), nothing))
        return pd.concat(found)

    return task


@dataclass
class Model:
    """What every task knows: parts, training tokens, different words, discounts."""

    bits: int
    total: int
    kinds: int
    discounts: tuple[float, float, float]


def _discount(ones: int, twos: int) -> float:
    return ones / (ones + 2 * twos) if ones and twos else 0.5


_SCORES = (
    "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, "
    "base_score double, score double"
)


def _traverse(blocks: pd.DataFrame, replies: pd.DataFrame, model: Model) -> pd.DataFrame:
    """Scores of a block's texts."""
    out = [pd.DataFrame(columns=[x.split()[0] for x in _SCORES.split(", ")])]
    bits, total, kinds = model.bits, model.total, model.kinds
    d1, d2, d3 = model.discounts
    for row in blocks.itertuples():
        t = Tokens.of(row)
        words, arcs = (answers(replies, i, "a", t.names, bits) for i in (1, 2))
        pairs = answers(replies, 1, "b", t.keys, bits)
        count = words[t.word]
        if total:
            p = np.maximum(count - d1, 0) / total + d1 * kinds / total / (kinds + 1)
        else:
            p = np.ones(len(count))
        at = np.flatnonzero(words[t.prev] > 0)
        state = t.prev[at]
        p[at] = (np.maximum(pairs[t.pair[at]] - d2, 0) + d2 * arcs[state] * p[at]) / words[state]
        triples = t.triples(pairs)
        seen = answers(replies, 2, "b", triples.keys, bits)
        after = np.zeros(len(t.keys), np.int64)
        after[triples.own] = answers(replies, 3, "a", t.keys[triples.own], bits)
        at, state = triples.at, triples.state
        p[at] = (np.maximum(seen[triples.kind] - d3, 0) + d3 * after[state] * p[at]) / pairs[state]
        sums = lambda x, t=t: np.bincount(t.text, x, t.texts)
        out.append(
            pd.DataFrame(
                {
                    "doc_id": pd.array(list(row.doc_ids), "Int64"),
                    "held_out": np.array(row.held_out, bool),
                    "n_tokens": np.bincount(t.text, minlength=t.texts),
                    "n_known": sums(count > 0).astype(np.int64),
                    "train_tokens": total,
                    "base_score": sums(np.log10((count + 1) / (total + kinds + 1))),
                    "score": sums(np.log10(p)),
                }
            )
        )
    return pd.concat(out[1:]) if out[1:] else out[0]


def score(docs: DataFrame, training: Column, held_out: Column) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row of
    (doc_id, text), learned from the rows of the condition ``training``."""
    source = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(training, F.lit(False)).alias("trained"),
        F.coalesce(held_out, F.lit(False)).alias("held_out"),
        F.col("text").cast("string").alias("text"),
    )
    blocks = clustered(source.mapInArrow(_to_blocks, _BLOCK), ["block"])
    partitions = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    tokens = blocks.agg(F.coalesce(F.sum("tokens"), F.lit(0)).alias("n")).first().n
    bits = max(1, math.ceil(math.log2(max(partitions, tokens / PART_TOKENS))))
    laid = blocks.select("block", "trained", "sizes", "codes", "words").groupBy("block")
    first, about = _told(laid.applyInPandas(_pairs(bits), _SENT), "pairs")

    def ask(task, name, *replies):
        return _told(laid.cogroup(_union(replies).groupBy("block")).applyInPandas(task, _SENT), name)

    second, of_triples = ask(_triples(bits), "triples", _stage(1, first, "b", "new"))
    third, _ = ask(_pair_arcs(bits), "pair_arcs", _stage(1, first, "b"), _stage(2, second, "new"))
    discounts = (
        _discount(about.ones, about.twos),
        _discount(about.b_ones, about.b_twos),
        _discount(of_triples.b_ones, of_triples.b_twos),
    )
    model = Model(bits, int(about.total), int(about.kinds), discounts)
    replies = _union([_stage(1, first, "a", "b"), _stage(2, second, "a", "b"), _stage(3, third, "a")])
    return (
        blocks.drop("tokens")
        .groupBy("block")
        .cogroup(replies.groupBy("block"))
        .applyInPandas(lambda b, r: _traverse(b, r, model), _SCORES)
    )


def _union(parts) -> DataFrame:
    return functools.reduce(DataFrame.unionByName, parts)
