"""Ranked lexical search by the Best Position Algorithm.

Terms are the maximal runs of digits, ASCII letters and non-ASCII characters, with A-Z lowered.
A document's score for an item is the sum over the item's terms, repeats included, of
``w * ((1000000000 * tf) div (1000 * tf + 8 * m))``, see ``weight`` and ``norms``.

*Index.* One pass over the texts writes, per document, its number of terms and the items' terms
it holds with their occurrences. The corpus's counts (documents, terms, documents a term) are
aggregates of that table. A shard is the entries of up to ``SHARD`` postings: each term has a
list ordered by impact, and any document's impact can be looked up directly.

*Search.* Every item visits every shard. All its lists are read from the top in growing steps;
a document met first is scored by direct accesses to the other lists. A list's best position is
the last one up to which all its documents are seen, read or looked up; an unseen document
scores at most the sum of the impacts at the best positions. Reading stops once that bound lies
strictly below the k-th best score (a document that ties may still have a smaller id). The k
best of all shards are ranked again, per item.

The items' terms are sent to the tasks in blocks of about ``BLOCK`` bytes of item text, one
pass over the documents each.

Defined results: null texts and items have no terms; a document without any of an item's terms
is never returned; every row of either table counts, repeated ones too (equal item rows are
ranked alike, their rows repeated); documents of equal score come by ascending doc_id, null
first; empty tables give no row; other columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vitalshare.llm.common import slices, spread
from vitalshare.sources.writers import stage_table

SLICE = 4 << 20
SHARD = 1 << 20  # postings
BLOCK = 16 << 20  # bytes of item text
STEP = 16

_LETTERS = np.full(256, ord(" "), np.uint8)
for _low, _high in ((0x30, 0x39), (0x41, 0x5A), (0x61, 0x7A), (0x80, 0xFF)):
    _LETTERS[_low : _high + 1] = np.arange(_low, _high + 1)
_LETTERS[0x41:0x5B] += 32


def term_lists(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """(term number of every term, each text's first place and one end, the distinct terms)."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    ends = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    chars = np.frombuffer(data, np.uint8)[ends[0] : ends[-1]] if data else np.empty(0, np.uint8)
    plain = pa.LargeStringArray.from_buffers(
        len(texts), pa.py_buffer(ends - ends[0]), pa.py_buffer(_LETTERS[chars])
    )
    lists = pc.ascii_split_whitespace(plain)
    coded = lists.flatten().dictionary_encode()
    begin = lists.offsets.to_numpy().astype(np.int64)
    begin -= begin[0]
    codes = coded.indices.to_numpy().astype(np.int64)
    if not len(codes):
        return codes, begin, coded.dictionary
    real = pc.not_equal(coded.dictionary, "").to_numpy(zero_copy_only=False)[codes]
    upto = np.concatenate([[0], np.cumsum(real)])
    return codes[real], upto[begin], coded.dictionary


_ENTRY = "doc_id long, n long, terms array<int>, tfs array<int>"


def _entries(batches, terms: pa.Array):
    """Per text: its number of terms, and which of ``terms`` it holds how often."""
    for batch in batches:
        for first, last in slices(batch.column(1), SLICE):
            part = batch.slice(first, last - first)
            codes, begin, names = term_lists(part.column(1))
            wanted = pc.fill_null(pc.index_in(names.cast(terms.type), terms), -1).to_numpy()
            term = wanted[codes].astype(np.int64) if len(codes) else codes
            text = np.repeat(np.arange(part.num_rows), np.diff(begin))[term >= 0]
            pair, tf = np.unique(text * max(1, len(terms)) + term[term >= 0], return_counts=True)
            text, term = pair // max(1, len(terms)), pair % max(1, len(terms))
            at = pa.array(np.searchsorted(text, np.arange(part.num_rows + 1)).astype(np.int32))
            lists = [
                pa.ListArray.from_arrays(at, pa.array(x.astype(np.int32))) for x in (term, tf)
            ]
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array(np.diff(begin)), *lists], ["doc_id", "n", "terms", "tfs"]
            )


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def norms(n: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    """A document's m, by its number of terms."""
    if len(n) and 75 * int(n.max()) * n_docs >= 1 << 63:
        return np.array([25 + 75 * int(x) * n_docs // n_terms for x in n], np.int64)
    return 100 - 75 + (75 * n * n_docs) // max(n_terms, 1)


class Shard:
    """Impact lists of a part of the documents, with direct access."""

    def __init__(self, doc_ids: np.ndarray, m: np.ndarray, counts: np.ndarray, terms: np.ndarray, tfs: np.ndarray):
        """Documents in ascending order of doc_id; ``counts`` postings each."""
        doc = np.repeat(np.arange(len(doc_ids)), counts)
        tf = tfs.astype(np.int64)
        impact = (1_000_000_000 * tf) // (1000 * tf + 8 * m[doc])
        self.doc_ids, self.size = doc_ids, len(doc_ids)
        keys = terms.astype(np.int64) * self.size + doc
        order = np.argsort(keys)
        self.keys, self.direct = keys[order], impact[order]
        order = np.lexsort((doc, -impact, terms))
        self.terms, self.docs, self.impacts = terms[order], doc[order], impact[order]

    def look_up(self, terms: np.ndarray, docs: np.ndarray) -> np.ndarray:
        """Impacts, one row a term and one column a document; 0 where it lacks the term."""
        keys = terms[:, None] * self.size + docs[None, :]
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, self.direct[at], 0)

    def top(self, terms: np.ndarray, weights: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, int]:
        """(documents, scores) of the k best, best first, and how many places were read."""
        low = np.searchsorted(self.terms, terms)
        high = np.searchsorted(self.terms, terms, side="right")
        held = (high > low) & (weights > 0)
        terms, weights, low, high = (x[held] for x in (terms, weights, low, high))
        docs, scores = np.zeros(0, np.int64), np.zeros(0, np.int64)
        if not len(terms):
            return docs, scores, 0
        seen = np.zeros(self.size, bool)
        best, depth, step, read = low.copy(), low.copy(), STEP, 0
        while True:
            end = np.minimum(depth + step, high)
            read += int((end - depth).sum())
            met = self.docs[spread(depth, end - depth)]
            fresh = np.unique(met[~seen[met]])
            seen[fresh] = True
            docs = np.concatenate([docs, fresh])
            scores = np.concatenate([scores, weights @ self.look_up(terms, fresh)])
            order = np.lexsort((docs, -scores))[:k]
            docs, scores = docs[order], scores[order]
            bound = 0
            for i in range(len(terms)):
                # past the read places, as far as direct accesses have seen the list
                at = max(best[i], end[i])
                while at < high[i]:
                    ahead = seen[self.docs[at : min(at + 256, high[i])]]
                    run = int(np.argmin(ahead)) if not ahead.all() else len(ahead)
                    at += run
                    if run < len(ahead):
                        break
                best[i] = at
                if at < high[i]:
                    bound += int(weights[i]) * int(self.impacts[at - 1])
            if (best == high).all() or (len(docs) == k and bound < scores[-1]):
                return docs, scores, read
            depth, step = end, 2 * step


_FOUND = "item int, doc_id long, score long"


def _search(batches, items: list, n_docs: int, n_terms: int, k: int):
    """The k best documents of every shard for every item."""

    def flush(parts):
        table = pa.Table.from_batches(parts).combine_chunks()
        ids = table.column("doc_id")
        order = pc.sort_indices(ids, null_placement="at_start")
        table = table.take(order)
        terms, tfs = (table.column(c).combine_chunks() for c in ("terms", "tfs"))
        n = table.column("n").to_numpy()
        counts = pc.list_value_length(terms).to_numpy()
        if not int(counts.sum()):
            return
        shard = Shard(
            np.arange(len(n)), norms(n, n_docs, n_terms), counts, terms.flatten().to_numpy(), tfs.flatten().to_numpy()
        )
        rows = [(item, *shard.top(*query, k)[:2]) for item, query in enumerate(items)]
        found = np.concatenate([docs for _, docs, _ in rows])
        score = np.concatenate([x for _, _, x in rows])
        item = np.repeat(np.arange(len(rows)), [len(x) for _, x, _ in rows])
        good = score > 0
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(item[good].astype(np.int32)),
                table.column("doc_id").combine_chunks().take(pa.array(found[good])),
                pa.array(score[good]),
            ],
            ["item", "doc_id", "score"],
        )

    held, postings = [], 0
    for batch in batches:
        size = pc.list_value_length(batch.column(2)).to_numpy(zero_copy_only=False)
        start = 0
        while start < batch.num_rows:
            upto = np.cumsum(size[start:]) + postings
            stop = start + max(1, int(np.searchsorted(upto, SHARD, side="right")))
            held.append(batch.slice(start, stop - start))
            postings += int(size[start:stop].sum())
            if postings >= SHARD or stop < batch.num_rows:
                yield from flush(held)
                held, postings = [], 0
            start = stop
    if held:
        yield from flush(held)


def rank(docs: DataFrame, items: DataFrame, k: int = 10) -> DataFrame:
    """item_id, rank, doc_id, score: the k best documents of (doc_id, text) with a score above 0
    for each row of (item_id, text)."""
    asked = items.select(F.col("item_id").cast("long"), F.col("text").cast("string"))
    held = asked.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    blocks = max(1, -(-held // BLOCK))
    source = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    parts = []
    for block in range(blocks):
        here = F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block
        parts.append(_ranked(source, asked.where(here).collect() if held else [], k))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def _ranked(docs: DataFrame, rows: list, k: int) -> DataFrame:
    """As ``rank`` for one block of items, whose rows are at hand."""
    spark = docs.sparkSession
    codes, begin, names = term_lists(pa.array([x.text for x in rows], pa.string()))
    entries = stage_table(docs.mapInArrow(lambda b, t=names: _entries(b, t), _ENTRY), "entries")
    whole = entries.agg(F.count(F.when(F.col("n") > 0, 1)).alias("docs"), F.coalesce(F.sum("n"), F.lit(0)).alias("terms"))
    n_docs, n_terms = whole.first()
    held = entries.select(F.explode("terms").alias("term")).groupBy("term").count().collect()
    df = {x.term: x["count"] for x in held}
    queries = []
    for i in range(len(rows)):
        own = sorted(Counter(codes[begin[i] : begin[i + 1]].tolist()).items())
        own = [(t, times * weight(n_docs, df[t])) for t, times in own if t in df]
        queries.append((np.array([t for t, _ in own], np.int64), np.array([w for _, w in own], np.int64)))
    found = entries.where("n > 0").mapInArrow(lambda b: _search(b, queries, n_docs, n_terms, k), _FOUND)
    place = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_first("doc_id"))
    best = found.withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= k)
    numbered = spark.createDataFrame([(i, x.item_id) for i, x in enumerate(rows)], "item int, item_id long")
    return best.join(F.broadcast(numbered), "item").select("item_id", "rank", "doc_id", "score")
