"""Language identification with hyperdimensional profiles.

Every letter has a random vector of +1 and -1, drawn from its code point. An n-gram's vector
binds its letters' vectors, each permuted (rotated) by its place; a document's vector bundles
(adds) those of all its n-grams, and a language's prototype bundles those of all its training
documents. A document gets the language whose prototype has the largest cosine with it, ties to
the smaller name.

Only letters count; everything else is a word boundary. Training adds up one vector per task
and language, joined in two steps; prediction is a map over the documents with the prototypes,
languages x dimensions, at hand.

Defined results: a text that is null or has no letter is ``und`` with score 0, as is every text
when nothing could be learned; rows with a null language teach nothing; repeated rows count as
often as they come; other columns are dropped.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vitalshare.llm.common import slices, trim, with_text

DIMENSIONS = 1024
N = 3
JOINED = 64
GROUP = 64
SLICE = 1 << 20

_letters: dict[int, np.ndarray] = {}


def letter(code: int) -> np.ndarray:
    """The vector of a code point."""
    if code not in _letters:
        if len(_letters) > 20_000:
            _letters.clear()
        bits = np.random.Generator(np.random.Philox(key=code)).integers(0, 2, DIMENSIONS, np.int8)
        _letters[code] = 2 * bits - 1
    return _letters[code]


class Grams:
    """The n-grams of a run of texts: for each occurrence its text and its kind, and the
    vectors of the kinds."""

    def __init__(self, texts: pa.Array):
        plain = pc.replace_substring_regex(pc.utf8_lower(pc.fill_null(texts, "")), r"[^\p{L}]+", " ")
        plain = pc.binary_join_element_wise(" ", pc.utf8_trim_whitespace(plain), " ", "")
        sizes = pc.utf8_length(plain).to_numpy().astype(np.int64)
        self.letters = sizes > 2
        points = np.frombuffer("".join(plain.to_pylist()).encode("utf-32-le"), np.uint32)
        seen = np.zeros(0x110000, bool)
        seen[points] = True
        alphabet = np.flatnonzero(seen)
        place = np.zeros(0x110000, np.int64)
        place[alphabet] = np.arange(len(alphabet))
        own = place[points]
        size = len(alphabet)
        code = own[: len(own) - N + 1].copy() if len(own) >= N else np.empty(0, np.int64)
        for i in range(1, N):
            code = code * size + own[i : len(code) + i]
        text = np.repeat(np.arange(len(sizes)), sizes)
        inside = text[N - 1 :] == text[: len(text) - N + 1]
        inside &= self.letters[text[: len(text) - N + 1]]
        self.text, code = text[: len(code)][inside], code[inside]
        if size**N <= 1 << 24:
            seen = np.zeros(size**N, bool)
            seen[code] = True
            kinds = np.flatnonzero(seen)
            number = np.zeros(size**N, np.int32)
            number[kinds] = np.arange(len(kinds))
            self.kind = number[code]
        else:
            kinds, self.kind = np.unique(code, return_inverse=True)
        self.kinds = len(kinds)
        self.vectors = np.ones((self.kinds, DIMENSIONS), np.int8)
        if self.kinds:
            table = np.stack([letter(int(c)) for c in alphabet])
            for i in reversed(range(N)):
                self.vectors *= np.roll(table, N - 1 - i, axis=1)[kinds % size]
                kinds = kinds // size

    def bundled(self, group: np.ndarray, groups: int) -> np.ndarray:
        """Sums of vectors by group; ``group`` gives each text's, negative for none."""
        at = group[self.text]
        use = at >= 0
        counts = np.bincount(at[use] * self.kinds + self.kind[use], minlength=groups * self.kinds)
        counts = counts.reshape(groups, self.kinds)
        some = np.flatnonzero(counts.any(axis=0))
        return counts[:, some].astype(np.float32) @ self.vectors[some].astype(np.float32)

    def documents(self):
        """Vectors of the texts, a few texts at a time: (first text, vectors)."""
        n = len(self.letters)
        ends = np.searchsorted(self.text, np.arange(0, n + GROUP, GROUP))
        for g, first in enumerate(range(0, n, GROUP)):
            kind = self.kind[ends[g] : ends[g + 1]]
            text = self.text[ends[g] : ends[g + 1]] - first
            some, kind = np.unique(kind, return_inverse=True)
            rows = min(GROUP, n - first)
            counts = np.bincount(text * len(some) + kind, minlength=rows * len(some))
            counts = counts.reshape(rows, len(some)).astype(np.float32)
            yield first, counts @ self.vectors[some].astype(np.float32)


def learn(docs: DataFrame) -> dict[str, np.ndarray]:
    """Prototype of each language of ``docs`` (text, lang). The driver gets one vector a
    language."""

    def task(batches):
        trim()
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            texts, langs = batch.column(0), batch.column(1).to_pylist()
            for start, stop in slices(texts, SLICE):
                own = langs[start:stop]
                names = sorted(set(own))
                number = {x: i for i, x in enumerate(names)}
                group = np.array([number[x] for x in own])
                found = Grams(texts.slice(start, stop - start)).bundled(group, len(names))
                for name, vector in zip(names, found.astype(np.float64)):
                    sums[name] = sums[name] + vector if name in sums else vector
        if sums:
            part = TaskContext.get().partitionId()
            yield pa.RecordBatch.from_pydict(
                {
                    "lang": list(sums),
                    "part": [part] * len(sums),
                    "vector": [x.tobytes() for x in sums.values()],
                }
            )

    def added(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        total = sum(np.frombuffer(x, np.float64) for x in rows["vector"])
        return pd.DataFrame({"lang": [key[0]], "vector": [total.tobytes()]})

    source = docs.where("text is not null and lang is not null")
    sums = source.select("text", "lang").mapInArrow(task, "lang string, part long, vector binary")
    near = sums.groupBy("lang", F.floor(F.col("part") / JOINED)).applyInPandas(
        added, "lang string, vector binary"
    )
    made = near.groupBy("lang").applyInPandas(added, "lang string, vector binary").collect()
    return {x.lang: np.frombuffer(bytes(x.vector), np.float64) for x in made}


def identify(docs: DataFrame, prototypes: dict[str, np.ndarray], *keep: str) -> DataFrame:
    """``keep`` columns of ``docs`` with lang_pred and score (cosine, 0 at least)."""
    names = sorted(prototypes)
    unit = np.zeros((len(names), DIMENSIONS))
    if names:
        unit = np.stack([prototypes[x] for x in names])
        unit /= np.maximum(np.linalg.norm(unit, axis=1, keepdims=True), 1e-12)
    unit = np.ascontiguousarray(unit.T, np.float32)

    source, place = with_text(docs, keep)

    def task(batches):
        trim()
        for batch in batches:
            texts = batch.column(place)
            for start, stop in slices(texts, SLICE):
                lang, score = ["und"] * (stop - start), np.zeros(stop - start)
                if names:
                    grams = Grams(texts.slice(start, stop - start))
                    for first, vectors in grams.documents():
                        norm = np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-12)
                        cosine = vectors @ unit / norm
                        best = cosine.argmax(axis=1)
                        value = cosine.max(axis=1)
                        for i in np.flatnonzero(grams.letters[first : first + len(best)]).tolist():
                            lang[first + i] = names[best[i]]
                            score[first + i] = min(max(float(value[i]), 0.0), 1.0)
                own = batch.slice(start, stop - start).columns[: len(keep)]
                yield pa.RecordBatch.from_arrays(
                    [*own, pa.array(lang, pa.string()), pa.array(score)],
                    [*keep, "lang_pred", "score"],
                )

    schema = docs.select(*keep).schema.add("lang_pred", "string").add("score", "double")
    return source.mapInArrow(task, schema)


def predict(docs: DataFrame, training: Column) -> DataFrame:
    """doc_id, training (as given by the condition), lang_pred, score for every row, learned
    from the rows of the condition."""
    prototypes = learn(docs.where(training))
    return identify(docs.withColumn("_training", training), prototypes, "doc_id", "_training")
