"""Harmonic packing of token sequences.

A document's ids are cut into full sequences and a rest. The rest is cut into lengths that
are a whole part of the capacity, floor(capacity / k), longest first, using only k that leave
no more than ``SLACK`` ids unused: each length is a reciprocal-capacity class, and a bin of
class k holds exactly k pieces. Every partition fills the bins of each class on its own, in one
pass, holding only the open bins. What open bins hold at the end (fewer than k pieces a class)
is filled the same way for ``JOINED`` partitions together, and the last open bins of those are
packed first-fit by decreasing length across classes; both groups have a fixed bound.

Defined results: null and empty texts are the end id alone; repeated rows are packed each;
an empty table gives no row; other columns are ignored; a null doc_id stays null.
"""

from __future__ import annotations

import zlib
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitalshare.llm.common import trim
from vitalshare.llm.word_tokens import ENCODERS, encoded
from vitalshare.sources.writers import stage_table

CAPACITY = 2048
SLACK = 8
JOINED = 64

COLUMNS = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, "
    "offset long"
)
OPEN = COLUMNS + ", part long"


@lru_cache(maxsize=None)
def classes(capacity: int) -> tuple[int, ...]:
    """Lengths of the classes, longest first; 1 is always among them."""
    lengths = {capacity // k for k in range(1, capacity + 1) if capacity % k <= SLACK}
    return tuple(sorted(lengths | {1}, reverse=True))


@lru_cache(maxsize=None)
def cut(length: int, capacity: int) -> tuple[int, ...]:
    """Class lengths that add up to ``length``, longest first."""
    pieces = []
    for x in classes(capacity):
        while length >= x:
            pieces.append(x)
            length -= x
    return tuple(pieces)


class Bins:
    """Open bins by piece length; ``add`` gives a bin's pieces once it is full."""

    def __init__(self, capacity: int, first: int):
        self.capacity, self.next = capacity, first
        self.open: dict[int, list] = {}

    def add(self, length: int, piece):
        bin_ = self.open.setdefault(length, [])
        bin_.append(piece)
        if len(bin_) < self.capacity // length:
            return None
        del self.open[length]
        self.next += 1
        return self.next - 1, bin_


def pack(
    docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = 1, ids: bool = False
) -> DataFrame:
    """Pieces of every document and their place: ``COLUMNS``, with ``ids`` also the ids.

    ``docs`` has doc_id and text. sequence_id is unique, not gapless; offset is gapless from 0.
    """
    extra = ", ids array<int>" if ids else ""
    source = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    placed = stage_table(
        source.mapInArrow(
            lambda batches: _fill(batches, tokenizer, capacity, end_id, ids), OPEN + extra
        ),
        "pieces",
    )
    first = placed.where("sequence_id is not null").drop("part")
    rest = (
        placed.where("sequence_id is null")
        .groupBy(F.floor(F.col("part") / JOINED).alias("joined"))
        .applyInPandas(lambda key, x: _join(key[0], x, capacity), placed.drop("part").schema)
    )
    return first.unionByName(rest)


def _fill(batches, tokenizer: str, capacity: int, end_id: int, with_ids: bool):
    trim(ENCODERS)
    part = TaskContext.get().partitionId()
    bins = Bins(capacity, part << 32)
    names = [x.split()[0] for x in OPEN.split(",")] + ["ids"] * with_ids

    def rows(found):
        columns = [pa.array(x, pa.int64()) for x in zip(*(x[:8] for x in found))]
        if with_ids:
            columns.append(pa.array([x[8] for x in found], pa.list_(pa.int32())))
        return pa.RecordBatch.from_arrays(columns, names)

    for doc_ids, texts in encoded(batches, tokenizer, end_id):
        out = []
        for doc, ids in zip(doc_ids.to_pylist(), texts):
            n, at = len(ids), 0
            lengths = (capacity,) * (n // capacity) + cut(n % capacity, capacity)
            for length in lengths:
                own = ids[at : at + length]
                piece = (doc, at, length, zlib.crc32(own), n, own.view(np.int32) if with_ids else None)
                at += length
                if full := bins.add(length, piece):
                    out += _placed(*full, part)
        if out:
            yield rows(out)
    left = [x for bin_ in bins.open.values() for x in bin_]
    if left:
        yield rows([(*x[:5], None, None, part, x[5]) for x in left])


def _placed(sequence: int, bin_: list, part):
    offset = 0
    for piece in bin_:
        yield (*piece[:5], sequence, offset, part, piece[5])
        offset += piece[2]


def _join(joined: int, left: pd.DataFrame, capacity: int) -> pd.DataFrame:
    """Pack what ``JOINED`` partitions left over."""
    left = left.sort_values(["length", "part", "doc_id", "start"], ascending=[False, True, True, True])
    left = left.drop(columns="part").reset_index(drop=True)
    bins = Bins(capacity, ((1 << 30) + int(joined)) << 32)
    sequence = np.zeros(len(left), np.int64)
    offset = np.zeros(len(left), np.int64)
    lengths = left["length"].to_numpy()
    for row, length in enumerate(lengths):
        if full := bins.add(int(length), row):
            for slot, r in enumerate(full[1]):
                sequence[r], offset[r] = full[0], slot * length
    used: list[int] = []
    for length in sorted(bins.open, reverse=True):
        for row in bins.open[length]:
            at = next((i for i, x in enumerate(used) if x + length <= capacity), len(used))
            if at == len(used):
                used.append(0)
            sequence[row], offset[row] = bins.next + at, used[at]
            used[at] += length
    return left.assign(sequence_id=sequence, offset=offset)
