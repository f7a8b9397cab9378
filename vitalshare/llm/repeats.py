"""Removal of long repeated byte strings by distributed prefix doubling.

A byte goes if a string of ``length`` bytes that covers it starts anywhere else too. The work is
that of a suffix array by prefix doubling, on the positions that can decide it:

*Anchors.* Of every ``window`` successive positions the one whose few bytes have the smallest
hash is an anchor. A string of ``length`` bytes holds whole windows, and these are the same
wherever it starts, so it has the same anchors at the same offsets everywhere.

*Doubling.* An anchor's first rank stands for its next ``name`` bytes. Spark deals and sorts the
(rank, position) rows by rank, and anchors whose rank is unique go. An anchor's next rank is the
pair of its own and that of the anchor 1, 2, 4, ... anchors on, ranked the same way, until it is
unique or the pair reaches past what strings beginning at the anchor's positions are sure to
hold (or few anchors can be ranked any further). Such an anchor stays, and goes on to show its ranks to others as long as they come again.
Whole copies of a text are one text.

*Borders.* What is left is repeated almost everywhere. The positions before an anchor are taken
in pieces: all are repeated if the bytes from the first position to the last one's end come
again, none is if the bytes they share do not. Only pieces in between, where a repetition begins
or ends, are ranked position by position (128-bit hashes of the whole strings), against one
example of every other string with the same shared bytes.

A rank is sent once from a slice of texts that holds it often, so a passage in a third of all
documents gives a row a slice, and joins back to rows are ordinary equi-joins.

Defined results: null and empty texts have no bytes and remain; repeated rows are copies of
each other; texts under ``length`` bytes stay whole; an empty table gives no row; a null doc_id
stays null; other columns are ignored. Texts are handled whole, at some 80 bytes of memory a
byte for the longest.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vitalshare.llm.common import clustered, mix, slices, spread
from vitalshare.sources.writers import discard, stage_table

SLICE = 1 << 20
WORTH = 1 / 8
GOLDEN = np.uint64(0x9E3779B97F4A7C15)
BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
VALUES = [mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(b)) for b in BASES]

#: What a row says of its rank: it is known to come again, it asks, it tells of a second one
#: in its slice (and is known itself), it is an example that needs no answer, or it has none.
KNOWN, ASKS, TELLS, EXAMPLE, NONE = 0, 1, 2, -1, -2


@dataclass(frozen=True)
class Plan:
    """Sizes in bytes."""

    length: int

    @property
    def gram(self) -> int:
        return max(1, min(8, self.length // 8))

    @property
    def window(self) -> int:
        return max(1, self.length * 8 // 25)

    @property
    def name(self) -> int:
        return max(1, self.length * 4 // 25)

    @property
    def piece(self) -> int:
        return max(1, self.length * 2 // 25)

    @property
    def sure(self) -> int:
        """From a string's start, its anchors up to here lie in windows it holds whole."""
        return self.length + 1 - self.gram - self.window


@lru_cache(maxsize=4)
def _powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    out = []
    for x in (base, pow(base, -1, 1 << 64)):
        power = np.full(n, x, np.uint64)
        power[0] = 1
        out.append(np.cumprod(power))
    return out[0], out[1]


class Hashes:
    """64-bit hashes of any range of ``data``, by which of two bases."""

    def __init__(self, data: np.ndarray, which: int):
        forth, self.back = _powers(BASES[which], 1 << max(1, len(data)).bit_length())
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(VALUES[which][data] * forth[: len(data)], out=self.sums[1:])

    def of(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        return mix((self.sums[stop] - self.sums[start]) * self.back[start])


def _bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(all bytes, each text's first place and one end)."""
    texts = texts.cast(pa.large_string())
    ends = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    chars = np.frombuffer(data, np.uint8)[ends[0] : ends[-1]] if data else np.empty(0, np.uint8)
    return chars, ends - ends[0]


def told(keys: np.ndarray, ask: np.ndarray | None = None) -> np.ndarray:
    """Which of the rows of a slice ask and tell; ``keys`` has a row for each, 1 or 2 columns."""
    out = np.full(len(keys), ASKS, np.int8) if ask is None else ask.astype(np.int8)
    order = np.lexsort(keys.T)
    fresh = np.ones(len(keys), bool)
    fresh[1:] = (keys[order[1:]] != keys[order[:-1]]).any(axis=1)
    begin = np.flatnonzero(fresh)
    many = np.diff(np.append(begin, len(keys))) > 1
    out[order[np.repeat(many, np.diff(np.append(begin, len(keys))))]] = KNOWN
    out[order[begin[many]]] = TELLS
    return out


def _lists(row: np.ndarray, n: int, **columns) -> list[pa.Array]:
    """List columns of ``n`` rows from values in order of ``row``."""
    at = pa.array(np.searchsorted(row, np.arange(n + 1)).astype(np.int32))
    return [pa.ListArray.from_arrays(at, pa.array(x)) for x in columns.values()]


def _rows(column: pa.Array) -> np.ndarray:
    return np.repeat(np.arange(len(column)), pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False))


def anchors(data: np.ndarray, begin: np.ndarray, plan: Plan):
    """(text, place, first window, number of windows, reach) of the anchors of the texts;
    ``reach`` counts the anchors, itself included, that its strings are sure to share."""
    n, gram, window = len(data), plan.gram, plan.window
    value = np.zeros(max(0, n - gram + 1), np.uint64)
    for i in range(gram):
        value = value * np.uint64(BASES[0]) + data[i : n - gram + 1 + i] + np.uint64(1)
    value = (mix(value) >> np.uint64(32) << np.uint64(32)) | np.arange(len(value), dtype=np.uint64)
    size = 1
    while size < window:
        step = min(size, window - size)
        value = np.minimum(value[: len(value) - step], value[step:])
        size += step
    counts = np.maximum(np.diff(begin) - (window + gram - 2), 0)
    windows = spread(begin[:-1], counts)
    least = (value[windows] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    text = np.repeat(np.arange(len(counts)), counts)
    fresh = np.ones(len(least), bool)
    fresh[1:] = least[1:] != least[:-1]
    first = np.flatnonzero(fresh)
    at, low, text = least[first], windows[first], text[first]
    many = np.diff(np.append(first, len(least)))
    last = np.minimum(
        np.searchsorted(at, low + plan.sure, side="right"), np.searchsorted(text, text, side="right")
    )
    return text, at, low, many, last - np.arange(len(at))


#: Anchors of a text, packed: ``place`` is where (upper half) and the anchor's number in the text,
#: of which a text may have one a byte; ``windows`` is the distance to the first (24 bits), their
#: number (24) and the reach (16). With their rank and what they say of it.
_STATE = "u long, v long, place array<long>, windows array<long>, name array<long>, ask array<byte>"
_NAMES = [x.split()[0] for x in _STATE.split(", ")]
_LOW = np.int64(0xFFFFFFFF)
_MANY = np.int64(0xFFFFFF)
_REACH = 0xFFFF


def _state(keys, row, place, windows, name, ask) -> pa.RecordBatch:
    columns = _lists(
        row, len(keys[0]), place=place, windows=windows, name=name.view(np.int64), ask=ask.astype(np.int8)
    )
    return pa.RecordBatch.from_arrays([*keys, *columns], _NAMES)


def _first_ranks(batches, plan: Plan):
    for batch in batches:
        for a, b in slices(batch.column(2), SLICE):
            part = batch.slice(a, b - a)
            data, begin = _bytes(part.column(2))
            text, at, low, many, reach = anchors(data, begin, plan)
            stop = np.minimum(at + plan.name, begin[text + 1])
            name = Hashes(data, 0).of(at, stop) ^ (stop - at).astype(np.uint64)
            number = np.arange(len(at)) - np.searchsorted(text, text)
            place = at - begin[text] << 32 | number
            windows = at - low << 40 | many << 16 | np.minimum(reach, _REACH)
            yield _state(part.columns[:2], text, place, windows, name, told(name[:, None]))


def _next_ranks(batches, span: int):
    """The anchors left after ranks of ``span`` anchors each, ranked by twice as many."""
    for batch in batches:
        row, kept = _rows(batch.column(2)), batch.column(2).flatten()
        place, windows, name = (kept.field(x).to_numpy() for x in ("place", "windows", "name"))
        ranked = kept.field("ranked").to_numpy(zero_copy_only=False)
        order = np.lexsort((place, row))
        row, place, windows, name, ranked = (x[order] for x in (row, place, windows, name.view(np.uint64), ranked))
        key = (row << 32) + (place & _LOW)
        later = np.minimum(np.searchsorted(key, key + span), len(key) - 1)
        held = ranked & (key[later] == key + span) & ranked[later]
        name = mix(name * GOLDEN ^ mix(name[later] + GOLDEN))
        keep = held | (windows & _REACH < 2 * span)
        row, place, windows, name, held = (x[keep] for x in (row, place, windows, name, held))
        ask = np.full(len(row), NONE, np.int8)
        ask[held] = told(name[held][:, None])
        yield _state(batch.columns[:2], row, place, windows, name, ask)


def _surviving(state: DataFrame, span: int) -> DataFrame:
    """Sorts the (rank, position) rows by rank; what is left of each text: u, v, kept."""
    rows = state.select("u", "v", F.inline(F.arrays_zip("place", "windows", "name", "ask")))
    asked = rows.where("ask > 0").repartition("name")
    counted = asked.withColumn("n", F.sum("ask").over(Window.partitionBy("name"))).where(f"ask = {ASKS}")
    answered = counted.withColumn("ranked", F.col("n") > 1)
    # a unique rank that reaches past what the anchor's strings are sure to hold says nothing
    answered = answered.where(f"ranked OR windows & {_REACH} < {span}").drop("n")
    others = rows.where(f"ask <> {ASKS}").withColumn("ranked", F.col("ask") != NONE)
    # as many rows as the text has anchors
    return (
        answered.unionByName(others)
        .groupBy("u", "v")
        .agg(F.collect_list(F.struct("place", "windows", "name", "ranked")).alias("kept"))
    )


def _deleted(stored: DataFrame) -> None:
    """Deletes the files of a stored table that nothing reads any more."""
    files = stored.inputFiles()
    if files:
        discard(stored.sparkSession, files[0].rsplit("/", 1)[0])


def candidates(texts: DataFrame, plan: Plan) -> tuple[DataFrame, DataFrame]:
    """u, v and the anchors (kept) of (u, v, text) that outlast the doubling, and the stored
    table they are read from. It only saves work below, so it ends once fewer than ``WORTH`` of
    the anchors have further ranks."""
    state = stage_table(texts.mapInArrow(lambda b: _first_ranks(b, plan), _STATE), "ranks")
    span = 1
    while True:
        left, far = state.agg(
            F.sum(F.size("place")),
            F.sum(F.size(F.filter("windows", lambda x: x.bitwiseAND(_REACH) >= 2 * span))),
        ).first()
        if (far or 0) <= WORTH * (left or 0):
            return _surviving(state, span), state
        grown = _surviving(state, span).mapInArrow(lambda b, n=span: _next_ranks(b, n), _STATE)
        before, state = state, stage_table(grown.where("size(place) > 0"), "ranks")
        _deleted(before)
        span *= 2


_PIECES = "u long, v long, top int, shared long, u1 long, u2 long, ask byte"


def _pieces(batches, plan: Plan):
    """Pieces of the positions before each anchor, with the hashes that decide them."""
    for batch in batches:
        for a, b in slices(batch.column(2), SLICE):
            part = batch.slice(a, b - a)
            data, begin = _bytes(part.column(2))
            row, kept = _rows(part.column(3)), part.column(3).flatten()
            place, windows = (kept.field(x).to_numpy() for x in ("place", "windows"))
            at, many = place >> 32, windows >> 16 & _MANY
            low = at - (windows >> 40)
            high = np.minimum(low + many - 1, np.diff(begin)[row] - plan.length)
            row, at, low, high = (x[high >= low] for x in (row, at, low, high))
            first = (at - high) // plan.piece
            count = (at - low) // plan.piece - first + 1
            top = np.repeat(at, count) - plan.piece * spread(first, count)
            key = np.unique((np.repeat(row, count) << 32) + top)
            row, top = key >> 32, key & _LOW
            own, end = begin[row], begin[row + 1]
            bottom = top - plan.piece + 1
            one, two = Hashes(data, 0), Hashes(data, 1)
            shared = one.of(own + top, own + bottom + plan.length)
            whole = (bottom >= 0) & (own + top + plan.length <= end)
            start = np.where(whole, own + bottom, 0)
            stop = np.where(whole, own + top + plan.length, 0)
            u, v = (part.column(i).to_numpy()[row] for i in (0, 1))
            # a piece that sticks out of its text has no such string: a name of its own
            alone = mix(u.view(np.uint64) * GOLDEN + top.astype(np.uint64))
            u1 = np.where(whole, one.of(start, stop), alone)
            u2 = np.where(whole, two.of(start, stop), v.view(np.uint64))
            ask = told(np.stack([u1, u2], axis=1))
            yield pa.RecordBatch.from_arrays(
                [
                    *(pa.array(x) for x in (u, v, top.astype(np.int32))),
                    *(pa.array(x.view(np.int64)) for x in (shared, u1, u2)),
                    pa.array(ask),
                ],
                [x.split()[0] for x in _PIECES.split(", ")],
            )


_PLACES = "u long, v long, at int, h1 long, h2 long, ask byte"


def _places(batches, plan: Plan):
    """The positions of open pieces with the hashes of their strings."""
    for batch in batches:
        for a, b in slices(batch.column(2), SLICE):
            part = batch.slice(a, b - a)
            data, begin = _bytes(part.column(2))
            row, tops = _rows(part.column(3)), part.column(3).flatten()
            top = tops.field("top").to_numpy().astype(np.int64)
            asks = tops.field("single").to_numpy(zero_copy_only=False).astype(np.int64)
            bottom = np.maximum(top - plan.piece + 1, 0)
            top = np.minimum(top, np.diff(begin)[row] - plan.length)
            count = np.maximum(top - bottom + 1, 0)
            key = (np.repeat(row, count) << 32) + spread(bottom, count)
            order = np.lexsort((-np.repeat(asks, count), key))
            key, asks = key[order], np.repeat(asks, count)[order]
            fresh = np.ones(len(key), bool)
            fresh[1:] = key[1:] != key[:-1]
            key, asks = key[fresh], asks[fresh]
            row, at = key >> 32, key & _LOW
            start = begin[row] + at
            hashes = [Hashes(data, i).of(start, start + plan.length) for i in (0, 1)]
            ask = told(np.stack(hashes, axis=1), np.where(asks > 0, ASKS, EXAMPLE))
            yield pa.RecordBatch.from_arrays(
                [
                    *(pa.array(part.column(i).to_numpy()[row]) for i in (0, 1)),
                    pa.array(at.astype(np.int32)),
                    *(pa.array(x.view(np.int64)) for x in hashes),
                    pa.array(ask),
                ],
                [x.split()[0] for x in _PLACES.split(", ")],
            )


def repeated_positions(texts: DataFrame, plan: Plan) -> DataFrame:
    """u, v, first, last: ranges of positions of (u, v, text) whose strings start elsewhere
    too. ``texts`` should be clustered by u, v."""
    key = ["u", "v"]
    left, ranks = candidates(texts, plan)
    pieces = texts.join(left, key).select(*key, "text", "kept")
    pieces = stage_table(pieces.mapInArrow(lambda b: _pieces(b, plan), _PIECES), "pieces")
    _deleted(ranks)
    strings = ["shared", "u1", "u2"]
    kinds = pieces.where("ask > 0").groupBy(*strings).agg(
        F.sum("ask").alias("n"), F.min(F.struct(*key, "top")).alias("one")
    )
    kinds = stage_table(kinds, "strings")
    single = F.col("n") == 1
    mixed = kinds.groupBy("shared").agg(F.count("*").alias("kinds"), F.count(F.when(single, 1)).alias("alone"))
    open_ = kinds.join(mixed.where("kinds > 1 AND alone > 0").select("shared"), "shared")
    open_ = open_.groupBy("one.u", "one.v").agg(
        F.collect_list(F.struct("one.top", single.alias("single"))).alias("tops")
    )
    places = texts.join(open_, key).select(*key, "text", "tops")
    places = stage_table(places.mapInArrow(lambda b: _places(b, plan), _PLACES), "places")
    # a string is sent once from a slice that holds it often, so a group has a row a slice
    dealt = places.where(f"ask <> {KNOWN}").repartition("h1", "h2")
    counted = dealt.withColumn("n", F.sum(F.abs("ask")).over(Window.partitionBy("h1", "h2")))
    known = F.col("ask").isin(KNOWN, TELLS)
    at = [*key, F.col("at").alias("first"), F.col("at").alias("last")]
    top = [*key, (F.col("top") - plan.piece + 1).alias("first"), F.col("top").alias("last")]
    again = pieces.where(f"ask = {ASKS}").join(kinds.where("n > 1").select(*strings), strings)
    parts = [
        places.where(known).select(*at),
        counted.where(f"ask = {ASKS} AND n > 1").select(*at),
        pieces.where(known).select(*top),
        again.select(*top),
    ]
    return reduce(DataFrame.unionByName, parts)


def covered(first: np.ndarray, last: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs (start, stop) of the bytes that strings at the positions cover."""
    order = np.argsort(first, kind="stable")
    first, stop = first[order], np.maximum.accumulate(last[order] + length)
    fresh = np.ones(len(first), bool)
    fresh[1:] = first[1:] > stop[:-1]
    begin = np.flatnonzero(fresh)
    return first[begin], stop[np.append(begin[1:], len(first)) - 1] if len(first) else stop


_CUT = "u long, v long, n_removed long, n_spans long, kept_sha256 string"


def _cut(batches, length: int, texts: bool):
    """Texts without the bytes covered."""
    for batch in batches:
        for a, b in slices(batch.column(2), SLICE):
            part = batch.slice(a, b - a)
            data = part.column(2).cast(pa.binary()).to_pylist()
            begin = np.searchsorted(_rows(part.column(3)), np.arange(len(data) + 1))
            first, last = (part.column(3).flatten().field(x).to_numpy().astype(np.int64) for x in ("first", "last"))
            rows = []
            for i, text in enumerate(data):
                start, stop = covered(first[begin[i] : begin[i + 1]], last[begin[i] : begin[i + 1]], length)
                left = b"".join(text[x:y] for x, y in zip([0, *stop.tolist()], [*start.tolist(), len(text)]))
                rows.append((len(text) - len(left), len(start), hashlib.sha256(left).hexdigest(), left))
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.binary())[: 3 + texts]
            names = [x.split()[0] for x in _CUT.split(", ")] + ["kept"] * texts
            columns = [pa.array(x, kind) for x, kind in zip(zip(*rows), kinds)]
            yield pa.RecordBatch.from_arrays([*part.columns[:2], *columns], names)


def remove(docs: DataFrame, length: int = 400, texts: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans (maximal removed runs), kept_sha256 for every row of
    (doc_id, text); with ``texts`` also ``kept``, the remaining bytes."""
    plan, key = Plan(length), ["u", "v"]
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    source = source.withColumn("sha", F.sha2("text", 256)).select(
        "*",
        # 124 bits of the hash name a text
        F.conv(F.substring("sha", 1, 15), 16, 10).cast("long").alias("u"),
        F.conv(F.substring("sha", 17, 15), 16, 10).cast("long").alias("v"),
        F.octet_length("text").cast("long").alias("n_bytes"),
    )
    contents = source.where(F.col("n_bytes") >= length).groupBy(*key)
    contents = clustered(contents.agg(F.first("text").alias("text"), F.count("*").alias("copies")), key)
    ranges = repeated_positions(contents.select(*key, "text"), plan)
    # the ranges of one text come from its own pieces, so they are no more than its bytes
    ranges = ranges.groupBy(*key).agg(F.collect_list(F.struct("first", "last")).alias("ranges"))
    single = contents.where("copies = 1").join(ranges, key).select(*key, "text", "ranges")
    schema = _CUT + (", kept binary" if texts else "")
    cut = single.mapInArrow(lambda b: _cut(b, length, texts), schema)
    copied = contents.where("copies > 1").select(
        *key,
        F.octet_length("text").cast("long").alias("n_removed"),
        F.lit(1).cast("long").alias("n_spans"),
        F.sha2(F.lit(""), 256).alias("kept_sha256"),
        *([F.lit(b"").alias("kept")] if texts else []),
    )
    found = stage_table(cut.unionByName(copied), "cut")
    return source.join(found, key, "left").select(
        "doc_id",
        "n_bytes",
        F.coalesce("n_removed", F.lit(0)).alias("n_removed"),
        F.coalesce("n_spans", F.lit(0)).alias("n_spans"),
        F.coalesce("kept_sha256", "sha").alias("kept_sha256"),
        *([F.coalesce("kept", F.col("text").cast("binary")).alias("kept")] if texts else []),
    )
