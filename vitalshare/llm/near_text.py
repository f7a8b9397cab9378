"""Near-duplicate texts: BagMinHash signatures, bands, verified multiset overlap.

A text is the multiset of its five-word shingles (lower case; a shorter text is one shingle),
and two texts link at a weighted Jaccard similarity of 0.8.

*Signature.* Weights are discretised into unit cells, and the cells 2^j to 2^(j+1) - 1 of a
shingle form one level of a hierarchy. Each level has a Poisson process of its own, seeded by
the shingle and the level, whose points carry a time, a register and a cell; a text takes the
points in cells its weight reaches. A register keeps the earliest time, and a process is
followed only while it can still change some register. Two texts agree in a register with
exactly their weighted Jaccard similarity.

*Candidates.* Texts with equal multisets are one representative. Registers are hashed in
``BANDS`` bands of ``ROWS``; a pair at 0.8 shares no bucket with a chance of 5e-5. Members of
a bucket are compared with its centre, then those outside the centre's component (strays) with
the most connected stray: both times as many pairs as members. Strays that remain are compared
with all members of other components in blocks of up to ``BLOCK`` texts and about
``BLOCK_WORDS`` words a side (a longer text is alone), first by signature, then by text; a block gives links, never pairs. So every two members of a bucket are linked,
in one component, or found to differ.

*Verification.* Pairs whose signatures agree far below the threshold (7 standard deviations)
are left; all others are decided by the overlap of their whole shingle multisets.

Defined results: texts that are null or have no word are classes of their own; repeated rows
are copies of each other; of a class the row with the smallest doc_id (null first) is kept; an
empty table gives no row; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitalshare.llm.common import mix, ranges, slices, spread, trim
from vitalshare.llm.components import stars
from vitalshare.sources.writers import stage_table

WORDS = 5
THRESHOLD = 0.8
BANDS, ROWS = 25, 5
REGISTERS = BANDS * ROWS
DOUBTFUL = 7.0  # standard deviations
BLOCK = 256  # texts
BLOCK_WORDS = 1 << 18  # shingles, about 1.6 MB of text
COLUMNS = 4096
SLICE = 2 << 20

GOLDEN = np.uint64(0x9E3779B97F4A7C15)
OTHER = np.uint64(0xD6E8FEB86659FD93)


def shingles(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, hash, count) of the distinct shingles in order, and each text's total."""
    lists = pc.utf8_split_whitespace(pc.utf8_lower(pc.fill_null(texts, "")))
    coded = lists.values.dictionary_encode()
    names = coded.dictionary.to_numpy(zero_copy_only=False)
    codes = coded.indices.to_numpy()
    hashes = pd.util.hash_array(names.astype(object), categorize=False).astype(np.uint64)
    real = np.array([bool(x) for x in names], bool)[codes] if len(codes) else np.empty(0, bool)
    ends = np.concatenate([[0], np.cumsum(real)])
    words = hashes[codes][real] if len(codes) else np.empty(0, np.uint64)
    offsets = ends[lists.offsets.to_numpy()]
    n = np.diff(offsets)
    room = np.where((n > 0) & (n < WORDS), WORDS, n)
    starts = np.cumsum(room) - room
    padded = np.full(int(room.sum()), OTHER)
    padded[spread(starts, n)] = words
    total = np.maximum(room - WORDS + 1, 0)
    at = spread(starts, total)
    value = np.zeros(len(at), np.uint64)
    for i in range(WORDS):
        value = mix(value * GOLDEN + padded[at + i])
    text = np.repeat(np.arange(len(n)), total)
    order = np.lexsort((value, text))
    text, value = text[order], value[order]
    first = np.ones(len(text), bool)
    first[1:] = (text[1:] != text[:-1]) | (value[1:] != value[:-1])
    begin = np.flatnonzero(first)
    return text[begin], value[begin], np.diff(np.append(begin, len(text))), total


def registers(text: np.ndarray, value: np.ndarray, count: np.ndarray, n: int) -> np.ndarray:
    """The signatures of ``n`` texts, one row each; infinite without shingles."""
    levels = np.floor(np.log2(count)).astype(np.int64) + 1 if len(count) else count
    element = np.repeat(np.arange(len(text)), levels)
    level = spread(np.zeros(len(text), np.int64), levels)
    seed = mix(value[element] ^ mix((level + 1).astype(np.uint64) * GOLDEN))
    width = np.left_shift(1, level)
    reach, owner = count[element], text[element]
    time = np.zeros(len(element))
    found = np.full(n * REGISTERS, np.inf)
    latest = np.full(n, np.inf)
    step = np.zeros(1, np.uint64)
    while len(element):
        step += GOLDEN
        random = mix(seed + step)
        gap = -np.log(((random >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53)
        time = time + gap / (REGISTERS * width)
        alive = time < latest[owner]
        if not alive.all():
            seed, width, reach, owner, time, random, element = (
                x[alive] for x in (seed, width, reach, owner, time, random, element)
            )
        other = mix(random ^ OTHER)
        register = ((other >> np.uint64(32)) * np.uint64(REGISTERS) >> np.uint64(32)).astype(np.int64)
        low = (other & np.uint64(0xFFFFFFFF)).astype(np.int64)
        cell = width + (low * width >> 32)
        hit = cell <= reach
        np.minimum.at(found, owner[hit] * REGISTERS + register[hit], time[hit])
        some = np.unique(owner)
        latest[some] = found.reshape(n, REGISTERS)[some].max(axis=1)
    return found.reshape(n, REGISTERS)


def banded(found: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Band hashes and the one-byte sketch of each register."""
    bits = mix(found.view(np.uint64))
    parts = bits.reshape(len(found), BANDS, ROWS)
    value = np.arange(1, BANDS + 1, dtype=np.uint64)[None, :] * OTHER
    value = np.repeat(value, len(found), axis=0)
    for i in range(ROWS):
        value = mix(value * GOLDEN + parts[:, :, i])
    return value.view(np.int64), (bits & np.uint64(255)).astype(np.uint8)


def similarity(left: pa.Array, right: pa.Array) -> np.ndarray:
    """Weighted Jaccard similarity of the texts of two arrays, row by row."""
    names = left.dictionary_encode()
    n = len(left)
    lt, lv, lc, ln = shingles(names.dictionary)
    rt, rv, rc, rn = shingles(right)
    own = names.indices.to_numpy()
    begin = np.searchsorted(lt, np.arange(len(names.dictionary) + 1))
    sizes = np.diff(begin)[own]
    at = spread(begin[:-1][own], sizes)
    row = np.concatenate([np.repeat(np.arange(n), sizes), rt])
    value = np.concatenate([lv[at], rv])
    count = np.concatenate([lc[at], rc])
    order = np.lexsort((value, row))
    row, value, count = row[order], value[order], count[order]
    same = np.flatnonzero((row[1:] == row[:-1]) & (value[1:] == value[:-1]))
    both = np.bincount(row[same], np.minimum(count[same], count[same + 1]), n)
    return both / np.maximum(ln[own] + rn - both, 1)


_SIGNED = (
    "uid long, doc_id long, mark long, k1 long, k2 long, total long, bands array<long>, sketch binary, text string"
)


def _sign(batches):
    trim()
    uid = TaskContext.get().partitionId() << 33
    for batch in batches:
        texts = batch.column(2)
        for start, stop in slices(texts, SLICE):
            n = stop - start
            text, value, count, total = shingles(texts.slice(start, n))
            bands, sketch = banded(registers(text, value, count, n))
            keys = []
            for salt in (GOLDEN, OTHER):
                # order-free sums over the multiset
                own = mix(value ^ salt) * count.astype(np.uint64)
                sums = np.concatenate([[np.uint64(0)], np.cumsum(own, dtype=np.uint64)])
                edge = np.searchsorted(text, np.arange(n + 1))
                keys.append((sums[edge[1:]] - sums[edge[:-1]]).view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.arange(uid, uid + n)),
                    *batch.slice(start, n).columns[:2],
                    pa.array(keys[0]),
                    pa.array(keys[1]),
                    pa.array(total.astype(np.int64)),
                    pa.FixedSizeListArray.from_arrays(pa.array(bands.ravel()), BANDS).cast(pa.list_(pa.int64())),
                    pa.FixedSizeBinaryArray.from_buffers(
                        pa.binary(REGISTERS), n, [None, pa.py_buffer(sketch.tobytes())]
                    ).cast(pa.binary()),
                    texts.slice(start, n),
                ],
                [x.split()[0] for x in _SIGNED.split(", ")],
            )
            uid += n


def least_agreement() -> float:
    """Share of equal sketch bytes below which a pair is ruled out."""
    return THRESHOLD - DOUBTFUL * (THRESHOLD * (1 - THRESHOLD) / REGISTERS) ** 0.5


def sketches(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, REGISTERS)


def _likely(batches):
    """Pairs whose sketches do not rule the threshold out."""
    for batch in batches:
        if batch.num_rows:
            good = (sketches(batch.column(2)) == sketches(batch.column(3))).mean(axis=1)
            good = pa.array(good >= least_agreement())
            yield pa.RecordBatch.from_arrays([batch.column(i).filter(good) for i in (0, 1)], ["a", "b"])


def _verified(batches):
    trim()
    for batch in batches:
        size = sum(pc.binary_length(batch.column(i)).to_numpy(zero_copy_only=False) for i in (2, 3))
        for start, stop in ranges(size, SLICE):
            part = batch.slice(start, stop - start)
            yield pa.RecordBatch.from_arrays(
                [part.column(0), part.column(1), pa.array(similarity(part.column(2), part.column(3)))],
                ["a", "b", "j"],
            )


class _Pairs:
    """Checks pairs (a, b) of representatives."""

    def __init__(self, signed: DataFrame):
        self.sketch, self.text = signed.select("uid", "sketch"), signed.select("uid", "text")

    def check(self, pairs: DataFrame) -> DataFrame:
        """Links among the pairs (a, b), stored."""
        likely = (
            pairs.join(self.sketch.toDF("a", "left"), "a")
            .join(self.sketch.toDF("b", "right"), "b")
            .select("a", "b", "left", "right")
            .mapInArrow(_likely, "a long, b long")
        )
        verified = (
            likely.join(self.text.toDF("b", "right"), "b")
            .join(self.text.toDF("a", "left"), "a")
            .select("a", "b", "left", "right")
            .mapInArrow(_verified, "a long, b long, j double")
        )
        return stage_table(verified.where(F.col("j") >= THRESHOLD).select("a", "b"), "verified")

    def strays(self, open_: DataFrame) -> DataFrame:
        """Links (a, b) between strays and members of other components of their buckets, stored."""
        key = ["key", "i", "j"]
        deal = lambda x: x.repartition(*key).sortWithinPartitions(*key, "side", "uid")
        schema = "key long, i long, j long, side int, uid long, root long"
        near = deal(
            _blocks(open_).join(self.sketch, "uid").select(*key, "side", "uid", "root", "sketch")
        ).mapInArrow(_near_blocks, schema)
        found = deal(
            near.join(self.text, "uid").select(*key, "side", "uid", "root", "text")
        ).mapInArrow(_link_blocks, "a long, b long")
        return stage_table(found, "found")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, mark (a hash of the text), component_id (smallest doc_id of the class), kept
    (one row a class), for every row of (doc_id, text)."""
    source = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.xxhash64(F.col("text").cast("string")).alias("mark"),
        F.col("text").cast("string").alias("text"),
    )
    signed = stage_table(source.mapInArrow(_sign, _SIGNED), "signatures")
    worded = signed.where("total > 0")
    firsts = worded.groupBy("k1", "k2").agg(F.min("uid").alias("rep"))
    first = F.col("uid") == F.col("rep")
    rows = stage_table(
        worded.select("uid", "doc_id", "mark", "k1", "k2", "total", "bands")
        .join(firsts, ["k1", "k2"])
        .select("uid", "doc_id", "mark", "rep", "total", F.when(first, F.col("bands")).alias("bands")),
        "copies",
    )
    band = rows.where(first).select("uid", "total", F.explode("bands").alias("key"))
    buckets = band.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    members = stage_table(_centred(band.join(buckets, "key")), "members")
    checks = _Pairs(worded)
    star = members.where("uid <> centre").select(F.col("centre").alias("a"), F.col("uid").alias("b")).distinct()
    links = stars(checks.check(star))
    second = checks.check(_second_star(_open(members, links)))
    links = stars(links.unionByName(second))
    found = checks.strays(_open(members, links))
    links = stars(links.unionByName(found))
    joined = rows.join(links.toDF("rep", "root"), "rep", "left").select(
        "uid", "doc_id", "mark", F.coalesce("root", "rep").alias("root")
    )
    chosen = joined.groupBy("root").agg(F.min(F.struct("doc_id", "uid")).alias("first"))
    named = joined.join(chosen, "root").select(
        "doc_id",
        "mark",
        F.col("first.doc_id").alias("component_id"),
        (F.col("uid") == F.col("first.uid")).alias("kept"),
    )
    alone = signed.where("total = 0").select(
        "doc_id", "mark", F.col("doc_id").alias("component_id"), F.lit(True).alias("kept")
    )
    return named.unionByName(alone)


def _centred(band: DataFrame) -> DataFrame:
    """Adds to each bucket's members (key, uid, total, n) the bucket's centre: the member that shares
    buckets with the most others, as the original of a group of edited copies does."""
    rank = band.groupBy("uid").agg(F.sum("n").alias("shared"))
    ranked = band.drop("n").join(rank, "uid")
    centre = F.max(F.struct("shared", (-F.col("uid")).alias("back")))
    centres = ranked.groupBy("key").agg(centre.alias("c")).select("key", (-F.col("c.back")).alias("centre"))
    return ranked.join(centres, "key")


def _open(members: DataFrame, links: DataFrame) -> DataFrame:
    """Members (but the centres) of the buckets with more than one component: key, uid, total,
    shared, root, stray (not in the centre's component). ``links`` are stars."""
    rooted = (
        members.join(links.toDF("uid", "root"), "uid", "left")
        .join(links.toDF("centre", "main"), "centre", "left")
        .withColumn("root", F.coalesce("root", "uid"))
        .withColumn("stray", F.col("root") != F.coalesce("main", "centre"))
    )
    mixed = rooted.where("stray").select("key").distinct()
    return stage_table(
        rooted.where("uid <> centre")
        .join(mixed, "key", "left_semi")
        .select("key", "uid", "total", "shared", "root", "stray"),
        "open",
    )


def _second_star(open_: DataFrame) -> DataFrame:
    """The most connected stray of each bucket with the bucket's other components."""
    best = F.max(F.struct("shared", (-F.col("uid")).alias("back"), "root")).alias("c")
    second = open_.where("stray").groupBy("key").agg(best)
    second = second.select("key", (-F.col("c.back")).alias("a"), F.col("c.root").alias("own"))
    return open_.join(second, "key").where("root <> own").select("a", F.col("uid").alias("b")).distinct()


def _blocks(open_: DataFrame) -> DataFrame:
    """Strays (side 0) and members (side 1) of each bucket dealt to blocks: every stray meets
    every member in one block (key, i, j). ``total`` is a text's number of shingles."""
    blocks = lambda rows, words: F.ceil(
        F.greatest(F.count(rows) / BLOCK, F.sum(words) / BLOCK_WORDS)
    )
    stray = F.when(F.col("stray"), F.col("total"))
    sizes = open_.groupBy("key").agg(
        blocks(F.col("total"), F.col("total")).alias("n"), blocks(stray, stray).alias("m")
    )
    sized = open_.join(sizes.where("m > 0"), "key")
    count = F.col
    place = lambda c: F.pmod(F.xxhash64("uid"), count(c))
    every = lambda c: F.explode(F.sequence(F.lit(0).cast("long"), count(c) - 1))
    strays = sized.where("stray").select(
        "key", place("m").alias("i"), every("n").alias("j"), F.lit(0).alias("side"), "uid", "root"
    )
    others = sized.select(
        "key", every("m").alias("i"), place("n").alias("j"), F.lit(1).alias("side"), "uid", "root"
    )
    return strays.unionByName(others)


def _groups(batches):
    """Runs of rows equal in the first three columns, whole across batches."""
    held = None
    for batch in batches:
        if not batch.num_rows:
            continue
        whole = pa.Table.from_batches([batch])
        if held is not None:
            whole = pa.concat_tables([held, whole])
        whole = whole.combine_chunks()
        keys = np.stack([whole.column(i).to_numpy() for i in range(3)])
        edges = np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1
        start = 0
        for stop in edges.tolist():
            yield whole.slice(start, stop - start)
            start = stop
        held = whole.slice(start)
    if held is not None:
        yield held


def _sides(group: pa.Table):
    """(number of strays, whether stray and member are of different components)."""
    cut = int(np.searchsorted(group.column("side").to_numpy(), 1))
    roots = group.column("root").to_numpy()
    return cut, roots[:cut, None] != roots[None, cut:]


def _near_blocks(batches):
    """Rows of the blocks that their signatures leave a partner."""
    trim()
    for group in _groups(batches):
        cut, open_ = _sides(group)
        own = sketches(group.column("sketch"))
        equal = np.zeros(open_.shape, np.int32)
        for r in range(REGISTERS):
            equal += own[:cut, r, None] == own[None, cut:, r]
        close = open_ & (equal >= least_agreement() * REGISTERS)
        if close.any():
            keep = np.concatenate([close.any(axis=1), close.any(axis=0)])
            yield from group.drop_columns("sketch").filter(pa.array(keep)).to_batches()


def overlaps(texts: pa.Array, cut: int) -> tuple[np.ndarray, np.ndarray]:
    """(multiset overlap of the texts before ``cut`` with those from there on, totals)."""
    text, value, count, total = shingles(texts)
    copy = spread(np.zeros(len(text), np.int64), count)
    text, value = np.repeat(text, count), mix(np.repeat(value, count) + copy.astype(np.uint64) * GOLDEN)
    left = text < cut
    shared = np.intersect1d(value[left], value[~left])
    at = np.searchsorted(shared, value)
    at[at == len(shared)] = 0
    use = shared[at] == value if len(shared) else np.zeros(len(value), bool)
    text, at = text[use], at[use]
    order = np.argsort(at, kind="stable")
    text, at = text[order], at[order]
    out = np.zeros((cut, len(texts) - cut), np.float32)
    for first in range(0, len(shared), COLUMNS):
        a, b = np.searchsorted(at, [first, first + COLUMNS])
        items = np.zeros((len(texts), COLUMNS), np.float32)
        items[text[a:b], at[a:b] - first] = 1
        out += items[:cut] @ items[cut:].T
    return out, total


def _link_blocks(batches):
    """Links of the blocks, one for each stray and component it meets."""
    trim()
    for group in _groups(batches):
        cut, open_ = _sides(group)
        if not open_.any():
            continue
        both, total = overlaps(group.column("text").combine_chunks(), cut)
        near = open_ & (both >= THRESHOLD * (total[:cut, None] + total[None, cut:] - both) - 1e-6)
        i, j = np.nonzero(near)
        if len(i):
            uid, root = group.column("uid").to_numpy(), group.column("root").to_numpy()
            _, some = np.unique(np.stack([i, root[cut + j]]), axis=1, return_index=True)
            yield pa.RecordBatch.from_pydict({"a": uid[i[some]], "b": uid[cut + j[some]]})
