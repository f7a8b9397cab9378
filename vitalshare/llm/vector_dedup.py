"""Near-duplicate vectors by sorted projection passes.

Each pass hashes a vector to the signs of ``BITS`` random projections and sorts all vectors of
a label lexicographically by them; vectors are compared with their neighbours within ``window``
ranks and with all vectors of their bucket, those whose first signs are the same. A label's n
vectors have about n / ``window`` buckets; a bucket longer than the window, as a dense group
makes, is dealt to groups of block x block. Equal vectors are one representative that carries
their number. Ranks and keys of all passes travel with a representative, so a pair found in
several passes is counted in the first one only and no list of pairs is ever made: a block
gives link counts and a spanning forest of its links, both no larger than the block. Forests
are united across passes by connected components.

Every link that is reported was checked with the cosine in double precision. A pair is found
if some pass puts it within the window or in one bucket: with at most ``window`` rows a label
all pairs are compared; beyond that, however dense the group, a pair at a cosine of 0.98 is
missed with a chance of at most (1 - 0.936 ** bits) ** passes, where bits = log2(n / window),
rounded up: 1e-6 for 8 windows, 0.003 for a million rows a label. From there on the number of
passes grows with the largest label, so that the chance stays below ``MISSED``: 12 passes for a
hundred million rows, 15 for a thousand million. Work on a bucket grows with the square of its
size, as its links may.

Defined results: vectors that are null, empty, zero or hold a null or non-finite component, and
those without a label, link with nothing; vectors of different length never link; repeated rows
(also of one vec_id) are copies of each other; an empty table gives no row; other columns are
ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitalshare.llm.components import components
from vitalshare.sources.writers import stage_table

PASSES = 8  # at least
MISSED = 0.01  # chance of missing a pair at the threshold, at most
WINDOW = 1024
BITS = 62
DEALT = 4  # windows in a block of a long bucket
AT_ONCE = 1 << 21
SEED = 20240607


def finite(values) -> F.Column:
    """Whether an array is there and holds finite numbers only."""
    good = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    return values.isNotNull() & F.coalesce(F.forall(values, good), F.lit(False))


def projections(size: int, passes: int) -> np.ndarray:
    return np.random.default_rng([SEED, size]).standard_normal((size, passes * BITS))


def passes_for(n: int, threshold: float, window: int) -> int:
    """Passes that put a pair at the threshold in one bucket of a label of n rows at least once
    with a chance of 1 - ``MISSED``."""
    bits = max(math.ceil(math.log2(max(n, 1) / window)), 0)
    together = (1 - math.acos(threshold) / math.pi) ** bits
    return PASSES if together == 1 else max(PASSES, math.ceil(math.log(MISSED) / math.log1p(-together)))


def near_duplicates(
    vectors: DataFrame, threshold: float = 0.98, passes: int | None = None, window: int = WINDOW
) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row of (vec_id, embedding, label); the number
    of ``passes`` follows from the largest label unless it is given."""
    if passes is None:
        sizes = vectors.where("label is not null").groupBy("label").count()
        passes = passes_for(sizes.agg(F.max("count")).first()[0] or 0, threshold, window)
    values = F.col("embedding").cast("array<double>")
    usable = F.col("label").isNotNull() & finite(values) & F.exists(values, lambda x: x != 0)
    text = F.concat_ws("|", F.col("label").cast("string"), values.cast("string"))
    rows = vectors.select(
        F.col("vec_id").cast("long").alias("vec_id"),
        F.when(F.coalesce(usable, F.lit(False)), F.md5(text)).alias("uid"),
        F.col("label").cast("string").alias("label"),
        values.alias("vector"),
    )
    groups = (
        rows.where("uid is not null")
        .groupBy("uid")
        .agg(
            F.min("vec_id").alias("first_id"),
            F.count("*").alias("copies"),
            F.first("label").alias("label"),
            F.first("vector").alias("vector"),
        )
    )
    unique = stage_table(groups.mapInArrow(_hashed(passes), _HASHED), "vectors")
    ranked = stage_table(_ranked(unique, window), "ranked")
    schema = "a string, b string, links long"
    near = _placed(ranked, window).groupBy("block")
    near = near.applyInPandas(lambda x: _compare(x, threshold, window), schema)
    far = _dealt(ranked, window).groupBy("pass", "label", "size", "bucket", "i", "j")
    far = far.applyInPandas(lambda x: _compare_far(x, threshold, window), schema)
    found = stage_table(near.unionByName(far), "links")
    links = found.where("b is null").groupBy(F.col("a").alias("uid")).agg(F.sum("links").alias("links"))
    roots = components(found.where("b is not null").select("a", "b"))
    whole = (
        unique.select("uid", "first_id", "copies")
        .join(links, "uid", "left")
        .join(roots.withColumnRenamed("node", "uid"), "uid", "left")
        .withColumn("root", F.coalesce("root", "uid"))
    )
    smallest = whole.groupBy("root").agg(F.min("first_id").alias("component_id"))
    of_group = whole.join(smallest, "root").select(
        "uid", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component_id"
    )
    linked = rows.where("uid is not null").select("vec_id", "uid").join(of_group, "uid")
    alone = rows.where("uid is null").select(
        "vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id")
    )
    return (
        linked.select("vec_id", "n_links", "component_id")
        .unionByName(alone)
        .withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
    )


_HASHED = "uid string, first_id long, copies long, label string, size int, vector binary, keys array<long>"


def _hashed(passes: int):
    def task(batches):
        weights = (1 << np.arange(BITS - 1, -1, -1)).astype(np.int64)
        for batch in batches:
            for start in range(0, batch.num_rows, 4096):
                part = batch.slice(start, 4096)
                lists = part.column(4)
                ends = lists.offsets.to_numpy()
                flat = lists.values.to_numpy()
                own = [flat[a:b] for a, b in zip(ends[:-1], ends[1:])]
                sizes = np.diff(ends)
                keys = np.zeros((len(own), passes), np.int64)
                for size in np.unique(sizes):
                    at = np.flatnonzero(sizes == size)
                    signs = np.stack([own[i] for i in at]) @ projections(int(size), passes) > 0
                    keys[at] = signs.reshape(len(at), passes, BITS) @ weights
                yield pa.RecordBatch.from_arrays(
                    [
                        *part.columns[:4],
                        pa.array(sizes.astype(np.int32)),
                        pa.array([x.tobytes() for x in own], pa.binary()),
                        pa.array(list(keys), pa.list_(pa.int64())),
                    ],
                    ["uid", "first_id", "copies", "label", "size", "vector", "keys"],
                )

    return task


def _numbered(batches):
    part, at = TaskContext.get().partitionId(), 0
    for batch in batches:
        n = batch.num_rows
        yield pa.RecordBatch.from_arrays(
            [
                batch.column(0),
                batch.column(4),
                pa.array(np.full(n, part, np.int64)),
                pa.array(np.arange(at, at + n)),
            ],
            ["pass", "uid", "part", "at"],
        )
        at += n


def _ranked(unique: DataFrame, window: int) -> DataFrame:
    """Each representative with its rank in every pass and the number of signs of a bucket."""
    spark = unique.sparkSession
    order = ["pass", "label", "size", "key", "uid"]
    keyed = unique.select(F.posexplode("keys").alias("pass", "key"), "label", "size", "uid").select(*order)
    sorted_ = stage_table(
        keyed.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .mapInArrow(_numbered, "pass int, uid string, part long, at long"),
        "order",
    )
    sizes = sorted(sorted_.groupBy("part").count().collect())
    before = np.cumsum([0] + [x["count"] for x in sizes]).tolist()
    offsets = spark.createDataFrame(
        [(x.part, n) for x, n in zip(sizes, before)], "part long, before long"
    )
    ranks = (
        sorted_.join(F.broadcast(offsets), "part")  # one row a partition
        .groupBy("uid")
        .agg(F.array_sort(F.collect_list(F.struct("pass", (F.col("before") + F.col("at")).alias("rank")))).alias("r"))
        .select("uid", F.col("r.rank").alias("ranks"))
    )
    bits = unique.groupBy("label", "size").agg(
        F.greatest(F.ceil(F.log2(F.count("*") / window)), F.lit(0)).cast("int").alias("bits")
    )
    return unique.drop("first_id").join(ranks, "uid").join(bits, ["label", "size"])


def _placed(ranked: DataFrame, window: int) -> DataFrame:
    """Each representative in the blocks of its ranks and, as a halo, in the blocks after."""
    return (
        ranked.select("*", F.posexplode("ranks").alias("pass", "rank"))
        .withColumn("own", F.explode(F.array(F.lit(True), F.lit(False))))
        .withColumn("block", F.floor(F.col("rank") / window) + F.when(F.col("own"), 0).otherwise(1))
    )


def _dealt(ranked: DataFrame, window: int) -> DataFrame:
    """The representatives of buckets longer than the window in blocks of their ranks, every
    two blocks (i, j) of a bucket together."""
    key = ["pass", "label", "size", "bucket"]
    each = ranked.select("*", F.posexplode("ranks").alias("pass", "rank")).withColumn(
        "bucket", F.expr(f"shiftright(keys[pass], {BITS} - bits)")
    )
    sizes = each.groupBy(*key).agg(F.min("rank").alias("start"), F.count("*").alias("n"))
    blocks = F.sequence(F.lit(0).cast("long"), F.ceil(F.col("n") / (DEALT * window)) - 1)
    return (
        each.join(sizes.where(F.col("n") > window + 1), key)
        .withColumn("own", F.floor((F.col("rank") - F.col("start")) / (DEALT * window)))
        .withColumn("other", F.explode(blocks))
        .withColumn("i", F.greatest("own", "other"))
        .withColumn("j", F.least("own", "other"))
        .drop("start", "n", "other")
    )


def _compare(rows: pd.DataFrame, threshold: float, window: int) -> pd.DataFrame:
    """Link counts and a spanning forest of one block; ``own`` rows are compared with each
    other and with the halo."""
    found = []
    if rows["own"].any():
        rows = rows.sort_values(["rank", "uid"]).reset_index(drop=True)
        for _, part in rows.groupby(["pass", "label", "size"], sort=False):
            own, here = part["own"].to_numpy(), part["rank"].to_numpy()

            def wanted(i, own=own, here=here):
                apart = here[i][:, None] - here[None, :]
                return (np.abs(apart) <= window) & ~(own[None, :] & (apart <= 0))

            found += _links(part, np.flatnonzero(own), wanted, threshold, window)
    return _frame(found)


def _compare_far(rows: pd.DataFrame, threshold: float, window: int) -> pd.DataFrame:
    """The same of the rows of two blocks of a bucket that are further apart than the window."""
    rows = rows.sort_values(["rank", "uid"]).reset_index(drop=True)
    block, here = rows["own"].to_numpy(), rows["rank"].to_numpy()
    i, j = rows["i"].iloc[0], rows["j"].iloc[0]

    def wanted(some):
        return (here[some][:, None] - here[None, :] > window) & (block == j)[None, :]

    return _frame(_links(rows, np.flatnonzero(block == i), wanted, threshold, window))


def _frame(found: list[tuple]) -> pd.DataFrame:
    a, b, links = zip(*found) if found else ([], [], [])
    return pd.DataFrame({"a": pd.Series(a, dtype=object), "b": pd.Series(b, dtype=object), "links": np.array(links, np.int64)})


def _links(part: pd.DataFrame, mine: np.ndarray, wanted, threshold: float, window: int) -> list[tuple]:
    """(uid, None, links) and (uid, uid, 0) of the spanning forest, from the pairs of a row of
    ``mine`` and a row that ``wanted`` asks for; a pair counts in the first pass that has it."""
    if len(part) < 2 or not len(mine):
        return []
    n, p = len(part), int(part["pass"].iloc[0])
    x = np.stack([np.frombuffer(v, np.float64) for v in part["vector"]])
    x = x / np.abs(x).max(axis=1, keepdims=True)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    ranks = np.stack(part["ranks"].to_numpy()).astype(np.int64)
    buckets = np.stack(part["keys"].to_numpy()).astype(np.int64) >> (BITS - int(part["bits"].iloc[0]))
    uid, copies = part["uid"].to_numpy(), part["copies"].to_numpy()
    count, low = np.zeros(n), np.arange(n)
    step = max(1, AT_ONCE // n)
    for start in range(0, len(mine), step):
        some = mine[start : start + step]
        i, j = np.nonzero((x[some] @ x.T >= threshold) & wanted(some))
        i = some[i]
        if not len(i):
            continue
        first = np.ones(len(i), bool)
        for q in range(p):
            first &= (np.abs(ranks[i, q] - ranks[j, q]) > window) & (buckets[i, q] != buckets[j, q])
        count += np.bincount(i[first], copies[j[first]], n)
        count += np.bincount(j[first], copies[i[first]], n)
        i, j = np.append(i, np.arange(n)), np.append(j, low)  # with the forest so far
        while True:
            new = low.copy()
            np.minimum.at(new, i, low[j])
            np.minimum.at(new, j, low[i])
            new = new[new]
            if (new == low).all():
                break
            low = new
    counted, joined = np.flatnonzero(count), np.flatnonzero(low != np.arange(n))
    return [(uid[k], None, int(count[k])) for k in counted] + [(uid[k], uid[low[k]], 0) for k in joined]
