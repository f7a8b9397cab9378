"""Exact top-k by integer inner product, with M-trees searched best first.

Vectors are dealt by a hash of their id to shards of about ``SHARD`` rows; each shard is an
M-tree of paged nodes, every entry with its pivot, covering radius and distance to the parent's
pivot. The largest inner product is the nearest neighbour once a coordinate sqrt(M^2 - |x|^2)
is added to the vectors and 0 to the query (M: largest norm of the shard), so the tree prunes by
the triangle inequality. A query keeps its k best; nodes wait in a queue by the smallest
distance they allow; an entry whose stored parent distance already puts it too far is left
without computing its own. Scores themselves are integers, and a node is left only when it is
farther by more than rounding can be.

Queries go to every shard in blocks of ``BLOCK``; each (shard, block) is one group of bounded
size, and gives k rows a query; the best k over the shards are the result.

Defined results: vectors that are null or hold a null or non-finite component take no part;
vectors are compared with those of equal length only; rows that repeat a vec_id are candidates
each, but ask once (for their smallest vector) and are no candidates of their own id; an empty
table gives no row; other columns are ignored.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vitalshare.llm.vector_dedup import finite
from vitalshare.sources.writers import stage_table

SHARD = 8192
BLOCK = 4096
PAGE = 128
FANOUT = 32
EXACT = 1 << 53


def quantised(values: Column, scale: int) -> Column:
    return F.transform(values.cast("array<double>"), lambda x: F.floor(x * scale))


def top_k(vectors: DataFrame, asks: Column, k: int = 5, scale: int = 256) -> DataFrame:
    """query_id, rank, vec_id, score for rows of (vec_id, embedding) that fulfil ``asks`` (a
    condition on vec_id); the score is the inner product of floor(scale * x)."""
    usable = finite(F.col("embedding").cast("array<double>"))
    rows = stage_table(
        vectors.where(F.col("vec_id").isNotNull() & usable).select(
            F.col("vec_id").cast("long").alias("vec_id"),
            quantised(F.col("embedding"), scale).alias("x"),
            F.size("embedding").alias("size"),
        ),
        "quantised",
    )
    n = rows.count()
    shards = max(1, -(-n // SHARD))
    own = F.pmod(F.xxhash64("vec_id", "x"), F.lit(shards)).cast("int").alias("shard")
    pages = stage_table(
        rows.withColumn("shard", own).groupBy("size", "shard").applyInPandas(build, PAGES), "pages"
    )
    queries = rows.where(asks).groupBy("vec_id").agg(F.min_by(F.struct("x", "size"), F.col("x")).alias("q"))
    queries = queries.select("vec_id", "q.x", "q.size")
    blocks = max(1, -(-queries.count() // BLOCK))
    block = F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int").alias("block")
    asked = queries.select("vec_id", "x", "size", block).withColumn(
        "shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))
    )
    spread = pages.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    key = ["size", "shard", "block"]
    found = asked.groupBy(key).cogroup(spread.groupBy(key)).applyInPandas(
        lambda q, p: search(q, p, k), "query_id long, vec_id long, score long"
    )
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (
        found.withColumn("rank", F.row_number().over(best))
        .where(F.col("rank") <= k)
        .select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
    )


PAGES = (
    "size int, shard int, page int, leaf boolean, ids binary, vectors binary, norms binary, "
    "radii binary, parents binary"
)


def lift(x: np.ndarray, top: float) -> np.ndarray:
    """Vectors with the added coordinate."""
    x = x.astype(np.float64)
    return np.column_stack([x, np.sqrt(np.maximum(top - (x * x).sum(axis=1), 0))])


def build(rows: pd.DataFrame) -> pd.DataFrame:
    """The pages of one shard's tree; page 0 is the root. An inner page lists child pages
    (``ids``), their pivots, radii and distances to the page's own pivot; a leaf lists vec_ids,
    vectors and distances."""
    rows = rows.sort_values("vec_id", kind="stable")
    ids = rows["vec_id"].to_numpy(np.int64)
    size, shard = int(rows["size"].iloc[0]), int(rows["shard"].iloc[0])
    x = np.stack(rows["x"].to_numpy()).astype(np.int64).reshape(len(rows), size)
    norms = (x.astype(np.float64) ** 2).sum(axis=1)
    lifted = lift(x, norms.max())
    rng = np.random.default_rng(shard)
    pages: list = []

    def node(members: np.ndarray, pivot: np.ndarray) -> int:
        page = len(pages)
        pages.append(None)
        if len(members) <= PAGE:
            far = np.linalg.norm(lifted[members] - pivot, axis=1)
            pages[page] = (True, ids[members], x[members], np.zeros(len(members)), far)
            return page
        k = min(FANOUT, -(-len(members) // (PAGE // 2)))
        seeds = lifted[rng.choice(members, k, replace=False)]
        near = np.stack([((lifted[members] - s) ** 2).sum(axis=1) for s in seeds]).argmin(axis=0)
        if np.bincount(near, minlength=k).max() > 0.9 * len(members):
            near = np.arange(len(members)) * k // len(members)  # copies: equal shares
        children, radii = [], []
        kept = [c for c in range(k) if (near == c).any()]
        for c in kept:
            part = members[near == c]
            radii.append(np.linalg.norm(lifted[part] - seeds[c], axis=1).max())
            children.append(node(part, seeds[c]))
        own = seeds[kept]
        far = np.linalg.norm(own - pivot, axis=1)
        pages[page] = (False, np.array(children, np.int64), own, np.array(radii), far)
        return page

    node(np.arange(len(rows)), lifted.mean(axis=0))
    head = np.concatenate([lifted.mean(axis=0), [norms.max(), float(np.abs(x).max(initial=0))]])
    return pd.DataFrame(
        [
            (size, shard, i, leaf, own.tobytes(), v.tobytes(), head.tobytes(), r.tobytes(), far.tobytes())
            for i, (leaf, own, v, r, far) in enumerate(pages)
        ],
        columns=[c.split()[0] for c in PAGES.split(", ")],
    )


def search(queries: pd.DataFrame, pages: pd.DataFrame, k: int) -> pd.DataFrame:
    """The k best of one shard for each query of a block."""
    out: list[tuple[int, int, int]] = []
    if len(queries) and len(pages):
        pages = pages.sort_values("page")
        size = int(pages["size"].iloc[0])
        head = np.frombuffer(pages["norms"].iloc[0], np.float64)
        centre, top, widest = head[:-2], head[-2], head[-1]
        tree = []
        for leaf, ids, vectors, radii, far in zip(
            pages["leaf"], pages["ids"], pages["vectors"], pages["radii"], pages["parents"]
        ):
            width = size if leaf else size + 1
            entries = np.frombuffer(ids, np.int64)
            x = np.frombuffer(vectors, np.int64 if leaf else np.float64).reshape(len(entries), width)
            tree.append((leaf, entries, x, np.frombuffer(radii, np.float64), np.frombuffer(far, np.float64)))
        asked = np.stack(queries["x"].to_numpy()).astype(np.int64).reshape(len(queries), size)
        if size * widest * float(np.abs(asked).max(initial=0)) < EXACT:
            tree = [(leaf, e, x.astype(np.float64), r, f) for leaf, e, x, r, f in tree]
            asked = asked.astype(np.float64)
        for query, q in zip(queries["vec_id"].tolist(), asked):
            out += [(query, -v, int(s)) for s, v in best_first(tree, query, q, k, centre, top)]
    return pd.DataFrame(out, columns=["query_id", "vec_id", "score"]).astype("int64")


def best_first(tree, query: int, q: np.ndarray, k: int, centre: np.ndarray, top: float):
    """(score, -vec_id) of the k best entries for one query."""
    point = np.append(q.astype(np.float64), 0.0)
    norm = float(point @ point)
    slack = 1e-9 * (norm + top) ** 0.5 + 1e-6
    best: list[tuple[float, int]] = []
    limit = np.inf  # distance of the k-th best, with slack
    queue = [(0.0, 0, float(np.linalg.norm(point - centre)))]
    while queue:
        bound, page, here = heapq.heappop(queue)
        if bound > limit:
            break
        leaf, ids, x, radii, far = tree[page]
        at = np.flatnonzero(np.abs(here - far) - radii <= limit)
        if leaf:
            scores = x[at] @ q
            if len(best) == k:
                good = scores >= best[0][0]
                at, scores = at[good], scores[good]
            for s, v in zip(scores.tolist(), ids[at].tolist()):
                if v != query:
                    if len(best) < k:
                        heapq.heappush(best, (s, -v))
                    elif (s, -v) > best[0]:
                        heapq.heapreplace(best, (s, -v))
            if len(best) == k:
                limit = max(norm + top - 2 * best[0][0], 0.0) ** 0.5 + slack
        elif len(at):
            own = np.linalg.norm(x[at] - point, axis=1)
            for child, d, low in zip(ids[at].tolist(), own.tolist(), (own - radii[at]).tolist()):
                if low <= limit:
                    heapq.heappush(queue, (max(low, bound), child, d))
    return best
