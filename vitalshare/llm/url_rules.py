"""URL rules by a sort-merge range join.

A host is keyed by its labels in reverse, each closed by a dot (``com.example.www.``), so that
a rule's host and all its subdomains are one interval of keys. Pages and rules are dealt to
ranges of keys (cut points from a sample; pages of one host spread by a hash behind the key, so
a hot host fills as many ranges as it needs; a rule goes to every range its interval meets),
sorted, and swept once: a stack holds the nested hosts whose intervals are open, and a page
compares its path with the rules on the stack only. The longest rule (host and path together,
then host) wins; without one the page is allowed.

Defined results: a null url, or one without ``://``, has an empty host and path, so no rule
fits; a rule without a host is ignored, without a path it covers all paths; of equal rules with
different verdicts ``block`` holds; repeated pages are judged each; empty tables give no row or
no rule; other columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_right

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vitalshare.llm.common import slices

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
SAMPLED = 100
DEFAULT = "allow"
LAST = "\U0010ffff"


def rest_of(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))


def lowered(text: Column) -> Column:
    return F.translate(text, UPPER, UPPER.lower())


def host_key(host: Column) -> Column:
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.", -1)), "."), F.lit("."))


def with_host_and_path(pages: DataFrame) -> DataFrame:
    """page_id, url, host, path."""
    rest = F.coalesce(rest_of(F.col("url")), F.lit(""))
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    path = F.regexp_extract(F.substr(rest, F.length(host) + 1), "^[^?#]*", 0)
    return pages.select(
        F.col("page_id").cast("long"), "url", lowered(host).alias("host"), path.alias("path")
    )


def judge(pages: DataFrame, rules: DataFrame) -> DataFrame:
    """page_id, host, path, rule (null if none fits), verdict for every row of ``pages``
    (page_id, url); ``rules`` has host, path and verdict (allow or block)."""
    spark = pages.sparkSession
    ranges = int(spark.conf.get("spark.sql.shuffle.partitions"))
    cuts = _cuts(with_host_and_path(pages), ranges)
    found = with_host_and_path(pages).select(
        _sort_key().alias("key"), "page_id", "host", "path", F.lit(None).cast("string").alias("verdict")
    )
    own = (
        rules.where("coalesce(host, '') <> ''")
        .select(lowered(F.col("host")).alias("host"), F.coalesce("path", F.lit("")).alias("path"), "verdict")
        .groupBy("host", "path")
        .agg(F.max("verdict").alias("verdict"))
        .select(host_key(F.col("host")).alias("key"), F.lit(None).cast("long").alias("page_id"), "host", "path", "verdict")
    )
    schema = "place int, key string, page_id long, host string, path string, verdict string"
    placed = found.mapInArrow(lambda x: _placed(x, cuts, False), schema).unionByName(
        own.mapInArrow(lambda x: _placed(x, cuts, True), schema)
    )
    return (
        placed.repartition(ranges, "place")
        .sortWithinPartitions("place", "key")
        .mapInArrow(_sweep, "page_id long, host string, path string, rule string, verdict string")
    )


def _sort_key() -> Column:
    return F.concat(host_key(F.col("host")), F.lit("\0"), F.hex(F.xxhash64("page_id", "url")))


def _cuts(pages: DataFrame, ranges: int) -> list[str]:
    """Cut points between ranges, from about ``SAMPLED`` keys a range."""
    n = pages.count()
    share = min(1.0, SAMPLED * ranges / max(n, 1))
    keys = sorted(x[0] for x in pages.sample(share, seed=7).select(_sort_key()).collect())
    return [keys[len(keys) * i // ranges] for i in range(1, ranges)] if len(keys) > ranges else []


def _placed(batches, cuts: list[str], spans: bool):
    """Adds the range of each row; with ``spans`` a row goes to every range it meets."""
    for batch in batches:
        keys = batch.column(0).to_pylist()
        place, take = [], []
        for i, key in enumerate(keys):
            first = bisect_right(cuts, key)
            last = bisect_right(cuts, key + LAST) if spans else first
            place.extend(range(first, last + 1))
            take.extend([i] * (last + 1 - first))
        rows = batch.take(pa.array(take, pa.int64()))
        yield pa.RecordBatch.from_arrays(
            [pa.array(place, pa.int32()), *rows.columns], ["place", *batch.schema.names]
        )


def _sweep(batches):
    stack: list[tuple[str, str, dict[str, str], list[int]]] = []
    here = None
    for whole in batches:
        for start, stop in slices(whole.column("path")):
            batch = whole.slice(start, stop - start)
            out = []
            for place, key, page, host, path, verdict in zip(*(x.to_pylist() for x in batch.columns)):
                if place != here:
                    here = place
                    stack.clear()
                while stack and not key.startswith(stack[-1][0]):
                    stack.pop()
                if verdict is not None:
                    if not stack or stack[-1][0] != key:
                        stack.append((key, host, {}, []))
                    _, _, paths, sizes = stack[-1]
                    paths[path] = verdict
                    if len(path) not in sizes:
                        sizes.append(len(path))
                        sizes.sort(reverse=True)
                    continue
                best = (-1, -1, None, DEFAULT)
                for _, owner, paths, sizes in stack:
                    for size in sizes:
                        if size <= len(path) and path[:size] in paths:
                            head = path[:size]
                            rank = (len(owner) + size, len(owner))
                            if rank > best[:2]:
                                best = (*rank, owner + head, paths[head])
                            break
                out.append((page, host, path, best[2], best[3]))
            if out:
                columns = list(zip(*out))
                types = [pa.int64()] + [pa.string()] * 4
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x, t) for x, t in zip(columns, types)],
                    ["page_id", "host", "path", "rule", "verdict"],
                )
