"""Near-duplicate links inside hashed blocks, and connected components.

Every block is split into chunks of bounded size and each pair of chunks is one
group, so a hot block is spread over many tasks.  A task emits a spanning
forest of its verified links, never all pairs.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from revisit.llm.common import drop_staged, staged

#: Broadcasts of key lists stop at this many rows (16 bytes each, 16 MB).
BROADCAST_ROWS = 1_000_000


def bounded_broadcast(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Hint a broadcast only when the (already written) frame has at most
    ``limit`` rows; otherwise Spark plans a shuffled join."""
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df


def forest(n: int, near: Callable[[int, np.ndarray], np.ndarray]) -> Iterator[tuple[int, int]]:
    """Spanning forest of the link graph on 0..n-1; ``near(u, rest)`` is the
    mask of ``rest`` linked to ``u``.  Each node is expanded once, against the
    nodes not reached yet."""
    rest = np.arange(n)
    while len(rest):
        queue, rest = [int(rest[0])], rest[1:]
        while queue and len(rest):
            u = queue.pop()
            hit = near(u, rest)
            for v in rest[hit]:
                yield u, int(v)
                queue.append(int(v))
            rest = rest[~hit]


def link_blocks(rows: DataFrame, payload: str, make_near, chunk: int = 2048) -> DataFrame:
    """Links among ``rows`` (key long, node long, payload) with equal key.

    ``make_near(values)`` gets the payload list of one group and returns the
    ``near`` of :func:`forest`.  Rows must be distinct per (key, node).
    Returns links (a, b), a < b; links of one block connect exactly what all
    its verified pairs connect.
    """
    big = staged(rows.groupBy("key").count().where(F.col("count") > chunk)
                 .select("key", F.ceil(F.col("count") / chunk).cast("int").alias("parts")), "hot-keys")
    rows = (rows.join(bounded_broadcast(big), "key", "left")
            .withColumn("parts", F.coalesce("parts", F.lit(1)))
            .withColumn("own", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
            .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
            .select("key", F.least("own", "other").alias("p"), F.greatest("own", "other").alias("q"), "node", payload))
    rows = rows.repartition("key", "p", "q").sortWithinPartitions("key", "p", "q", "node")

    def links(batches):
        def edges(node, values):
            near = make_near(values)
            out = [(min(node[u], node[v]), max(node[u], node[v])) for u, v in forest(len(node), near)]
            return out

        group, node, values = None, [], []
        for batch in batches:
            cols = [c.to_pylist() for c in batch.columns]
            out = []
            for k, p, q, n, v in zip(*cols):
                if (k, p, q) != group:
                    if len(node) > 1:
                        out += edges(node, values)
                    group, node, values = (k, p, q), [], []
                node.append(n)
                values.append(v)
            yield _pairs(out)
        if len(node) > 1:
            yield _pairs(edges(node, values))

    return rows.mapInArrow(links, "a long, b long").distinct()


def _pairs(out):
    return pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int64()),
                                       pa.array([x[1] for x in out], pa.int64())], ["a", "b"])


def components(edges: DataFrame) -> DataFrame:
    """Connected components of links (a, b) by alternating large-star and
    small-star steps.  Returns (node, component): the smallest node reachable,
    for every node that has a link.  Each step is a partial-aggregated minimum
    and a join, written to the shared folder; nothing is collected."""
    edges = staged(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
                   .distinct(), "edges")
    last = None
    while True:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = (both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
                 .where("a <> b").distinct())
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a")
        before, edges = edges, staged(small.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
                                      .union(low.select("a", F.col("m").alias("b"))).where("a <> b").distinct(), "edges")
        drop_staged(before)
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == last:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).union(
                edges.select("b", "b").distinct())
        last = now
