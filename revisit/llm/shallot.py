"""Integer k-means with Shallot search.

Every vector remembers its nearest and second-nearest centroid, an upper bound
of its distance to the first and a lower bound of its distance to all others.
After the centroids move the bounds are widened by the drifts; a vector whose
bounds still separate the two keeps its centroid unread.  Any other one takes
the exact distances to its two centroids, starts from the closer one and goes
through that centroid's neighbours in order of distance, up to the ball of
radius d(start) + d(second), which shrinks with each better second (Ch. Borgelt,
Even faster exact k-means clustering, 2020).  Bounds are doubles with a slack;
all comparisons of survivors are of integer squared distances.

Vectors without exactly ``dim`` components, or with null or non-finite ones,
take no part.  Repeated rows count each; ties go to the smaller centroid
number.  Fewer vectors than ``k`` give as many centroids.  An empty table gives
no rows.  Extra columns are ignored.  Components reach 2^24 at most, so that
distances and sums fit in 64 bits; larger ones raise.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from revisit.llm.common import drop_staged, finite, staged

STATE = "id long, v array<int>, near int, second int, upper double, lower double, distance long"
SLACK = 1e-9


def nearest(x: np.ndarray, centroids: np.ndarray, near: np.ndarray, second: np.ndarray):
    """(near, second, squared distance, second's squared distance) of each row
    of ``x``, found from the remembered pair; all int64."""
    k = len(centroids)
    sq = lambda rows, c: np.square(x[rows] - centroids[c]).sum(1)
    every = np.arange(len(x))
    if k == 1:
        return near * 0, near * 0, sq(every, near * 0), np.full(len(x), np.iinfo(np.int64).max)
    d1, d2 = sq(every, near), sq(every, second)
    swap = (d2 < d1) | ((d2 == d1) & (second < near))
    near, second = np.where(swap, second, near), np.where(swap, near, second)
    d1, d2 = np.where(swap, d2, d1), np.where(swap, d1, d2)
    gaps = np.sqrt(np.square(centroids[:, None] - centroids[None]).sum(2).astype(np.float64))
    order = np.argsort(gaps, axis=1, kind="stable")
    start, first = near.copy(), second.copy()
    reach = np.sqrt(d1.astype(np.float64))
    left = every
    for step in range(k):
        c = order[start[left], step]
        inside = gaps[start[left], c] <= (reach[left] + np.sqrt(d2[left].astype(np.float64))) * (1 + SLACK)
        left, c = left[inside], c[inside]  # neighbours further out are further still
        if not len(left):
            break
        fresh = (c != start[left]) & (c != first[left])
        rows, c = left[fresh], c[fresh]
        d = sq(rows, c)
        best = (d < d1[rows]) | ((d == d1[rows]) & (c < near[rows]))
        next_best = ~best & ((d < d2[rows]) | ((d == d2[rows]) & (c < second[rows])))
        b = rows[best]
        d2[b], second[b], d1[b], near[b] = d1[b], near[b], d[best], c[best]
        d2[rows[next_best]], second[rows[next_best]] = d[next_best], c[next_best]
    return near, second, d1, d2


def _assign(centroids: list[list[int]], drift: list[float] | None, last: bool):
    """One assignment over batches of STATE; with ``drift`` the bounds of the
    last one hold after widening."""
    c = np.array(centroids, dtype=np.int64)
    k = len(c)
    moved = np.array(drift) if drift is not None else None

    def batches(rows):
        for b in rows:
            n = len(b)
            x = b.column("v").flatten().to_numpy(zero_copy_only=False).reshape(n, -1).astype(np.int64)
            near, second, upper, lower, distance = [
                b.column(i).to_numpy(zero_copy_only=False).copy() for i in ("near", "second", "upper", "lower", "distance")]
            todo = np.ones(n, dtype=bool)
            if moved is not None and k > 1:
                others = np.array([np.delete(moved, i).max() for i in range(k)])
                upper, lower = upper + moved[near], lower - others[near]
                gaps = np.sqrt(np.square(c[:, None] - c[None]).sum(2).astype(np.float64))
                np.fill_diagonal(gaps, np.inf)
                todo = upper * (1 + SLACK) >= np.maximum(lower, gaps.min(1)[near] / 2) * (1 - SLACK)
            if last:  # a kept vector still needs its exact distance
                kept = np.flatnonzero(~todo)
                distance[kept] = np.square(x[kept] - c[near[kept]]).sum(1)
            at = np.flatnonzero(todo)
            a, s, d1, d2 = nearest(x[at], c, near[at].astype(np.int64), second[at].astype(np.int64))
            near[at], second[at], distance[at] = a, s, d1
            upper[at], lower[at] = np.sqrt(d1.astype(np.float64)), np.sqrt(d2.astype(np.float64))
            yield pa.RecordBatch.from_arrays([
                b.column("id"), b.column("v"), pa.array(near, pa.int32()), pa.array(second, pa.int32()),
                pa.array(upper), pa.array(lower), pa.array(distance, pa.int64())],
                ["id", "v", "near", "second", "upper", "lower", "distance"])

    return batches


def integer_vectors(table: DataFrame, id_col: str, vec_col: str, dim: int, scale: int) -> DataFrame:
    """(id, v array<int>) of the vectors that take part."""
    whole = F.transform(F.col(vec_col), lambda x: F.floor(F.lit(float(scale)) * x.cast("double")))
    fits = lambda a: F.when(F.forall(a, lambda x: F.abs(x) <= (1 << 24)), a.cast("array<int>")).otherwise(
        F.raise_error(F.lit("a component is beyond 2^24")).cast("array<int>"))
    return table.where((F.size(vec_col) == dim) & finite(F.col(vec_col))).select(
        F.col(id_col).cast("long").alias("id"), fits(whole).alias("v"))


def shallot_means(table: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", dim: int = 64, k: int = 16,
                  rounds: int = 3, scale: int = 64, seed: int = 1) -> tuple[DataFrame, list[list[int]]]:
    """(id, cluster, distance) of each vector, and the final centroids.

    The vectors with the ``k`` smallest sha256 of ``seed:id`` are the first
    centroids.  Each round is one pass over the written state and one
    aggregation of ``k`` rows; only centroids (k x dim integers) come to the
    driver, and the state before is deleted once its successor is written."""
    start = integer_vectors(table, id_col, vec_col, dim, scale)
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256)
    state = staged(start.select("id", "v", F.lit(0).alias("near"), F.lit(1).alias("second"),
                                F.lit(float("inf")).alias("upper"), F.lit(0.0).alias("lower"), F.lit(0).cast("long").alias("distance")),
                   "vectors")
    first = state.select("v", key.alias("key")).orderBy(F.col("key").asc_nulls_last(), "v").limit(k).collect()
    centroids, drift = [list(r["v"]) for r in first], None
    if not centroids:
        return state.select("id", F.col("near").alias("cluster"), "distance"), []
    for turn in range(rounds + 1):
        before, state = state, staged(state.mapInArrow(_assign(centroids, drift, turn == rounds), STATE), f"round{turn}")
        drop_staged(before)
        if turn < rounds:
            sums = state.groupBy("near").agg(F.count("*").alias("n"), F.array(
                *[F.sum(F.get("v", F.lit(i))) for i in range(dim)]).alias("s")).collect()
            new = [list(c) for c in centroids]
            for r in sums:
                new[r["near"]] = [s // r["n"] for s in r["s"]]
            drift = np.sqrt(np.square(np.array(new, dtype=np.int64) - np.array(centroids, dtype=np.int64)).sum(1)).tolist()
            centroids = new
    return state.select("id", F.col("near").alias("cluster"), "distance"), centroids


def with_inertia(assigned: DataFrame, centroids: list[list[int]]) -> DataFrame:
    """``assigned`` plus inertia of the cluster, of all, and the centroid's digest."""
    spark = assigned.sparkSession
    digest = [(i, hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()) for i, c in enumerate(centroids)]
    per = assigned.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()  # k rows at most
    of = {r["cluster"]: r["s"] for r in per}
    rows = [(i, of[i], sum(of.values()), h) for i, h in digest if i in of]
    facts = spark.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return assigned.join(F.broadcast(facts), "cluster")
