"""Nearest neighbours by multi-index hashing.

Vectors get binary codes: the signs of learned rotations of the centred vector
(iterative quantisation on a bounded sample).  A code is cut into substrings of
16 bits and every substring is indexed.  If two codes differ in at most r bits,
some substring differs in at most r / (number of substrings), so probing each
index at that radius retrieves every code within r (pigeonhole; M. Norouzi
et al., Fast exact search in Hamming space, 2014).  Survivors of the full
Hamming distance are ranked by the exact distance of the original vectors.

The radius of a query is learned: its k-th nearest distance within the sample
bounds the one in the table, and ``reach`` gives the Hamming distance within
which all but a small share of sample pairs at that distance lie.  It is at
least the k-th smallest Hamming distance to the sample, so k rows are found.
Probing goes on ring by ring and stops early when the k nearest found so far
need no larger radius.

The index is dealt into shards of bounded size, each with its substring tables,
and the queries into blocks of bounded size; each shard answers each block and
passes on k rows a query.

Vectors that are null, zero, of another length than the commonest, or hold a
null or non-finite component take no part.  Repeated rows are rows of their
own: a query leaves out itself alone.  Ties go to the smaller id, null ids
last.  Empty tables give no rows; extra columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from revisit.llm.common import finite, staged

SUB = 16
RESULT = "query_row long, query_id long, vec_id long, row long, score double"


@dataclass
class Codes:
    """Fitted coder: projection of the centred vector, and for distances up to
    ``upto[i]`` the Hamming radius ``reach[i]``."""
    mean: np.ndarray
    rotations: np.ndarray
    upto: np.ndarray
    reach: np.ndarray
    sample: np.ndarray
    sample_rows: np.ndarray

    @property
    def bits(self) -> int:
        return self.rotations.shape[1]

    def encode(self, x: np.ndarray) -> np.ndarray:
        """(n, bits / 16) little-endian 16-bit substrings of the codes."""
        signs = (x - self.mean) @ self.rotations > 0
        return np.packbits(signs, axis=1, bitorder="little").view("<u2")

    def needed(self, distance: np.ndarray) -> np.ndarray:
        """Radius to probe for a k-th nearest distance; all bits if unbounded."""
        at = np.searchsorted(self.upto, distance)
        return np.append(self.reach, self.bits)[np.minimum(at, len(self.reach))]


def hamming(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b).sum(-1, dtype=np.int64)


def distances(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    return np.sqrt(np.square(x - q).sum(1))


def fit_codes(sample: np.ndarray, sample_rows: np.ndarray, min_bits: int = 256, iterations: int = 15, k: int = 10,
              miss: float = 0.005, queries: int = 256, seed: int = 7) -> Codes:
    """Rotations by iterative quantisation (Y. Gong, S. Lazebnik, 2011), several
    from different starts until there are ``min_bits`` bits, and the reach
    table from the pairs of ``queries`` sample rows with all others."""
    n, dim = sample.shape
    mean = sample.mean(0)
    centred = sample - mean
    rng, made = np.random.default_rng(seed), []
    while sum(r.shape[1] for r in made) < min_bits:
        r = np.linalg.qr(rng.standard_normal((dim, dim)))[0]
        for _ in range(iterations):
            u, _, vt = np.linalg.svd(np.where(centred @ r > 0, 1.0, -1.0).T @ centred)
            r = vt.T @ u.T
        made.append(r)
    bits = sum(r.shape[1] for r in made) // SUB * SUB
    codes = Codes(mean, np.concatenate(made, axis=1)[:, :bits], np.zeros(0), np.zeros(0, dtype=np.int64), sample, sample_rows)
    own = codes.encode(sample)
    d, h = [], []
    for i in range(min(queries, n)):
        rest = np.arange(n) != i
        d.append(distances(sample[rest], sample[i]))
        h.append(hamming(own[rest], own[i]))
    if n > k:
        d, h = np.concatenate(d), np.concatenate(h)
        order = np.argsort(d, kind="stable")
        parts = np.array_split(order, max(1, len(order) // 512))
        codes.upto = np.array([d[p].max() for p in parts])
        codes.reach = np.maximum.accumulate([np.sort(h[p])[int(np.ceil(len(p) * (1 - miss))) - 1] for p in parts])
    return codes


def query_radius(codes: Codes, row: int, x: np.ndarray, code: np.ndarray, sample_codes: np.ndarray, k: int) -> int:
    """Hamming radius for one query by its k-th nearest row of the sample."""
    rest = codes.sample_rows != row
    if rest.sum() < k:
        return codes.bits
    d, h = distances(codes.sample[rest], x), hamming(sample_codes[rest], code)
    need = codes.needed(np.partition(d, k - 1)[k - 1:k])[0]
    return int(max(need, np.partition(h, k - 1)[k - 1]))


class Shard:
    """Substring tables over the rows of one shard."""

    #: The 16-bit patterns with exactly so many bits set.
    RINGS = [np.flatnonzero(np.bitwise_count(np.arange(1 << SUB, dtype=np.uint16)) == r).astype(np.uint16) for r in range(SUB + 1)]

    def __init__(self, codes: np.ndarray):
        self.codes = codes
        self.order = [np.argsort(codes[:, j], kind="stable") for j in range(codes.shape[1])]
        self.values, self.starts = [], []
        for j, order in enumerate(self.order):
            values, starts = np.unique(codes[order, j], return_index=True)
            self.values.append(values)
            self.starts.append(np.append(starts, len(order)))

    def probe(self, j: int, value: np.uint16, low: int, high: int) -> np.ndarray:
        """Rows whose substring j differs from ``value`` in low..high bits: by
        all such values, or by the values held, whichever are fewer."""
        held, starts = self.values[j], self.starts[j]
        if sum(len(self.RINGS[r]) for r in range(low, high + 1)) < len(held):
            asked = np.concatenate([self.RINGS[r] for r in range(low, high + 1)]) ^ value
            at = np.minimum(np.searchsorted(held, asked), len(held) - 1)
            at = at[held[at] == asked]
        else:
            bits = np.bitwise_count(held ^ value)
            at = np.flatnonzero((bits >= low) & (bits <= high))
        first, n = starts[at], starts[at + 1] - starts[at]
        if not len(n):
            return first
        return self.order[j][np.repeat(first - np.append(0, np.cumsum(n)[:-1]), n) + np.arange(n.sum())]

    def search(self, code: np.ndarray, radius: int, rank, opening: int = 2) -> None:
        """Call ``rank(rows)`` with rows within the radius it asks for; it gives
        back the radius still needed.  The first rings up to ``opening`` are
        probed together, then all the rest that the radius needs."""
        m = self.codes.shape[1]
        seen = np.zeros(len(self.codes), dtype=bool)
        low, high = 0, min(opening, radius // m)
        while True:
            fresh = np.zeros(len(self.codes), dtype=bool)
            for j in range(m):
                fresh[self.probe(j, code[j], low, high)] = True
            rows = np.flatnonzero(fresh & ~seen)
            seen[rows] = True
            radius = min(radius, rank(rows[hamming(self.codes[rows], code) <= radius]))
            if m * (high + 1) > radius:  # all within m * (high + 1) - 1 are retrieved
                return
            low, high = high + 1, min(radius // m, SUB)


def answer(shard: Shard, rows: np.ndarray, ids: np.ndarray, vectors: np.ndarray, codes: Codes, code: np.ndarray,
           q: np.ndarray, q_row: int, radius: int, k: int) -> list[tuple[float, int]]:
    """The k nearest (distance, position) of a shard for one query."""
    best_d, best = np.zeros(0), np.zeros(0, dtype=np.int64)

    def rank(found: np.ndarray) -> int:
        nonlocal best_d, best
        found = found[rows[found] != q_row]
        d = np.concatenate([best_d, distances(vectors[found], q)])
        at = np.concatenate([best, found])
        order = np.lexsort((rows[at], ids[at], d))[:k]
        best_d, best = d[order], at[order]
        return int(codes.needed(best_d[-1:])[0]) if len(best) == k else codes.bits

    shard.search(code, radius, rank)
    return list(zip(best_d.tolist(), best.tolist()))


def _matrix(column: pa.Array, kind) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).astype(kind).reshape(len(flat), -1)


def search(table: DataFrame, is_query: Column, k: int = 10, id_col: str = "vec_id", vec_col: str = "embedding",
           sample_rows: int = 4096, shard_rows: tuple[int, int] = (2048, 65536), block_queries: int = 8192) -> DataFrame:
    """(query_id, rank, vec_id, score) of the ``k`` nearest rows found for each
    row where ``is_query`` holds, against all rows.

    ``sample_rows`` bounds what the coder is fitted on; every row is indexed.
    A shard has a 256th of the rows, within the bounds of ``shard_rows``."""
    spark = table.sparkSession
    usable = table.where(finite(F.col(vec_col)) & F.exists(vec_col, lambda x: x != 0))
    lengths = usable.groupBy(F.size(vec_col).alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()
    dim = lengths[0]["n"] if lengths else 1
    rows = staged(usable.where(F.size(vec_col) == dim).select(
        F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast("array<double>").alias("v"),
        F.coalesce(is_query, F.lit(False)).alias("asks"), F.monotonically_increasing_id().alias("row")), "vectors")
    n, n_asks = rows.agg(F.count("*"), F.coalesce(F.sum(F.col("asks").cast("long")), F.lit(0))).first()
    drawn = rows.select("row", "vec_id", "v").orderBy(F.xxhash64("vec_id", "v"), "row").limit(sample_rows).collect()
    sample = np.array([r["v"] for r in drawn], dtype=np.float64).reshape(len(drawn), dim)
    codes = fit_codes(sample, np.array([r["row"] for r in drawn], dtype=np.int64), k=k) if len(drawn) else None
    shards = max(1, -(-n // max(shard_rows[0], min(shard_rows[1], n // 256))))
    blocks = max(1, -(-n_asks // block_queries))

    def encode(batches):
        for b in batches:
            if len(b):
                code = codes.encode(_matrix(b.column("v"), np.float64))
                yield b.append_column("code", pa.array([c.tobytes() for c in code], pa.binary()))

    index = staged(rows.mapInArrow(encode, "vec_id long, v array<double>, asks boolean, row long, code binary"), "index")

    def radii(batches):
        own = codes.encode(codes.sample) if codes else None
        for b in batches:
            if len(b):
                x = _matrix(b.column("v"), np.float64)
                c = np.frombuffer(b"".join(b.column("code").to_pylist()), dtype="<u2").reshape(len(b), -1)
                r = [query_radius(codes, row, v, code, own, k) for row, v, code in zip(b.column("row").to_pylist(), x, c)]
                yield b.append_column("radius", pa.array(r, pa.int32()))

    asks = index.where("asks").mapInArrow(radii, "vec_id long, v array<double>, asks boolean, row long, code binary, radius int")
    deal = lambda parts, salt: F.pmod(F.xxhash64("vec_id", "row", F.lit(salt)), F.lit(parts)).cast("int")
    every = lambda parts: F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))
    held = index.select("row", "vec_id", "v", "code", deal(shards, 0).alias("shard"), every(blocks).alias("block"))
    asks = staged(asks.select("row", "vec_id", "v", "code", "radius"), "queries")
    asks = asks.select("*", deal(blocks, 1).alias("block"), every(shards).alias("shard"))

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        if left.num_rows and right.num_rows:
            low = np.iinfo(np.int64)
            ids_of = lambda t: np.array([low.max if i is None else i for i in t.column("vec_id").to_pylist()], dtype=np.int64)
            code_of = lambda t: np.frombuffer(b"".join(t.column("code").to_pylist()), dtype="<u2").reshape(t.num_rows, -1)
            row, ids, x = left.column("row").to_numpy(), ids_of(left), _matrix(left.column("v"), np.float64)
            shard, names = Shard(code_of(left)), left.column("vec_id").to_pylist()
            for q_row, q_id, q, code, radius in zip(right.column("row").to_pylist(), right.column("vec_id").to_pylist(),
                                                    _matrix(right.column("v"), np.float64), code_of(right),
                                                    right.column("radius").to_pylist()):
                for d, i in answer(shard, row, ids, x, codes, code, q, q_row, radius, k):
                    out.append((q_row, q_id, names[i], int(row[i]), d))
        cols = list(zip(*out)) if out else [[]] * 5
        return pa.table([pa.array(c, t) for c, t in zip(cols, [pa.int64()] * 4 + [pa.float64()])],
                        names=["query_row", "query_id", "vec_id", "row", "score"])

    found = held.groupBy("shard", "block").cogroup(asks.groupBy("shard", "block")).applyInArrow(meet, RESULT)
    order = Window.partitionBy("query_row").orderBy("score", F.col("vec_id").asc_nulls_last(), "row")
    return (found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))


def brute_force(vectors: np.ndarray, ids: np.ndarray, queries: np.ndarray, k: int) -> list[list[int]]:
    """Positions of the k nearest rows of each query position; for measuring recall."""
    out = []
    for q in queries:
        d = distances(vectors, vectors[q])
        d[q] = np.inf
        out.append(np.lexsort((ids, d))[:min(k, len(vectors) - 1)].tolist())
    return out
