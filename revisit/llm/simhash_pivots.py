"""SimHash near-duplicates verified through pivot distance tables.

Fingerprints are 64-bit SimHashes of word shingles.  Equal fingerprints form a
class; classes meet in blocks of bit fields (``bits`` + 2 fields, of which two
must agree when at most ``bits`` bits differ).  The Hamming distances of each
different fingerprint to fixed reference fingerprints are worked out once and
travel with it as its row of the distance table.  In a block of any size a pair
whose rows differ by more than ``bits`` in some coordinate is discarded (the
triangle inequality), and an exact Hamming distance verifies the survivors.

Null and empty texts have fingerprint 0 and are linked like others.  Repeated
rows share their class.  Extra columns are ignored.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from revisit.llm.common import drop_staged, staged
from revisit.llm.linking import components, link_blocks


def fingerprint(text: str | None, shingle: int = 3) -> int:
    w = (text or "").encode("utf-8", "replace").lower().split()
    if not w:
        return 0
    grams = [b" ".join(w[i:i + shingle]) for i in range(max(len(w) - shingle + 1, 1))]
    h = np.array([xxhash.xxh64_intdigest(g, 42) for g in grams], dtype="<u8")
    ones = np.zeros(64, dtype=np.int64)
    for i in range(0, len(h), 65536):
        ones += np.unpackbits(h[i:i + 65536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view("<u8")[0])


def fingerprint_column(text: Column, shingle: int = 3) -> Column:
    @F.pandas_udf("long")
    def udf(s: pd.Series) -> pd.Series:
        return pd.Series(np.array([fingerprint(t, shingle) for t in s], dtype=np.uint64).view(np.int64))
    return udf(text)


def pivots(n: int) -> np.ndarray:
    return np.array([xxhash.xxh64_intdigest(f"pivot {i}", 0) for i in range(n)], dtype=np.uint64)


class near_by_pivots:
    """``near`` of a block of fingerprints: longs, whose distance table is made
    here, or rows of ``pivot_rows``.  Counts the pairs that it was asked for,
    those discarded by the table, and those verified."""

    def __init__(self, values: list, bits: int, n_pivots: int):
        self.bits, self.asked, self.discarded, self.verified = bits, 0, 0, 0
        if values and isinstance(values[0], bytes):
            raw = np.frombuffer(b"".join(values), dtype=np.uint8).reshape(len(values), -1)
            self.fp, self.table = raw[:, :8].copy().view(">u8")[:, 0].astype(np.uint64), raw[:, 8:].astype(np.int8)
        else:
            self.fp = np.array(values, dtype=np.int64).view(np.uint64)
            self.table = np.stack([np.bitwise_count(self.fp ^ p) for p in pivots(n_pivots)], axis=1).astype(np.int8)

    def __call__(self, u: int, rest: np.ndarray) -> np.ndarray:
        left = np.arange(len(rest))
        for k in range(0, self.table.shape[1], 4):
            left = left[(np.abs(self.table[rest[left], k:k + 4] - self.table[u, k:k + 4]) <= self.bits).all(axis=1)]
        hit = np.zeros(len(rest), dtype=bool)
        hit[left] = np.bitwise_count(self.fp[rest[left]] ^ self.fp[u]) <= self.bits
        self.asked, self.discarded, self.verified = self.asked + len(rest), self.discarded + len(rest) - len(left), self.verified + len(left)
        return hit


def pivot_rows(fp: Column, n_pivots: int) -> Column:
    """The 8 bytes of a fingerprint, then one byte a pivot with the distance to it."""
    signed = [int(np.int64(p.view(np.int64))) for p in pivots(n_pivots)]
    digits = [F.lpad(F.hex(fp), 16, "0")] + [F.lpad(F.hex(F.bit_count(fp.bitwiseXOR(F.lit(p)))), 2, "0") for p in signed]
    return F.unhex(F.concat(*digits))


def block_keys(fp: Column, bits: int) -> Column:
    """Each pair of the ``bits`` + 2 bit fields as one 64-bit block key."""
    n = bits + 2
    edge = [round(64 * i / n) for i in range(n + 1)]
    masks = [((1 << (b - a)) - 1) << a for a, b in zip(edge, edge[1:])]
    signed = lambda m: m - (1 << 64) if m >= 1 << 63 else m
    return F.array(*[F.xxhash64(F.lit(i), fp.bitwiseAND(F.lit(signed(masks[a] | masks[b]))))
                     for i, (a, b) in enumerate(combinations(range(n), 2))])


def simhash_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3,
                   bits: int = 3, n_pivots: int = 16) -> DataFrame:
    """(id, fp long, component) for every row of ``docs``; component is the
    smallest id reachable over links of at most ``bits`` differing bits."""
    prints = staged(docs.select(F.col(id_col).alias("id"), fingerprint_column(F.col(text_col), shingle).alias("fp")), "prints")
    classes = staged(prints.groupBy("fp").agg(F.min("id").alias("rep")).withColumn("row", pivot_rows(F.col("fp"), n_pivots)), "classes")
    rows = classes.select(F.explode(block_keys(F.col("fp"), bits)).alias("key"), F.col("fp").alias("node"), "row")
    several = rows.groupBy("key").agg(F.min("node").alias("x"), F.max("node").alias("y")).where("x <> y").select("key")
    rows = staged(rows.join(several, "key", "left_semi"), "blocks")
    comp = components(link_blocks(rows, "row", lambda v: near_by_pivots(v, bits, n_pivots)))
    drop_staged(rows)
    group = classes.join(comp, classes["fp"] == comp["node"], "left").withColumn("g", F.coalesce("component", "fp"))
    least = group.groupBy("g").agg(F.min("rep").alias("component_id"))
    label = group.join(least, "g").select("fp", "component_id")
    return prints.join(label, "fp").select("id", "fp", "component_id")
