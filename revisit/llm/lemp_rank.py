"""Ranked lexical search by norm buckets (LEMP).

A document is a sparse vector of impacts, weight times term-frequency part per
query term, and an item the 0/1 vector of its terms; the score is their inner
product.  Impact vectors are range-sorted by length into buckets.  A bucket is
skipped for an item when its longest vector cannot reach the item's k-th best
score so far (Cauchy-Schwarz); inside a bucket the item's focus coordinates, its
heaviest terms, bound each vector: their exact part plus Cauchy-Schwarz on the
rest (C. Teflioudi, R. Gemulla, O. Mykytiuk, LEMP: fast retrieval of large
entries in a matrix product, 2015).  Bounds are doubles with a slack; the
survivors are scored exactly in 64-bit integers.

The first range partition, the longest vectors, is searched first; its k-th best
scores, one number an item, are the thresholds that all others start from.

Null texts have no terms.  Items that share an id are one item with the terms
of all; an item without terms gets no rows.  Repeated documents are ranked as
rows of their own, equal scores by ascending id, null ids first.  Empty tables
give no rows; extra columns are ignored.  Items are dealt into blocks of about ``max_terms``
terms, one search each, so that what the tasks hold of them is bounded.
"""

from __future__ import annotations

import math
from collections import Counter
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from revisit.llm.common import drop_staged, staged

SLACK = 1e-9
#: Stands for a null document id while documents are ranked.
NO_ID = -(1 << 63)
#: Documents of a bucket at most.
BUCKET = 2048
#: Bytes to lower-cased term bytes; all else separates.
TERM_BYTES = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))
FOUND = "item int, doc_id long, score long"


def terms(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "replace").translate(TERM_BYTES).split(b" ") if text else []


def item_terms(items: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, terms array<binary>) of each item with a term."""
    @F.pandas_udf("array<binary>")
    def udf(s: pd.Series) -> pd.Series:
        return s.map(lambda t: sorted(set(terms(t)) - {b""}))
    rows = items.select(F.col(id_col).alias("id"), F.explode(udf(F.col(text_col))).alias("t"))
    return rows.groupBy("id").agg(F.sort_array(F.collect_set("t")).alias("terms"))


def postings(docs: DataFrame, vocabulary: dict[bytes, int], id_col: str, text_col: str) -> DataFrame:
    """(doc_id, n, term array<int>, tf array<long>) of every document; ``n``
    counts all its terms, the arrays hold those of the vocabulary."""
    def count(text: Column) -> Column:
        @F.pandas_udf("n long, term array<int>, tf array<long>")
        def udf(s: pd.Series) -> pd.DataFrame:
            out = []
            for text in s:
                all_terms = Counter(terms(text))
                blank = all_terms.pop(b"", 0)
                met = [(vocabulary[t], c) for t, c in all_terms.items() if t in vocabulary]
                out.append((all_terms.total(), [t for t, _ in met], [c for _, c in met]))
            return pd.DataFrame(out, columns=["n", "term", "tf"])
        return udf(text)
    key = F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID))
    return docs.select(key.alias("doc_id"), count(F.col(text_col)).alias("p")).select("doc_id", "p.*")


def impacts(weight: np.ndarray, term: np.ndarray, tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Integer impact of each posting, ``m`` given per posting."""
    return weight[term] * ((1_000_000_000 * tf) // (1000 * tf + 20 * m))


class Ranker:
    """The k best documents of each item over buckets met one after another."""

    def __init__(self, items: list[np.ndarray], weight: np.ndarray, k: int, floors: np.ndarray, focus: int):
        heavy = lambda t: t[np.lexsort((t, -weight[t]))]
        self.items, self.k = [heavy(t) for t in items], k
        self.focus = [t[:max(1, math.ceil(len(t) / focus))] for t in self.items]
        self.floor = floors.copy()
        self.score = [np.zeros(0, dtype=np.int64) for _ in items]
        self.doc = [np.zeros(0, dtype=np.int64) for _ in items]
        #: (item, bucket) pairs skipped, vectors bounded away inside, vectors scored
        self.counts = np.zeros(3, dtype=np.int64)

    def bucket(self, doc: np.ndarray, length: np.ndarray, row: np.ndarray, term: np.ndarray, impact: np.ndarray) -> None:
        """Take in one bucket: documents, their squared vector lengths, and
        postings (row of the bucket, term, impact)."""
        order = np.argsort(term, kind="stable")
        row, impact = row[order], impact[order]
        held, first = np.unique(term[order], return_index=True)
        last = np.append(first[1:], len(order))
        where = {t: (a, b) for t, a, b in zip(held.tolist(), first.tolist(), last.tolist())}
        longest = math.sqrt(length.max(initial=0.0))

        def add(part: np.ndarray, into: np.ndarray, squares: np.ndarray | None) -> None:
            for t in part.tolist():
                a, b = where.get(t, (0, 0))
                into[row[a:b]] += impact[a:b]  # a document holds a term once
                if squares is not None:
                    squares[row[a:b]] += np.square(impact[a:b].astype(np.float64))

        for i, own in enumerate(self.items):
            floor = self.floor[i]
            if math.sqrt(len(own)) * longest * (1 + SLACK) < floor:
                self.counts[0] += 1
                continue
            total, squares = np.zeros(len(doc), dtype=np.int64), np.zeros(len(doc))
            add(self.focus[i], total, squares)
            rest = len(own) - len(self.focus[i])
            bound = total + np.sqrt(rest * np.maximum(length - squares * (1 - SLACK), 0.0))
            left = np.flatnonzero(bound * (1 + SLACK) >= max(floor, 1))
            self.counts[1:] += len(doc) - len(left), len(left)
            if not len(left):
                continue
            add(own[len(self.focus[i]):], total, None)
            left = left[(total[left] > 0) & (total[left] >= floor)]
            self._keep(i, total[left], doc[left])

    def _keep(self, i: int, score: np.ndarray, doc: np.ndarray) -> None:
        score, doc = np.concatenate([self.score[i], score]), np.concatenate([self.doc[i], doc])
        best = np.lexsort((doc, -score))[:self.k]
        self.score[i], self.doc[i] = score[best], doc[best]
        if len(best) == self.k:
            self.floor[i] = max(self.floor[i], int(score[best[-1]]))

    def found(self) -> pa.RecordBatch:
        item = np.repeat(np.arange(len(self.items), dtype=np.int32), [len(s) for s in self.score])
        return pa.RecordBatch.from_arrays([pa.array(item), pa.array(np.concatenate([np.zeros(0, dtype=np.int64), *self.doc])),
                                           pa.array(np.concatenate([np.zeros(0, dtype=np.int64), *self.score]))],
                                          ["item", "doc_id", "score"])


def _unpack(b: pa.RecordBatch, value: str):
    """(row, term, value) of each posting of a batch."""
    term = b.column("term")
    return np.repeat(np.arange(len(b)), np.diff(term.offsets.to_numpy())), term.flatten().to_numpy(), b.column(value).flatten().to_numpy()


def _search_block(docs: DataFrame, names: list[list[bytes]], k: int, id_col: str, text_col: str, focus: int) -> DataFrame:
    """(item, doc_id, score): for each item, by its place in ``names``, rows
    that include its k best documents."""
    vocabulary = {t: i for i, t in enumerate(sorted(set().union(*names)))}
    items = [np.array([vocabulary[t] for t in own], dtype=np.int64) for own in names]
    held = staged(postings(docs, vocabulary, id_col, text_col), "postings")
    n_docs, n_terms = held.agg(F.coalesce(F.sum((F.col("n") > 0).cast("long")), F.lit(0)), F.coalesce(F.sum("n"), F.lit(0))).first()
    df = np.zeros(len(vocabulary), dtype=np.int64)
    for r in held.select(F.explode("term").alias("t")).groupBy("t").count().collect():  # at most the vocabulary
        df[r["t"]] = r["count"]
    weight = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * int(d) + 1))) for d in df], dtype=np.int64)

    def measure(batches):
        for b in batches:
            row, term, tf = _unpack(b, "tf")
            m = 50 + (50 * n_docs * b.column("n").to_numpy()) // max(n_terms, 1)
            value = impacts(weight, term, tf, m[row])
            length = np.bincount(row, np.square(value.astype(np.float64)), len(b))
            offsets = b.column("term").offsets.to_numpy()
            lists = lambda x, t: pa.ListArray.from_arrays(pa.array(offsets - offsets[0], pa.int32()), pa.array(x, t))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(length), lists(term, pa.int32()), lists(value, pa.int64())],
                                             ["doc_id", "length", "term", "impact"])

    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    vectors = held.where(F.size("term") > 0).mapInArrow(measure, "doc_id long, length double, term array<int>, impact array<long>")
    salt = F.xxhash64("doc_id", "length")  # equal lengths, as of copies, are dealt over buckets
    vectors = staged(vectors.repartitionByRange(parts, F.desc("length"), salt).sortWithinPartitions(F.desc("length"), salt)
                     .withColumn("part", F.spark_partition_id()), "impacts")
    drop_staged(held)

    def rank(floors):
        def batches(rows):
            ranker = Ranker(items, weight, k, floors, focus)
            for batch in rows:
                for at in range(0, len(batch), BUCKET):
                    b = batch.slice(at, BUCKET)
                    ranker.bucket(b.column("doc_id").to_numpy(), b.column("length").to_numpy(), *_unpack(b, "impact"))
            yield ranker.found()
        return batches

    none = np.zeros(len(items), dtype=np.int64)
    head = staged(vectors.where("part = 0").mapInArrow(rank(none), FOUND), "head")
    floors = none.copy()
    kth = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score")))
    for r in head.select("item", "score", kth.alias("n")).where(F.col("n") == k).collect():  # one row an item of the block
        floors[r["item"]] = r["score"]
    return head.union(vectors.where("part > 0").mapInArrow(rank(floors), FOUND))


def search(docs: DataFrame, items: DataFrame, k: int = 50, id_col: str = "doc_id", text_col: str = "text",
           item_id: str = "item_id", item_text: str = "text", max_terms: int = 500_000, focus: int = 2) -> DataFrame:
    """(item_id, rank, doc_id, score): each item's ``k`` best documents with a
    score above 0.  ``focus``: one focus coordinate for so many terms."""
    spark = docs.sparkSession
    asked = staged(item_terms(items, item_id, item_text), "items")
    total = asked.agg(F.coalesce(F.sum(F.size("terms")), F.lit(0))).first()[0]
    blocks, out = max(1, -(-total // max_terms)), []
    for at in range(blocks):
        rows = asked.where(F.pmod(F.xxhash64("id"), F.lit(blocks)) == at).select("id", "terms").collect()
        if rows:
            found = _search_block(docs, [[bytes(t) for t in r["terms"]] for r in rows], k, id_col, text_col, focus)
            ids = spark.createDataFrame([(i, r["id"]) for i, r in enumerate(rows)], f"item int, item_id {asked.schema['id'].dataType.simpleString()}")
            out.append((found, ids))
    if not out:
        return docs.limit(0).select(F.lit(None).cast(asked.schema["id"].dataType).alias("item_id"), F.lit(0).alias("rank"),
                                    F.lit(0).cast("long").alias("doc_id"), F.lit(0).cast("long").alias("score"))
    order = Window.partitionBy("item").orderBy(F.desc("score"), "doc_id")
    best = lambda f: f.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    doc = F.when(F.col("doc_id") != NO_ID, F.col("doc_id")).alias("doc_id")
    return reduce(DataFrame.union, [best(f).join(F.broadcast(ids), "item").select("item_id", "rank", doc, "score")
                                    for f, ids in out])
