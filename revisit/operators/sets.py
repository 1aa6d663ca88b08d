"""Set operations and equality checks between frames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def union_distinct(*dfs: DataFrame) -> DataFrame:
    out = dfs[0]
    for d in dfs[1:]:
        out = out.unionByName(d)
    return out.distinct()


def except_(a: DataFrame, b: DataFrame) -> DataFrame:
    """Distinct rows of ``a`` that are not in ``b`` (SQL EXCEPT)."""
    return a.subtract(b)


def same_keys(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """One row: distinct keys only in a, only in b, and whether the sets are
    equal.  One shuffle: both sides tagged, unioned and grouped by key."""
    tagged = a.select(F.col(key).alias("_k"), F.lit(1).alias("_side")).unionByName(
        b.select(F.col(key).alias("_k"), F.lit(2).alias("_side")))
    per_key = tagged.groupBy("_k").agg(F.min("_side").alias("_lo"), F.max("_side").alias("_hi"))
    return per_key.agg(F.count_if(F.col("_hi") == 1).alias("only_left"),
                       F.count_if(F.col("_lo") == 2).alias("only_right")).select(
        "only_left", "only_right",
        ((F.col("only_left") == 0) & (F.col("only_right") == 0)).alias("equal"))


def frame_difference(a: DataFrame, b: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows (with multiplicity) in a but not b, and in b but not a."""
    return a.exceptAll(b), b.exceptAll(a)


def assert_same(a: DataFrame, b: DataFrame) -> None:
    """Raise unless the two frames have the same schema and the same rows
    (order-insensitive, duplicates counted).  Runs as two distributed
    ``exceptAll`` jobs, not on the driver."""
    if a.schema.simpleString() != b.schema.simpleString():
        raise AssertionError(f"schemas differ: {a.schema.simpleString()} vs {b.schema.simpleString()}")
    left, right = frame_difference(a, b)
    extra = left.limit(1).collect() + right.limit(1).collect()
    if extra:
        raise AssertionError(f"frames differ, e.g. {extra[0]}")
