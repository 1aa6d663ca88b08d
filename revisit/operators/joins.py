"""Joins used to enrich and check cohorts.

Spark picks broadcast or sort-merge joins from statistics and AQE re-plans at
run time (and splits skewed sort-merge partitions); nothing here forces a
broadcast.  Keys use SQL equality: null keys never match.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def enrich(df: DataFrame, dim: DataFrame, on: str | Sequence[str],
           cols: Sequence[str] | None = None) -> DataFrame:
    """Left join of attribute columns from ``dim``."""
    keys = [on] if isinstance(on, str) else list(on)
    right = dim.select(*keys, *[c for c in (cols or dim.columns) if c not in keys])
    return df.join(right, keys, "left")


def enrich_all(df: DataFrame, dims: Sequence[tuple[DataFrame, str | Sequence[str], Sequence[str] | None]]) -> DataFrame:
    """Chain of left joins.  Each dimension must be unique on its key or the
    chain would multiply rows; ``assert_unique_keys`` checks that."""
    for dim, on, cols in dims:
        df = enrich(df, dim, on, cols)
    return df


def assert_unique_keys(dim: DataFrame, on: str | Sequence[str]) -> None:
    keys = [on] if isinstance(on, str) else list(on)
    dup = dim.groupBy(*keys).count().where("count > 1").limit(1).collect()
    if dup:
        raise ValueError(f"dimension is not unique on {keys}: {dup[0]}")


def join_suffix(a: DataFrame, b: DataFrame, on: Sequence[str],
                suffixes: tuple[str, str] = ("_x", "_y")) -> DataFrame:
    """Inner join on several keys; a column present on both sides comes out
    twice, with the given suffixes."""
    clash = [c for c in a.columns if c in b.columns and c not in on]
    a2 = a.withColumnsRenamed({c: c + suffixes[0] for c in clash})
    b2 = b.withColumnsRenamed({c: c + suffixes[1] for c in clash})
    return a2.join(b2, list(on), "inner")


def semi(df: DataFrame, other: DataFrame, on: str | Sequence[str]) -> DataFrame:
    """Rows of ``df`` whose key occurs in ``other`` (``IN (SELECT …)``)."""
    return df.join(other, on, "left_semi")


def missing_keys(a: DataFrame, b: DataFrame, on: str | Sequence[str]) -> DataFrame:
    """Keys of ``a`` that are not in ``b``."""
    keys = [on] if isinstance(on, str) else list(on)
    return a.select(*keys).join(b.select(*keys), keys, "left_anti")


def zip_by_key(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Side-by-side columns of two frames, aligned on an explicit key (rows
    carry their id through scoring instead of relying on row position)."""
    return left.join(right, key, "inner")


def count_joined(a: DataFrame, b: DataFrame, on: str) -> DataFrame:
    """Inner equi-join keeping ``a``'s columns and ``b``'s non-key columns."""
    return a.join(b, on, "inner")


def distinct_keys(df: DataFrame, key: str) -> DataFrame:
    return df.select(key).where(F.col(key).isNotNull()).distinct()
