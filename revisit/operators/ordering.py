"""Sorts and top-k.  ``orderBy(...).limit(k)`` plans as TakeOrderedAndProject:
each task keeps its own k best rows and only those are merged."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def sort_multi(df: DataFrame, cols: Sequence[str], ascending: bool = True) -> DataFrame:
    return df.orderBy(*[(F.col(c).asc_nulls_last() if ascending else F.col(c).desc_nulls_last())
                        for c in cols])


def head_rows(df: DataFrame, n: int, order: Sequence[str]) -> DataFrame:
    """First n rows by an explicit order (row order is undefined otherwise)."""
    return df.orderBy(*[F.col(c).asc_nulls_last() for c in order]).limit(n)


def top_k(df: DataFrame, score: str, k: int, tiebreak: Sequence[str] = ()) -> DataFrame:
    """k rows with the highest ``score``; ties broken by ``tiebreak`` ascending."""
    return df.orderBy(F.col(score).desc_nulls_last(),
                      *[F.col(c).asc_nulls_last() for c in tiebreak]).limit(k)
