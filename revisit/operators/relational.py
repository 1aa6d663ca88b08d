"""Projections, renames, filters, conditional updates, imputation, schema shaping."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def project(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return df.select(*cols)


def rename_all(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """Positional rename of every column."""
    return df.toDF(*names)


def rename(df: DataFrame, mapping: Mapping[str, str]) -> DataFrame:
    return df.withColumnsRenamed(dict(mapping))


def drop_columns(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return df.drop(*cols)


def filter_not_equal(c: str | Column, value) -> Column:
    """``c != value`` where a missing value counts as different (pandas NaN
    semantics), instead of SQL's unknown."""
    col = F.col(c) if isinstance(c, str) else c
    return ~col.eqNullSafe(F.lit(value))


def update_where(df: DataFrame, cond: Column, col: str, value) -> DataFrame:
    """Overwrite ``col`` with ``value`` on rows where ``cond`` holds."""
    v = value if isinstance(value, Column) else F.lit(value)
    return df.withColumn(col, F.when(cond, v).otherwise(F.col(col)))


def fill_const(df: DataFrame, values: Mapping[str, object]) -> DataFrame:
    return df.fillna(dict(values))


def fit_modes(df: DataFrame, cols: Sequence[str]) -> dict:
    """Most frequent non-null value per column; ties go to the smallest value.

    One pass for all columns of a type: (column, value) pairs are counted with
    a distributed group-by, then each column's winner is a partial ``min`` over
    (−count, value).  One row per column reaches the driver, whatever the
    cardinality."""
    modes: dict = {}
    by_type: dict[str, list[str]] = {}
    for c in cols:
        by_type.setdefault(df.schema[c].dataType.simpleString(), []).append(c)
    for group in by_type.values():
        pairs = df.select(F.explode(F.array(*[
            F.struct(F.lit(c).alias("c"), F.col(c).alias("v")) for c in group])).alias("p")).select("p.*")
        counts = pairs.where(F.col("v").isNotNull()).groupBy("c", "v").agg(F.count(F.lit(1)).alias("n"))
        best = counts.groupBy("c").agg(F.min(F.struct((-F.col("n")).alias("k"), F.col("v").alias("v"))).alias("m"))
        modes.update({r["c"]: r["v"] for r in best.select("c", "m.v").collect()})
    return {c: modes.get(c) for c in cols}


def fill_mode(df: DataFrame, cols: Sequence[str], fit_on: DataFrame | None = None) -> DataFrame:
    """Replace missing values with the column mode fitted on ``fit_on``."""
    modes = fit_modes(fit_on if fit_on is not None else df, cols)
    return df.fillna({c: v for c, v in modes.items() if v is not None})


def cast_columns(df: DataFrame, types: Mapping[str, str], strict: bool = False) -> DataFrame:
    """Cast columns; non-strict casts give null on bad input instead of failing."""
    return df.withColumns({c: (F.col(c).cast(t) if strict else F.col(c).try_cast(t))
                           for c, t in types.items()})


def columns_of_type(df: DataFrame, kind: type[T.DataType] | tuple) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, kind)]


def select_by_type(df: DataFrame, kind: type[T.DataType] | tuple) -> DataFrame:
    return df.select(*columns_of_type(df, kind))


def reorder(df: DataFrame, first: Sequence[str]) -> DataFrame:
    """Given columns first, then the rest by name."""
    rest = sorted(c for c in df.columns if c not in first)
    return df.select(*first, *rest)


def align_schema(df: DataFrame, keys: Sequence[str], vocab: Sequence[str], fill=0) -> DataFrame:
    """Keys, then exactly the vocabulary columns in vocabulary order: missing
    ones are added as ``fill``, columns outside the vocabulary are dropped."""
    have = set(df.columns)
    cols = [F.col(c) if c in have else F.lit(fill).alias(c) for c in vocab]
    return df.select(*keys, *cols)


def union_by_name(a: DataFrame, b: DataFrame) -> DataFrame:
    """Stack ``b`` under ``a``; columns missing on one side are null."""
    return a.unionByName(b, allowMissingColumns=True)
