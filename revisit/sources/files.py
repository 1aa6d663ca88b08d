"""File sources and sinks: CSV (plain or gzip), JSON records, scratch paths.

Paths for intermediate files are placed under the checkpoint folder the
cluster names (``spark.checkpoint.dir``), never in a machine-local temp dir.
"""

from __future__ import annotations

import uuid

from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from revisit.session import checkpoint_dir

_OVERFLOW = "_overflow"


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder under the shared checkpoint directory."""
    return f"{checkpoint_dir(spark)}/revisit-io/{name}-{uuid.uuid4().hex}"


def scan_csv(spark: SparkSession, path: str, schema: T.StructType, limit: int | None = None,
             order: list[str] | None = None, partitions: int | None = None,
             multi_line: bool = True) -> DataFrame:
    """Header CSV (plain or .gz) with an explicit schema.

    Rows with too many fields are dropped; rows with too few are kept with
    nulls.  The schema gets one extra trailing string column: in PERMISSIVE
    mode a surplus field lands there, so ``overflow IS NULL`` keeps exactly
    the rows that fit.  A quoted field may hold line breaks
    (``multi_line``; turn it off for large plain files without them, which
    then split).  A gzip or multi-line file is one split, so the result of a
    gzip file is repartitioned before further work."""
    wide = T.StructType(list(schema.fields) + [T.StructField(_OVERFLOW, T.StringType())])
    df = (spark.read.schema(wide).option("header", True).option("quote", '"').option("escape", '"')
          .option("mode", "PERMISSIVE").option("multiLine", multi_line).csv(path))
    df = df.where(F.col(_OVERFLOW).isNull()).drop(_OVERFLOW)
    if path.endswith(".gz") or partitions:
        df = df.repartition(partitions or int(spark.conf.get("spark.sql.shuffle.partitions")))
    if limit is not None:
        if not order:
            raise ValueError("a row limit needs an explicit order")
        df = df.orderBy(*order).limit(limit)
    return df


def ingest_csv(spark: SparkSession, path: str, schema: T.StructType, out: str,
               partitions: int | None = None) -> DataFrame:
    """Scan a (gzip) CSV once with ``scan_csv`` and keep it as parquet at
    ``out``: later reads are columnar, splittable and pushdown-capable instead
    of re-decompressing one unsplittable file."""
    scan_csv(spark, path, schema, partitions=partitions).write.mode("overwrite").parquet(out)
    return spark.read.parquet(out)


def flatten_vectors(df: DataFrame) -> DataFrame:
    """ML vectors to arrays (CSV/JSON cannot hold a vector type)."""
    return df.select(*[vector_to_array(f.name).alias(f.name) if isinstance(f.dataType, VectorUDT)
                       else F.col(f.name) for f in df.schema.fields])


def write_csv(df: DataFrame, path: str, compression: str | None = None) -> str:
    """Header CSV folder (one file per partition); arrays become JSON text."""
    flat = flatten_vectors(df)
    flat = flat.select(*[F.to_json(f.name).alias(f.name) if isinstance(f.dataType, (T.ArrayType, T.MapType,
                                                                                   T.StructType))
                         else F.col(f.name) for f in flat.schema.fields])
    w = flat.write.mode("overwrite").option("header", True).option("escape", '"')
    if compression:
        w = w.option("compression", compression)
    w.csv(path)
    return path


def to_json_records(df: DataFrame, out: str = "json") -> DataFrame:
    """One JSON object per row (the record form of a batch)."""
    return flatten_vectors(df).select(F.to_json(F.struct("*")).alias(out))


def write_json(df: DataFrame, path: str) -> str:
    flatten_vectors(df).write.mode("overwrite").json(path)
    return path


def from_json_records(df: DataFrame, col: str, schema: T.StructType, nested_string: bool = False) -> DataFrame:
    """A column holding a JSON array of records → one row per record.  With
    ``nested_string`` the array was itself dumped to a JSON string first."""
    c = F.col(col)
    if nested_string:  # a JSON string literal: decode it as the one element of an array
        c = F.from_json(F.concat(F.lit("["), c, F.lit("]")), T.ArrayType(T.StringType()))[0]
    arr = F.from_json(c, T.ArrayType(schema))
    return df.select(F.explode(arr).alias("_r")).select("_r.*")


def dump_json_string(c) -> F.Column:
    """A string column as a JSON string literal (the text dumped once more)."""
    enc = F.to_json(F.array(c))  # '["…"]' with the text escaped
    return F.substring(enc, F.lit(2), F.length(enc) - 2)
