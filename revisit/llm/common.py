"""Helpers shared by the text operators."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from revisit.session import checkpoint_dir

#: The white space that separates words in the query contracts: space, \t to \r.
SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def staged(df: DataFrame, label: str) -> DataFrame:
    """Write a frame as Parquet under ``spark.checkpoint.dir`` and read it back:
    lineage is cut by a shared file, so a lost executor costs no rerun."""
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.staged_path = path
    return out


def let(value: Column, body) -> Column:
    """Bind ``value`` once and use it inside higher-order functions; written
    inline, the optimizer may evaluate it again for every array element."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words(text: str | None) -> list[bytes]:
    """Words of a text as UTF-8 bytes; ``bytes.split`` cuts at exactly SPACE."""
    return text.encode("utf-8", "replace").split() if text else []


def drop_staged(df: DataFrame) -> None:
    """Delete the files of a frame that ``staged`` returned, once what was made
    of it is itself written."""
    spark = df.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(df.staged_path)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def finite(vector: Column) -> Column:
    """Whether no component of a vector is null, NaN or infinite."""
    return F.coalesce(F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))), F.lit(False))
