"""Corpus pipeline: quality rules, line dedup, near-dedup, decontamination and
packing, each written as Parquet and read back as the next stage's documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from revisit.llm.common import staged, table
from revisit.llm.curve_packing import TOKENIZER, pack
from revisit.llm.decontaminate import decontaminate, without_spans
from revisit.llm.line_edits import dedup_lines
from revisit.llm.quality_rules import quality_rules as judge_quality
from revisit.llm.queries import tokenizer_path
from revisit.llm.simhash_pivots import simhash_groups

#: A document with a larger share of hit words goes; others lose the spans.
MAX_COVERAGE = 0.5


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep.  Null and empty texts go, for they
    have too few words; repeated rows share a verdict; null ids are never
    trusted; an empty table stays empty."""
    out = judge_quality(docs, table(spark, sf_dir, "labels").where("quality = 1"), out="__rules")
    return out.where("__rules.kept").select(docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, later copies and near copies of lines cut from their texts.
    Null texts stay null; rows that repeat id and text count as one document,
    different texts under one or a null id as different ones; of equal lines the
    one of the least (id, text hash, line number) stays."""
    return _counted(dedup_lines(docs, copy_chars=1), docs)


def simhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each component: the least (id, text hash).  Rows that repeat
    both are one; null ids and different texts under one id are documents of
    their own; null and empty texts have fingerprint 0 and form one group."""
    keyed = docs.withColumn("__row", F.struct(F.col("doc_id"), F.xxhash64("text").alias("h")))
    first = simhash_groups(keyed, "__row").select(F.col("component_id").alias("__first")).distinct()
    kept = keyed.join(first, F.col("__row") == F.col("__first"), "left_semi").dropDuplicates(["__row"])
    return kept.select(docs.columns)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows with at most ``MAX_COVERAGE`` of their words hit, the hit spans cut
    out.  Null texts have no words and stay; rows are judged one by one."""
    out = decontaminate(docs, table(spark, sf_dir, "benchmark"), out="__leak")
    out = out.where(F.col("__leak.n_hit") <= MAX_COVERAGE * F.col("__leak.n_words"))
    return _counted(out.withColumn("text", without_spans(F.col("text"), F.col("__leak.spans"))), docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the packed sequences; a null text has the end token alone,
    a repeated row pieces of its own."""
    return pack(docs, tokenizer_path(TOKENIZER), cache_words=200_000)


def _counted(out: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of ``docs`` with n_chars brought up to date."""
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(docs.columns)


STAGES = [("quality_rules", quality_rules), ("line_dedup", line_dedup), ("simhash_dedup", simhash_dedup),
          ("benchmark_decontamination", benchmark_decontamination), ("packing", packing)]

#: SimHash bits, edit distances and tokens are not expressible in DuckDB SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir), name)
    return docs
