"""Structured Streaming scoring: JSON records in, class per key out.

Each line of the input is a record, an array of records, or such an array dumped
to a JSON string once more (the form in which a client posts a batch).  One
stateless query reads every line once; each micro-batch is parsed, aligned to
the model's feature columns and scored with a saved ``PipelineModel``, and what
cannot be parsed goes to an output of its own.  A micro-batch's files carry its
number: a batch that runs again after a failure replaces its own files, so both
outputs hold every record exactly once.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark import StorageLevel
from pyspark.ml import PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from revisit.operators.relational import align_schema


def scored(model: PipelineModel, records: DataFrame, key: str, feature_cols: Sequence[str]) -> DataFrame:
    """The scoring transform shared by batch and stream."""
    aligned = align_schema(records, [key], list(feature_cols), fill=0.0)
    out = model.transform(aligned)
    return out.select(key, F.col("prediction").cast("int").alias("prediction"),
                      vector_to_array("probability")[1].alias("p1"))


def parsed(lines: DataFrame, schema: T.StructType) -> DataFrame:
    """(record struct, bad string) of each record in text column ``value``:
    ``bad`` holds the text of a record that does not fit ``schema``, or the whole
    line where it is no JSON.  Blank lines are no records."""
    line = F.trim("value")
    once = F.when(line.startswith('"'), F.from_json(F.concat(F.lit("["), line, F.lit("]")), T.ArrayType(T.StringType()))[0])
    text = lines.where(line != "").select(F.coalesce(once, line).alias("t"))
    many = F.when(F.ltrim("t").startswith("["), F.from_json("t", T.ArrayType(T.StringType())))
    one = text.select(F.explode(F.coalesce(many, F.array("t"))).alias("t"))
    wide = T.StructType([*schema.fields, T.StructField("_bad", T.StringType())])
    got = one.select("t", F.from_json("t", wide, {"columnNameOfCorruptRecord": "_bad"}).alias("r"))
    broken = F.col("r").isNull() | F.col("r._bad").isNotNull()
    return got.select(F.when(~broken, F.struct(*[F.col("r")[f.name].alias(f.name) for f in schema.fields])).alias("record"),
                      F.when(broken, F.coalesce("t", F.lit("null"))).alias("bad"))


def replace_batch(df: DataFrame, folder: str, batch: int, kind: str) -> None:
    """Write a micro-batch into ``folder`` under file names that begin with its
    number, in place of files that an earlier run of it left."""
    spark, name = df.sparkSession, f"batch-{batch:010d}-"
    hadoop = spark._jvm.org.apache.hadoop.fs
    df.write.mode("overwrite").format(kind).save(f"{folder}/_{name}new")
    top, new = hadoop.Path(folder), hadoop.Path(f"{folder}/_{name}new")
    fs = top.getFileSystem(spark._jsc.hadoopConfiguration())
    for f in fs.globStatus(hadoop.Path(f"{folder}/{name}*")) or []:
        fs.delete(f.getPath(), False)
    for i, f in enumerate(fs.globStatus(hadoop.Path(new, "part-*")) or []):
        ending = f.getPath().getName().split(".", 1)[-1]
        if not fs.rename(f.getPath(), hadoop.Path(top, f"{name}{i:05d}.{ending}")):
            raise OSError(f"could not move {f.getPath()}")
    fs.delete(new, True)


def score_stream(spark: SparkSession, in_dir: str, schema: T.StructType, model_path: str,
                 key: str, feature_cols: Sequence[str], out_dir: str, checkpoint: str,
                 available_now: bool = True, bad_dir: str | None = None, max_files: int = 1000):
    """Start the stream: JSON lines under ``in_dir`` → scores as parquet in
    ``out_dir``, unreadable records as text in ``bad_dir`` (``out_dir``-bad if
    none is named).  Returns the StreamingQuery, whose failure is the failure of
    either output.  A batch reads at most ``max_files`` files."""
    model = PipelineModel.load(model_path)
    bad_dir = bad_dir or f"{out_dir.rstrip('/')}-bad"

    def both(lines: DataFrame, batch: int) -> None:
        records = parsed(lines, schema).persist(StorageLevel.MEMORY_AND_DISK)
        try:
            replace_batch(scored(model, records.where("bad is null").select("record.*"), key, feature_cols), out_dir, batch, "parquet")
            replace_batch(records.where("bad is not null").select(F.col("bad").alias("value")), bad_dir, batch, "text")
        finally:
            records.unpersist()

    q = (spark.readStream.option("maxFilesPerTrigger", max_files).text(in_dir).select("value").writeStream
         .foreachBatch(both).option("checkpointLocation", checkpoint).outputMode("append"))
    return (q.trigger(availableNow=True) if available_now else q.trigger(processingTime="10 seconds")).start()
