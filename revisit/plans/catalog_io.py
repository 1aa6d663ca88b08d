"""Catalog entries for sources, sinks, model persistence and streaming (§2.1,
§2.7 frame equality, §2.12).

Each query writes data derived from the driver tables to a fresh folder under
the shared checkpoint directory and reads it back; where the round trip must
reproduce a table exactly, the oracle is that table's SQL.
"""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F
from pyspark.sql import types as T

from revisit.ml import evaluate as EV
from revisit.ml import models as M
from revisit.operators import journey as JR
from revisit.operators import sets as ST
from revisit.plans import cohort as C
from revisit.plans.catalog import _b, query
from revisit.plans.catalog_ml import _split
from revisit.sources import files as IO
from revisit.streaming.scoring import score_stream

ADMISSIONS_SCHEMA = T.StructType([
    T.StructField("SUBJECT_ID", T.LongType()), T.StructField("HADM_ID", T.LongType()),
    T.StructField("ADMITTIME", T.TimestampNTZType()), T.StructField("DISCHTIME", T.TimestampNTZType()),
    *[T.StructField(c, T.StringType()) for c in ("ADMISSION_TYPE", "ADMISSION_LOCATION", "DISCHARGE_LOCATION",
                                                  "INSURANCE", "RELIGION", "MARITAL_STATUS", "ETHNICITY")]])

PATIENTS_SCHEMA = T.StructType([T.StructField("SUBJECT_ID", T.LongType()), T.StructField("GENDER", T.StringType()),
                                T.StructField("DOB", T.TimestampNTZType())])


@query("scan_csv_gz", "SELECT * FROM admissions", "admissions")
def q_scan_gz(spark, d):
    path = IO.write_csv(_b(spark, d, "admissions"), IO.scratch_path(spark, "admissions"), "gzip")
    return IO.scan_csv(spark, path, ADMISSIONS_SCHEMA)


@query("scan_csv_plain", "SELECT * FROM patients", "patients")
def q_scan_plain(spark, d):
    path = IO.write_csv(_b(spark, d, "patients"), IO.scratch_path(spark, "patients"))
    return IO.scan_csv(spark, path, PATIENTS_SCHEMA)


@query("sink_csv", """
SELECT SUBJECT_ID, HADM_ID, ROUND(DAYS_TO_READMISSION, 6) AS DAYS_TO_READMISSION, NO_OF_SURGERIES,
       ADMISSION_TYPE, GENDER FROM enriched""", "enriched")
def q_sink_csv(spark, d):
    e = C.enriched(spark, d).select("SUBJECT_ID", "HADM_ID", F.round("DAYS_TO_READMISSION", 6)
                                    .alias("DAYS_TO_READMISSION"), "NO_OF_SURGERIES", "ADMISSION_TYPE", "GENDER")
    path = IO.write_csv(e, IO.scratch_path(spark, "dataset"))
    return IO.scan_csv(spark, path, e.schema)


@query("sink_csv_columns", """
WITH e AS (SELECT vec_id, CAST(label < 5 AS INTEGER) AS y FROM embeddings),
r AS (SELECT vec_id, ROW_NUMBER() OVER (PARTITION BY y ORDER BY md5('2017:' || CAST(vec_id AS VARCHAR)), vec_id) AS rn,
             COUNT(*) OVER (PARTITION BY y) AS n FROM e)
SELECT vec_id FROM r WHERE rn <= ROUND(n * 0.25)""")
def q_sink_ids(spark, d):
    ids = _split(spark, d).where("is_test = 1").select("vec_id")
    path = IO.write_csv(ids, IO.scratch_path(spark, "test-ids"))
    return IO.scan_csv(spark, path, ids.schema)


@query("json_records_write", """
SELECT CAST(to_json(struct_pack(HADM_ID := HADM_ID, DRG_SEVERITY := ROUND(DRG_SEVERITY, 6),
                                DRG_MORTALITY := ROUND(DRG_MORTALITY, 6))) AS VARCHAR) AS json
FROM drg_means""", "drg_means")
def q_json_write(spark, d):
    m = C.drg_means(spark, d)
    return IO.to_json_records(m.select("HADM_ID", *[F.round(c, 6).alias(c) for c in ("DRG_SEVERITY",
                                                                                  "DRG_MORTALITY")]))


@query("json_records_read", "SELECT SUBJECT_ID, GENDER FROM patients", "patients")
def q_json_read(spark, d):
    # batches of at most 16 records (ids are unique), each a JSON array dumped
    # once more as a JSON string: JSON inside JSON, as the scoring client sends
    p = _b(spark, d, "patients").select("SUBJECT_ID", "GENDER")
    batches = p.groupBy(F.floor(F.col("SUBJECT_ID") / 16).alias("batch")).agg(
        IO.dump_json_string(F.to_json(F.collect_list(F.struct("SUBJECT_ID", "GENDER")))).alias("payload"))
    schema = T.StructType([T.StructField("SUBJECT_ID", T.LongType()), T.StructField("GENDER", T.StringType())])
    return IO.from_json_records(batches, "payload", schema, nested_string=True)


def _pipeline(spark, d):
    split = _split(spark, d)
    model = Pipeline(stages=[M.random_forest(trees=20, depth=5, max_features=8)]).fit(split.where("is_test = 0"))
    return split, model


@query("model_save_load")
def q_save_load(spark, d):
    split, model = _pipeline(spark, d)
    path = IO.scratch_path(spark, "model")
    M.save_model(model, path)
    again, test = M.load_model(path), split.where("is_test = 1")
    first = EV.score_batch(model, test, keep=["vec_id"]).withColumnRenamed("p1", "fitted_p1").drop("prediction")
    # a row fails whose score is not that of the model before it was saved
    same = F.when(F.col("p1") == F.col("fitted_p1"), F.col("p1")).otherwise(F.raise_error(F.lit("a reloaded score differs")).cast("double"))
    return EV.score_batch(again, test, keep=["vec_id", "y"]).join(first, "vec_id").withColumn("p1", same).drop("fitted_p1")


@query("score_stream")
def q_stream(spark, d):
    split, model = _pipeline(spark, d)
    test = split.where("is_test = 1")
    feats = [f"e{i}" for i in range(64)]
    records = test.select("vec_id", *[F.col("embedding")[i].cast("double").alias(f"e{i}") for i in range(64)])
    in_dir = IO.scratch_path(spark, "stream-in")
    # posted as the clients do: arrays of a few records, dumped to a JSON string once more
    posted = records.groupBy(F.expr("vec_id div 100")).agg(F.to_json(F.collect_list(F.struct(*records.columns))).alias("p"))
    posted.select(IO.dump_json_string(F.col("p"))).write.text(in_dir)
    # the served model takes named columns: assemble them in front of the forest
    served_model = PipelineModel(stages=[VectorAssembler(inputCols=feats, outputCol="features"),
                                         *model.stages])
    model_path = IO.scratch_path(spark, "served-model")
    M.save_model(served_model, model_path)
    out_dir, ckpt = IO.scratch_path(spark, "stream-out"), IO.scratch_path(spark, "stream-ckpt")
    q = score_stream(spark, in_dir, records.schema, model_path, "vec_id", feats, out_dir, ckpt)
    q.awaitTermination()
    return spark.read.parquet(out_dir)


@query("frame_equality", """
WITH s AS (SELECT SUBJECT_ID, HADM_ID, ADMITTIME, DISCHTIME,
                  ROW_NUMBER() OVER (PARTITION BY SUBJECT_ID ORDER BY ADMITTIME ASC NULLS LAST,
                                     HADM_ID ASC NULLS LAST) AS SEQUENCE FROM admissions),
by_join AS (SELECT a.SUBJECT_ID, a.HADM_ID, a.DISCHTIME AS CURR_DISCHTIME, b.ADMITTIME AS NXT_ADMITTIME
            FROM s a JOIN s b ON a.SUBJECT_ID = b.SUBJECT_ID AND a.SEQUENCE = b.SEQUENCE - 1),
by_lead AS (SELECT SUBJECT_ID, HADM_ID, CURR_DISCHTIME, NXT_ADMITTIME FROM (
              SELECT SUBJECT_ID, HADM_ID, DISCHTIME AS CURR_DISCHTIME, LEAD(ADMITTIME) OVER w AS NXT_ADMITTIME,
                     LEAD(HADM_ID) OVER w AS NXT_ID FROM admissions
              WINDOW w AS (PARTITION BY SUBJECT_ID ORDER BY ADMITTIME ASC NULLS LAST, HADM_ID ASC NULLS LAST))
            WHERE NXT_ID IS NOT NULL)
SELECT (SELECT COUNT(*) FROM (SELECT * FROM by_lead EXCEPT ALL SELECT * FROM by_join))
     + (SELECT COUNT(*) FROM (SELECT * FROM by_join EXCEPT ALL SELECT * FROM by_lead)) AS n_differences""",
       "admissions")
def q_frame_eq(spark, d):
    adm = _b(spark, d, "admissions")
    by_lead = JR.next_event_gap(adm)
    by_join = JR.next_event_selfjoin(JR.sequence_events(adm, "SUBJECT_ID", ["ADMITTIME", "HADM_ID"]))
    left, right = ST.frame_difference(by_lead, by_join.select(*by_lead.columns))
    return left.unionByName(right).agg(F.count(F.lit(1)).alias("n_differences"))
