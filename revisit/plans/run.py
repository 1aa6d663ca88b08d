"""End-to-end run of the readmission analysis, as a job.

    python -m revisit.plans.run --data /path/to/tables --out /shared/folder [--days 30]
    python -m revisit.plans.run --csv /path/to/exported/csv.gz --out /shared/folder

Writes, under ``--out``:
  dataset/           the modelling table (parquet)
  dataset_csv/       the same as header CSV (the export the analysis hands on)
  train_ids/, test_ids/   admission ids of each side of the split (CSV)
  model/             the fitted Spark ML pipeline
  test_scores/       id, label, predicted class, P(readmission) (parquet)
  metrics/           AUC, accuracy and the confusion matrix (JSON lines)
Everything is written by Spark from the executors; nothing but the metrics
passes through the driver.
"""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from revisit.ml import evaluate as EV
from revisit.ml import features as FE
from revisit.ml import models as M
from revisit.plans.cohort import enriched, final_dataset
from revisit.plans.model import feature_columns, readmission_pipeline
from revisit.session import keep, release_intermediates
from revisit.sources import files as IO


def run(spark: SparkSession, data: str, out: str, days: int = 30, trees: int = 250,
        seed: int = M.SEED) -> DataFrame:
    from revisit.functions.scalar import label_within
    target = f"READMISSION_{days}dAYS"
    base = keep(enriched(spark, data))
    labelled = base.select("HADM_ID", label_within("DAYS_TO_READMISSION", days).alias(target))
    split = keep(FE.stratified_split(labelled, "HADM_ID", target, 0.25, seed))
    train_rows = base.join(split.where("is_test = 0").select("HADM_ID"), "HADM_ID", "left_semi")
    dataset = keep(final_dataset(spark, data, base=base, fit_on=train_rows)
                   .join(split.select("HADM_ID", "is_test"), "HADM_ID"))
    dataset.write.mode("overwrite").parquet(f"{out}/dataset")
    IO.write_csv(dataset, f"{out}/dataset_csv")
    IO.write_csv(split.where("is_test = 0").select("HADM_ID"), f"{out}/train_ids")
    IO.write_csv(split.where("is_test = 1").select("HADM_ID"), f"{out}/test_ids")

    data_ml = dataset.withColumn("label", F.col(target).cast("double"))
    model = readmission_pipeline(feature_columns(dataset), trees=trees, seed=seed).fit(
        data_ml.where("is_test = 0"))
    M.save_model(model, f"{out}/model")
    scores = EV.score_batch(model, data_ml.where("is_test = 1"), keep=["HADM_ID", target])
    scores.write.mode("overwrite").parquet(f"{out}/test_scores")
    scores = spark.read.parquet(f"{out}/test_scores")
    auc = EV.roc_auc(scores, target, "p1").select(F.lit("roc_auc").alias("metric"), F.col("auc").alias("value"),
                                                  F.lit(None).cast("int").alias("actual"),
                                                  F.lit(None).cast("int").alias("predicted"))
    acc = EV.accuracy(scores, target, "prediction").select(
        F.lit("accuracy").alias("metric"), F.col("accuracy").alias("value"),
        F.lit(None).cast("int").alias("actual"), F.lit(None).cast("int").alias("predicted"))
    cm = EV.confusion(scores, target, "prediction").select(
        F.lit("confusion").alias("metric"), F.col("count").cast("double").alias("value"), "actual", "predicted")
    metrics = auc.unionByName(acc).unionByName(cm)
    metrics.coalesce(1).write.mode("overwrite").json(f"{out}/metrics")
    release_intermediates()
    return spark.read.json(f"{out}/metrics")


def main() -> None:
    ap = argparse.ArgumentParser(description=__doc__.split("\n")[0])
    ap.add_argument("--data", help="folder with the source tables (<name>.parquet)")
    ap.add_argument("--csv", help="folder with the exported gzip CSV files; ingested to <out>/tables first")
    ap.add_argument("--out", required=True, help="shared output folder")
    ap.add_argument("--days", type=int, default=30)
    ap.add_argument("--trees", type=int, default=250)
    ap.add_argument("--master", help="only for local runs; a cluster submit sets it")
    args = ap.parse_args()
    builder = SparkSession.builder.appName("revisit-readmission")
    if args.master:
        builder = builder.master(args.master).config("spark.ui.enabled", "false")
    spark = builder.getOrCreate()
    data = args.data
    if args.csv:
        from revisit.sources.schemas import ingest_sources
        data = f"{args.out}/tables"
        ingest_sources(spark, args.csv, data)
    if not data:
        ap.error("give --data or --csv")
    run(spark, data, args.out, args.days, args.trees).show(truncate=False)


if __name__ == "__main__":
    main()
