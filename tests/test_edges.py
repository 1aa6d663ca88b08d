"""Edge results: nulls, one class, empty input, line breaks, malformed lines."""

from pyspark.sql import functions as F

from revisit.ml import evaluate, features, models
from revisit.operators import profile
from revisit.sources.files import scan_csv, write_csv


def test_null_stays_out_of_bins(spark):
    df = spark.createDataFrame([(None,), (0.0,), (1.0,), (4.0,)], "v double")
    got = {r["v"]: r["bin"] for r in profile.equal_width_bins(df, "v", 4).collect()}
    assert got == {None: None, 0.0: 0, 1.0: 0, 4.0: 3}


def test_distinct_count_of_nothing(spark):
    df = spark.createDataFrame([], "v int")
    assert profile.n_distinct(df, "v").first()[0] == 0


def test_one_class_has_no_auc(spark):
    df = spark.createDataFrame([(1, 0.2), (1, 0.7)], "y int, s double")
    assert evaluate.roc_auc(df, "y", "s").first()["auc"] is None
    assert {r["fpr"] for r in evaluate.roc_points(df, "y", "s").where("threshold < 1").collect()} == {None}
    assert evaluate.at_threshold(df, "y", "s", 0.5).first()["specificity"] is None


def test_null_labels_are_a_class_in_the_split(spark):
    df = spark.range(40).select("id", F.when(F.col("id") % 4 > 0, (F.col("id") % 2).cast("int")).alias("y"))
    out = features.stratified_split(df, "id", "y", 0.5)
    assert {r["y"]: r["n"] for r in out.where("is_test = 1").groupBy("y").agg(F.count("*").alias("n")).collect()} == {
        None: 5, 0: 5, 1: 10}
    assert out.count() == 40


def test_class_weights_without_rows(spark):
    assert models.class_weights(spark.createDataFrame([], "y int"), "y").count() == 0


def test_line_break_survives_csv(spark, tmp_dir):
    df = spark.createDataFrame([(1, "a\nb"), (2, 'c "d", e')], "i int, t string")
    write_csv(df, f"{tmp_dir}/out")
    assert sorted(map(tuple, scan_csv(spark, f"{tmp_dir}/out", df.schema).collect())) == sorted(map(tuple, df.collect()))
