import numpy as np
import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from revisit.ml import evaluate as EV
from revisit.ml import features as FE
from revisit.ml import models as M


def blobs(spark, n=200, d=4, shift=3.0, minority_share=0.5, seed=1):
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        y = 1 if i < n * minority_share else 0
        x = rng.normal(shift * y, 1.0, d)
        rows.append((i, y, float(y), Vectors.dense(x.tolist())))
    from pyspark.ml.linalg import VectorUDT
    from pyspark.sql import types as T
    schema = T.StructType([T.StructField("id", T.LongType()), T.StructField("y", T.IntegerType()),
                           T.StructField("label", T.DoubleType()), T.StructField("features", VectorUDT())])
    return spark.createDataFrame(rows, schema)


@pytest.mark.parametrize("parts", [1, 4, 17])
def test_stratified_split_exact_and_partition_independent(spark, parts):
    df = spark.range(0, 1000).withColumn("y", (F.col("id") % 10 == 0).cast("int")).repartition(parts)
    out = FE.stratified_split(df, "id", "y", 0.25, 2017)
    counts = {(r.y, r.is_test): r["count"] for r in out.groupBy("y", "is_test").count().collect()}
    assert counts == {(0, 1): 225, (0, 0): 675, (1, 1): 25, (1, 0): 75}
    ids = sorted(r.id for r in out.where("is_test = 1").collect())
    ref = FE.stratified_split(spark.range(0, 1000).withColumn("y", (F.col("id") % 10 == 0).cast("int")),
                              "id", "y", 0.25, 2017)
    assert ids == sorted(r.id for r in ref.where("is_test = 1").collect())


def test_folds_balanced(spark):
    df = spark.range(0, 300).withColumn("y", (F.col("id") % 3 == 0).cast("int"))
    out = FE.fold_column(df, "id", "y", 10)
    per = {(r.y, r.fold): r["count"] for r in out.groupBy("y", "fold").count().collect()}
    assert set(per.values()) == {10, 20}


def test_standardize_population_stats(spark):
    df = spark.createDataFrame([(float(v), 3.0) for v in [1, 2, 3, 4, 10]], "a double, b double")
    z = FE.standardize(df, FE.fit_standardizer(df, ["a", "b"]))
    vals = np.array([r.a for r in z.collect()])
    assert vals.mean() == pytest.approx(0.0, abs=1e-12) and vals.std() == pytest.approx(1.0)
    assert {r.b for r in z.collect()} == {0.0}


def test_variance_filter_population(spark):
    df = spark.createDataFrame([(1.0, 0.0), (1.0, 0.1), (1.0, 0.0)], "a double, b double")
    assert FE.variance_filter(df, ["a", "b"], 0.001) == ["b"]


def test_auc_constant_perfect_and_bruteforce(spark):
    rng = np.random.default_rng(0)
    y = rng.integers(0, 2, 300)
    s = np.floor(rng.normal(y, 1.0) * 3)
    df = spark.createDataFrame([(int(a), float(b)) for a, b in zip(y, s)], "y int, s double")
    pos, neg = s[y == 1], s[y == 0]
    brute = np.mean([(p > q) + 0.5 * (p == q) for p in pos for q in neg])
    assert EV.roc_auc(df, "y", "s").first().auc == pytest.approx(brute)
    assert EV.roc_auc(df.withColumn("s", F.lit(1.0)), "y", "s").first().auc == pytest.approx(0.5)
    assert EV.roc_auc(df.withColumn("s", F.col("y").cast("double")), "y", "s").first().auc == pytest.approx(1.0)


def test_roc_points_monotone_and_end_at_one(spark):
    df = spark.createDataFrame([(i % 2, float(i % 7)) for i in range(100)], "y int, s double")
    pts = EV.roc_points(df, "y", "s").orderBy(F.col("threshold").desc()).collect()
    assert (pts[0].fpr, pts[0].tpr) == (0.0, 0.0) and (pts[-1].fpr, pts[-1].tpr) == (1.0, 1.0)
    assert all(a.fpr <= b.fpr and a.tpr <= b.tpr for a, b in zip(pts, pts[1:]))


def test_confusion_has_all_cells(spark):
    df = spark.createDataFrame([(1, 1), (1, 1)], "y int, p int")
    got = {(r.actual, r.predicted): r["count"] for r in EV.confusion(df, "y", "p").collect()}
    assert got == {(0, 0): 0, (0, 1): 0, (1, 0): 0, (1, 1): 2}


def test_soft_vote_between_inputs(spark):
    df = spark.createDataFrame([(0.1, 0.9, 0.5), (0.7, 0.6, 0.8)], "a double, b double, c double")
    for r in EV.soft_vote(df, {"a": 2.0, "b": 1.0, "c": 1.5}).collect():
        assert min(r.a, r.b, r.c) <= r.vote_p1 <= max(r.a, r.b, r.c)


def test_smote_balances_and_stays_on_segments(spark):
    df = blobs(spark, n=120, minority_share=0.2)
    out = FE.smote(df.select("id", "y", "features"), "id", "y", minority=1, k=3, seed=7, projections=4, window=4)
    counts = {r.y: r["count"] for r in out.groupBy("y").count().collect()}
    assert counts[0] == counts[1] == 96
    prov = FE.smote(df.select("id", "y", "features"), "id", "y", minority=1, k=3, seed=7, neighbours="exact",
                    provenance=True)
    pts = {r.id: np.array(r.f) for r in df.where("y = 1").select("id", vector_to_array("features").alias("f"))
           .collect()}
    ids = np.array(sorted(pts))
    for r in prov.where("synthetic = 1").select("_src", "_nbr", "_u", vector_to_array("features").alias("f")).collect():
        a, b = pts[r._src], pts[r._nbr]
        assert 0.0 <= r._u < 1.0 and np.allclose(r.f, a + r._u * (b - a))
        d = np.array([((pts[i] - a) ** 2).sum() if i != r._src else np.inf for i in ids])
        assert r._nbr in set(ids[np.lexsort((ids, d))[:3]])  # one of the 3 nearest minority points


def test_discriminant_separates_blobs(spark):
    df = blobs(spark, n=200, d=5)
    fit = FE.fit_discriminant(df, "y")
    proj = FE.project(df, fit["w"]).collect()
    acc = np.mean([(r.lda > fit["threshold"]) == (r.y == 1) for r in proj])
    assert acc > 0.95


def test_pca_explained_share_cumulative(spark):
    df = blobs(spark, n=100, d=6)
    mean, std, _ = FE.vector_stats(df)
    s = FE.standardize_vector(df, mean, std)
    share = FE.explained_share(spark, FE.fit_pca(s, 3)).orderBy("component").collect()
    assert all(a.cumulative <= b.cumulative for a, b in zip(share, share[1:])) and share[-1].cumulative <= 1.0


def test_models_beat_chance_and_save_load_round_trip(spark, tmp_dir):
    from pyspark.ml import Pipeline, PipelineModel
    df = blobs(spark, n=200, d=4, shift=1.5)
    model = Pipeline(stages=[M.random_forest(trees=20, depth=4, max_features=2)]).fit(df)
    scored = EV.score_batch(model, df, keep=["id", "y"])
    assert EV.roc_auc(scored, "y", "p1").first().auc > 0.8
    M.save_model(model, f"{tmp_dir}/m")
    again = EV.score_batch(PipelineModel.load(f"{tmp_dir}/m"), df, keep=["id", "y"])
    a = sorted(map(tuple, scored.collect()))
    b = sorted(map(tuple, again.collect()))
    assert a == b


def test_class_weights_balanced(spark):
    df = spark.range(0, 100).withColumn("y", (F.col("id") < 20).cast("int"))
    w = {r.y: r.weight for r in M.class_weights(df, "y").select("y", "weight").distinct().collect()}
    assert w == {1: pytest.approx(100 / 40), 0: pytest.approx(100 / 160)}


def test_stream_equals_batch(spark, tmp_dir):
    from pyspark.ml import PipelineModel
    from pyspark.ml.feature import VectorAssembler

    from revisit.streaming.scoring import score_stream, scored
    rng = np.random.default_rng(2)
    rows = [(i, int(i % 2), float(i % 2), *[float(v) for v in rng.normal(i % 2, 1, 3)]) for i in range(60)]
    df = spark.createDataFrame(rows, "id long, y int, label double, a double, b double, c double")
    asm = VectorAssembler(inputCols=["a", "b", "c"], outputCol="features")
    forest = M.random_forest(trees=5, depth=3, max_features=2).fit(asm.transform(df))
    model = PipelineModel(stages=[asm, forest])
    M.save_model(model, f"{tmp_dir}/served")
    df.select("id", "a", "b", "c").write.json(f"{tmp_dir}/in")
    q = score_stream(spark, f"{tmp_dir}/in", df.select("id", "a", "b", "c").schema, f"{tmp_dir}/served", "id",
                     ["a", "b", "c"], f"{tmp_dir}/out", f"{tmp_dir}/ckpt")
    q.awaitTermination()
    stream = sorted(map(tuple, spark.read.parquet(f"{tmp_dir}/out").collect()))
    batch = sorted(map(tuple, scored(model, df.select("id", "a", "b", "c"), "id", ["a", "b", "c"]).collect()))
    assert stream == batch


def test_smote_exact_neighbours_match_bruteforce(spark):
    from revisit.ml.features import _exact_neighbours, _projection_neighbours
    rng = np.random.default_rng(11)
    x = rng.normal(0, 1, (60, 3))
    pts = spark.createDataFrame([(i, x[i].tolist()) for i in range(60)], "id long, _x array<double>")
    got = {(r._a, r._j): r._c for r in _exact_neighbours(pts, "id", 3).collect()}
    for i in range(60):
        d = ((x - x[i]) ** 2).sum(axis=1)
        d[i] = np.inf
        assert [got[(i, j)] for j in (1, 2, 3)] == list(np.lexsort((np.arange(60), d))[:3])
    approx = _projection_neighbours(pts, "id", 3, 3, 7, projections=6, window=8).collect()
    hit = np.mean([got[(r._a, r._j)] == r._c for r in approx])
    assert hit > 0.6  # the approximate search finds most true neighbours


def test_smote_projection_path_balances(spark):
    df = blobs(spark, n=100, minority_share=0.3)
    out = FE.smote(df.select("id", "y", "features"), "id", "y", minority=1, k=3, seed=7)
    counts = {r.y: r["count"] for r in out.groupBy("y").count().collect()}
    assert counts[0] == counts[1] == 70


def test_smote_exact_raises_above_its_broadcast_bound(spark, monkeypatch):
    df = blobs(spark, n=100, minority_share=0.3).select("id", "y", "features")
    monkeypatch.setattr(FE, "EXACT_BYTES", 100)
    with pytest.raises(ValueError, match="broadcast bound"):
        FE.smote(df, "id", "y", minority=1, k=3, seed=7, neighbours="exact")


def test_readmission_model_trains_on_train_part_without_leaks(spark):
    from revisit.plans.model import EXCLUDED, train_readmission_model
    model, scored = train_readmission_model(spark, "/root/testdata/sf0.001", trees=10)
    used = set(model.stages[-2].getInputCols())
    assert not used & EXCLUDED
    rows = scored.collect()
    assert rows and all(0.0 <= r.p1 <= 1.0 for r in rows)


@pytest.mark.parametrize("parts", [1, 4, 17])
def test_seeded_operators_partition_independent(spark, parts):
    df = blobs(spark, n=80, minority_share=0.25).repartition(parts)
    folds = sorted(map(tuple, FE.fold_column(df.select("id", "y"), "id", "y", 5).collect()))
    ref = sorted(map(tuple, FE.fold_column(blobs(spark, n=80, minority_share=0.25).select("id", "y"),
                                           "id", "y", 5).collect()))
    assert folds == ref
    syn = FE.smote(df.select("id", "y", "features"), "id", "y", minority=1, k=3, seed=3).where("synthetic = 1")
    got = sorted(tuple(np.round(r.f, 9)) for r in syn.select(vector_to_array("features").alias("f")).collect())
    base = blobs(spark, n=80, minority_share=0.25).select("id", "y", "features")
    syn0 = FE.smote(base, "id", "y", minority=1, k=3, seed=3).where("synthetic = 1")
    want = sorted(tuple(np.round(r.f, 9)) for r in syn0.select(vector_to_array("features").alias("f")).collect())
    assert got == want


def test_full_grids_are_valid_spark_params(spark):
    from pyspark.ml.tuning import ParamGridBuilder
    for est, grid in [(M.random_forest(), M.RF_GRID), (M.gradient_boosting(), M.GBT_GRID),
                      (M.boosted_shallow(), M.BOOSTER_GRID), (M.perceptron(64), M.mlp_grid(64))]:
        b = ParamGridBuilder()
        for name, values in grid.items():
            b = b.addGrid(est.getParam(name), values)
        maps = b.build()
        assert len(maps) == int(np.prod([len(v) for v in grid.values()]))
    assert len(M.RF_GRID["numTrees"]) == 14 and M.STRENGTHS[0] == 1e-6 and M.STRENGTHS[-1] == 1e6



def test_ingest_csv_to_parquet(spark, tmp_dir):
    import gzip
    import os

    from pyspark.sql import types as T

    from revisit.sources.files import ingest_csv
    path = os.path.join(tmp_dir, "in.csv.gz")
    with gzip.open(path, "wt") as f:
        f.write("a,b\n1,x\n2,y,extra\n3\n")
    out = ingest_csv(spark, path, T.StructType.fromDDL("a long, b string"), os.path.join(tmp_dir, "pq"))
    assert sorted(map(tuple, out.collect())) == [(1, "x"), (3, None)]


def test_pca_matches_numpy_up_to_sign(spark):
    df = blobs(spark, n=150, d=5, shift=2.0)
    mean, std, _ = FE.vector_stats(df)
    s = FE.standardize_vector(df, mean, std)
    model = FE.fit_pca(s, 3)
    got = np.array([r.p for r in model.transform(s).orderBy("id").select(vector_to_array("pca").alias("p")).collect()])
    x = np.array([r.f for r in s.orderBy("id").select(vector_to_array("scaled").alias("f")).collect()])
    _, sv, vt = np.linalg.svd(x - x.mean(axis=0), full_matrices=False)
    want = x @ vt[:3].T
    for j in range(3):
        assert abs(np.corrcoef(got[:, j], want[:, j])[0, 1]) == pytest.approx(1.0, abs=1e-6)
    share = model.explainedVariance.toArray()
    assert share == pytest.approx((sv ** 2 / (sv ** 2).sum())[:3], abs=1e-6)


def test_stack_out_of_fold(spark):
    df = blobs(spark, n=120, d=3, shift=2.0)
    base = {"rf": M.random_forest(trees=5, depth=3, max_features=2), "gb": M.gradient_boosting(trees=5)}
    model = M.stack(df, base, out_of_fold=3, key="id")
    scored = EV.score_batch(model, df, keep=["id", "y"])
    assert scored.count() == 120
    assert EV.roc_auc(scored, "y", "p1").first().auc > 0.8


def test_end_to_end_run_writes_everything(spark, tmp_dir):
    import os

    from revisit.plans.run import run
    metrics = {(r.metric, r.actual, r.predicted): r.value
               for r in run(spark, "/root/testdata/sf0.001", tmp_dir, trees=10).collect()}
    assert 0.0 <= metrics[("roc_auc", None, None)] <= 1.0
    for sub in ("dataset", "dataset_csv", "train_ids", "test_ids", "model", "test_scores", "metrics"):
        assert os.path.isdir(os.path.join(tmp_dir, sub)), sub
    n_test = spark.read.parquet(os.path.join(tmp_dir, "test_scores")).count()
    assert sum(v for (m, _, _), v in metrics.items() if m == "confusion") == n_test


def test_stream_restart_from_checkpoint_is_exactly_once(spark, tmp_dir):
    from pyspark.ml import PipelineModel
    from pyspark.ml.feature import VectorAssembler

    from revisit.streaming.scoring import score_stream
    rng = np.random.default_rng(4)
    rows = [(i, int(i % 2), float(i % 2), *[float(v) for v in rng.normal(i % 2, 1, 2)]) for i in range(40)]
    df = spark.createDataFrame(rows, "id long, y int, label double, a double, b double")
    asm = VectorAssembler(inputCols=["a", "b"], outputCol="features")
    model = PipelineModel(stages=[asm, M.random_forest(trees=3, depth=2, max_features=1).fit(asm.transform(df))])
    M.save_model(model, f"{tmp_dir}/m")
    recs = df.select("id", "a", "b")
    recs.where("id < 20").write.json(f"{tmp_dir}/in/part1")
    args = (spark, f"{tmp_dir}/in/*", recs.schema, f"{tmp_dir}/m", "id", ["a", "b"], f"{tmp_dir}/out",
            f"{tmp_dir}/ckpt")
    score_stream(*args).awaitTermination()
    assert spark.read.parquet(f"{tmp_dir}/out").count() == 20
    recs.where("id >= 20").write.json(f"{tmp_dir}/in/part2")   # new files arrive; the query restarts
    score_stream(*args).awaitTermination()
    out = spark.read.parquet(f"{tmp_dir}/out")
    assert out.count() == 40 and out.select("id").distinct().count() == 40
