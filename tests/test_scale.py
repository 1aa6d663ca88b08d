"""Steps whose share of a task may not grow with the tables."""

import re

import numpy as np
import pytest

from revisit.sources import tables as T

from .conftest import SMALL


def test_stays_are_dealt_by_rows(spark, monkeypatch):
    """A task of the stays holds about TASK_ROWS line items, however many there are."""
    whole = {tuple(r) for r in T.icu_stays(spark, SMALL).collect()}
    monkeypatch.setattr(T, "TASK_ROWS", 500)
    stays = T.icu_stays(spark, SMALL)
    assert {tuple(r) for r in stays.collect()} == whole
    assert stays.rdd.getNumPartitions() == -(-T.table(spark, SMALL, "lineitem").count() // 500)
    monkeypatch.setattr(T, "TASK_ROWS", 1 << 20)
    assert T.dealt(T.table(spark, SMALL, "orders"), "o_orderkey").rdd.getNumPartitions() == 1


def exchanges(df):
    """(keys, partitions) of the hash exchanges of a plan."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return [(re.sub(r"#\d+L?", "", keys), int(n)) for keys, n in re.findall(r"Exchange hashpartitioning\((.*), (\d+)\)", plan)]


def same_rows(a, b):
    return sorted(map(repr, a.collect())) == sorted(map(repr, b.collect()))


def test_a_task_of_the_stays_does_not_hold_every_order(spark, monkeypatch):
    """Orders are dealt as the line items are, however small their file looks."""
    assert T.TASK_ROWS <= 1 << 18
    whole = T.icu_stays(spark, SMALL).collect()
    monkeypatch.setattr(T, "TASK_ROWS", 500)
    stays = T.icu_stays(spark, SMALL)
    n = T.task_parts(T.table(spark, SMALL, "lineitem"))
    assert sorted(exchanges(stays)) == [("l_orderkey", n), ("o_orderkey", n)]
    assert sorted(map(repr, stays.collect())) == sorted(map(repr, whole))


def test_scan_is_what_bound_reads(spark, tmp_dir):
    """A stored hospital table counts itself, a fixture the table under it."""
    spark.range(7).write.parquet(f"{tmp_dir}/icu_stays.parquet")
    spark.range(9).write.parquet(f"{tmp_dir}/lineitem.parquet")
    assert [T.scan(spark, tmp_dir, "icu_stays", s).count() for s in (None, "tables", "fixtures")] == [7, 7, 9]
    assert T.scan(spark, tmp_dir, "drg_codes").count() == 9
    with pytest.raises(FileNotFoundError):
        T.scan(spark, tmp_dir, "drg_codes", "tables")
    assert set(T.OVER) == set(T.BINDINGS)


@pytest.mark.parametrize("k", [1, 4, 40])
def test_nearest_measures_few_pairs_and_is_exact(k, monkeypatch):
    """The k nearest, ties by id, without differences of all pairs."""
    from revisit.ml import neighbours as N
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.normal(size=(300, 7)), np.ones((30, 7)), 1e6 + rng.normal(size=(20, 7)) * 1e-3])
    ids = rng.permutation(len(x))
    q, asked = x[::5], ids[::5]
    own = asked[:, None] == ids[None, :]
    d = np.where(own, np.inf, N._distances(q, x))
    want = [(i, j, d[i, j]) for i in range(len(q)) for j in np.lexsort((ids, d[i]))[:k] if d[i, j] < np.inf]
    with monkeypatch.context() as m:
        m.setattr(N, "_distances", None)
        got = N._nearest(q, x, own, ids, k)
    assert list(zip(*[v.tolist() for v in got])) == want
    x[7, 2] = np.nan
    i, j, _ = N._nearest(q, x, own, ids, k)
    assert 7 not in j and len(i) == k * len(q)
    assert not len(N._nearest(x[:1], x[:1], np.array([[True]]), ids[:1], k)[0])


def points(spark, n=240, parts=16):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(n, 4)) + np.arange(n)[:, None] % 2
    from pyspark.ml.functions import array_to_vector
    df = spark.createDataFrame([(i, float(i % 2), i // 2 % 3, v.tolist()) for i, v in enumerate(x)], "id int, label double, fold int, x array<double>")
    return df.select("id", "label", "fold", array_to_vector("x").alias("features")).repartition(parts)


def test_fits_run_on_few_partitions(spark, monkeypatch):
    from revisit.ml import models as M
    df = points(spark)
    few = M.fit_rows(df)
    assert few.rdd.getNumPartitions() == 1
    assert sorted(map(tuple, few.collect())) == sorted(map(tuple, df.collect()))
    monkeypatch.setattr(M, "TASK_BYTES", 4096)  # 7680 bytes of features
    assert M.fit_rows(df).rdd.getNumPartitions() == 2
    assert M.fit_rows(df, task_bytes=2048).rdd.getNumPartitions() == 4  # the cores
    monkeypatch.setattr(M, "MOST_BYTES", 1024)
    assert M.fit_rows(df).rdd.getNumPartitions() == 8
    assert M.fit_rows(df.where("id < 0")).count() == 0


def test_search_fits_folds_side_by_side(spark, monkeypatch):
    """As Spark's cross-validation, all folds and grid points handed out at once."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.tuning import CrossValidator
    from revisit.ml import models as M
    df, est, grid = points(spark), LogisticRegression(), {"regParam": [0.01, 5.0]}
    at_once, run = [], M.together
    monkeypatch.setattr(M, "together", lambda jobs, most=None: at_once.append(len(jobs)) or run(jobs, most))
    got = M.grid_search(df, est, grid, fold_col="fold", folds=3)
    assert at_once == [6]
    want = CrossValidator(estimator=est, estimatorParamMaps=[{est.regParam: v} for v in grid["regParam"]],
                          evaluator=M.auc_evaluator(), numFolds=3, foldCol="fold").fit(df)
    assert got.avgMetrics == pytest.approx(want.avgMetrics) and got.stdMetrics == pytest.approx(want.stdMetrics)
    assert got.bestModel.coefficients.toArray() == pytest.approx(want.bestModel.coefficients.toArray())
    with pytest.raises(ValueError):
        M.grid_search(df, est, grid, fold_col="fold", folds=2)
    with pytest.raises(ValueError):
        M.grid_search(df, est, grid, fold_col="fold", folds=4)


def signal(spark):
    """Rows that a forest splits to any depth, with labels that it can learn in part."""
    rng = np.random.default_rng(11)
    x = rng.normal(size=(300, 5)).round(1)
    y = (x[:, 0] + x[:, 1] * x[:, 2] + rng.normal(size=300) > 0).astype(float)
    from pyspark.ml.functions import array_to_vector
    df = spark.createDataFrame([(float(b), i % 3, v.tolist()) for i, (v, b) in enumerate(zip(x, y))], "label double, fold int, x array<double>")
    return df.select("label", "fold", array_to_vector("x").alias("features")).coalesce(1).cache()


def test_grid_of_a_forest_scores_as_a_fit_per_point(spark):
    """Depths and numbers of trees from one forest: as fits of their own, and a
    prefix of the trees as the sum of their votes."""
    from pyspark.ml.tuning import CrossValidator
    from revisit.ml import forest_grid as FG
    from revisit.ml import models as M
    df, est = signal(spark), M.random_forest(trees=9, max_features=3)
    grid = {"maxDepth": [1, 2, 4, 7], "impurity": ["gini", "entropy"]}
    got = M.grid_search(df, est, grid, fold_col="fold", folds=3)
    want = CrossValidator(estimator=est, estimatorParamMaps=got.getEstimatorParamMaps(), evaluator=M.auc_evaluator(), numFolds=3, foldCol="fold").fit(df)
    assert got.avgMetrics == pytest.approx(want.avgMetrics, abs=1e-12) and got.stdMetrics == pytest.approx(want.stdMetrics, abs=1e-12)
    assert len(set(got.avgMetrics)) > 4 and got.bestModel.toDebugString == want.bestModel.toDebugString
    model = est.fit(df)
    rows = FG.held_out_scores(df, FG.read_forest(model), [2, 9], [10], "features", "label").collect()
    for r, row in zip(rows[:40], df.collect()):
        votes = [t.predictProbability(row["features"])[1] for t in model.trees]
        assert r["score"] == pytest.approx([sum(votes[:2]), sum(votes)])


def test_forest_keeps_the_nodes_of_its_rows(spark):
    """The same trees as with a walk from the root at each level."""
    from revisit.ml import models as M
    df, est = signal(spark), M.random_forest(trees=7, max_features=3, depth=6)
    assert est.getCacheNodeIds()
    walked = est.copy({est.cacheNodeIds: False})
    assert est.fit(df).toDebugString.split("\n", 1)[1] == walked.fit(df).toDebugString.split("\n", 1)[1]


def test_blocks_of_trees_are_one_forest(spark, monkeypatch):
    from revisit.ml import forest_grid as FG
    from revisit.ml import models as M
    df, est, fitted = signal(spark), M.random_forest(max_features=3, depth=4), []
    monkeypatch.setattr(FG, "NODES", 100)
    read = FG.read_forest
    monkeypatch.setattr(FG, "read_forest", lambda m: fitted.append(m.getNumTrees) or read(m))
    cv = M.grid_search(df, est, {"numTrees": [2, 5, 8]}, fold_col="fold", folds=3)
    assert sorted(fitted) == [2] * 3 + [3] * 6 and len(cv.avgMetrics) == 3 and min(cv.avgMetrics) > 0.6


def test_grid_query_has_every_point(spark, monkeypatch):
    """No point of the forest grid is left out."""
    from revisit.ml import models as M
    from revisit.plans.catalog_ml import q_grid
    asked = []
    monkeypatch.setattr(M, "grid_search", lambda df, est, grid, **k: asked.append((dict(grid), k["folds"])))
    monkeypatch.setattr(M, "best_params", lambda cv: {"cv_auc": 0.5})
    q_grid(spark, SMALL)
    assert asked == [(M.RF_GRID, 10)] and np.prod([len(v) for v in M.RF_GRID.values()]) == 700


def test_composite_join_is_dealt_by_rows(spark, monkeypatch):
    """The join of stays and totals runs in as many tasks as the stays."""
    from revisit.plans.catalog import REGISTRY
    query = REGISTRY["join_inner_composite"][0]
    whole = query(spark, SMALL).drop("LOS_y")
    monkeypatch.setattr(T, "TASK_ROWS", 500)
    n = T.task_parts(T.table(spark, SMALL, "lineitem"))
    got = query(spark, SMALL)
    assert {m for keys, m in exchanges(got) if "ICUSTAY_ID" in keys} == {n}
    assert same_rows(got.drop("LOS_y"), whole)


def test_cohort_steps_are_dealt_by_rows(spark, monkeypatch):
    """Windows by admissions, roll-ups and joins by admission id by line items."""
    from revisit.plans import cohort as C
    whole = C.enriched(spark, SMALL)
    monkeypatch.setattr(T, "TASK_ROWS", 100)
    chunks, n = (T.task_parts(T.table(spark, SMALL, t)) for t in ("orders", "lineitem"))
    got = C.enriched(spark, SMALL)
    assert 4 < chunks < n
    held = exchanges(got)
    assert {m for keys, m in held if "HADM_ID" in keys or "l_orderkey" in keys} == {n}
    assert {m for keys, m in held if keys == "SUBJECT_ID, _chunk"} == {chunks}
    assert same_rows(got, whole)
    gaps = C.readmission_gaps(spark, SMALL)
    assert {m for keys, m in exchanges(gaps) if keys == "SUBJECT_ID, _chunk"} == {chunks}
