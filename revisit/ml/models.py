"""Model training on Spark ML: forests, boosted trees, perceptrons, linear
models, grid search with cross-validation, stacking and class weights.

Parameter names map the source's settings onto Spark's estimators; where a
library behaves differently (sample vs population statistics, C vs regParam,
activation functions, second-order boosting) the docstring says so.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from math import ceil

import numpy as np
from pyspark import inheritable_thread_target
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import (GBTClassifier, LinearSVC, LogisticRegression,
                                       MultilayerPerceptronClassifier, RandomForestClassifier)
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import LinearRegression
from pyspark.ml.tuning import CrossValidator, CrossValidatorModel, ParamGridBuilder
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from revisit.session import cut_lineage, keep

# The tuning grids and chosen settings of the source analysis,
# written with Spark parameter names (ranges as in the source: end exclusive).
SEED = 2017
CV_FOLDS = 10
RF_GRID = {"numTrees": list(range(50, 750, 50)), "impurity": ["gini", "entropy"],
           "featureSubsetStrategy": ["41", "42", "43", "44", "45"], "maxDepth": list(range(7, 12))}
RF_CHOSEN = {"numTrees": 250, "impurity": "gini", "featureSubsetStrategy": "44", "maxDepth": 10}
GBT_GRID = {"maxIter": list(range(50, 750, 50)), "maxDepth": [1, 2, 3, 4]}
GBT_CHOSEN = {"maxIter": 100, "maxDepth": 3}
BOOSTER_GRID = {"stepSize": [0.1, 0.01, 0.2, 0.3, 0.4, 0.5, 0.6], "maxDepth": [1, 2, 3],
                "maxIter": list(range(50, 2000, 50))}
BOOSTER_CHOSEN = {"stepSize": 0.3, "maxDepth": 1, "maxIter": 100}
MLP_HIDDEN = [(20, 2), (25, 3)]
STRENGTHS = [10.0 ** a for a in range(-6, 7)]  # SGD / Lasso alpha, logistic and stacking C
STACK_C = 0.001
VOTE_WEIGHTS = {"gb": 2.0, "rf": 1.0, "xb": 1.5}


#: Bytes of feature values for which a fit gets one more task, and the most of one task.
TASK_BYTES, MOST_BYTES = 32 << 20, 512 << 20


def fit_rows(df: DataFrame, features: str = "features", task_bytes: int | None = None) -> DataFrame:
    """The same rows in few partitions, kept.  Each pass of a forest, boosting or
    perceptron fit sends its node statistics (or gradient) once per partition: a
    level of a deep forest holds gigabytes of them, however few rows there are.
    One partition per ``task_bytes`` (``TASK_BYTES``), up to one a core; more only
    where a task would hold over ``MOST_BYTES``."""
    df = keep(df)
    n, width = df.select(F.count(F.lit(1)), F.max(F.size(vector_to_array(features)))).first()
    held = 8 * n * (width or 0)
    cores = df.sparkSession.sparkContext.defaultParallelism
    parts = max(1, min(cores, ceil(held / (task_bytes or TASK_BYTES))), ceil(held / MOST_BYTES))
    return keep(df.coalesce(parts))


def together(jobs: Mapping[str, callable], most: int | None = None) -> dict:
    """Run independent fits at once; Spark shares its executors among their jobs."""
    with ThreadPoolExecutor(max_workers=max(1, min(len(jobs), most or len(jobs)))) as pool:
        inherits = inheritable_thread_target(SparkSession.active())
        futures = {name: pool.submit(inherits(job)) for name, job in jobs.items()}
        return {name: f.result() for name, f in futures.items()}


def mlp_grid(n_features: int) -> dict:
    """The perceptron grid as Spark layer lists (input, hidden…, 2 classes)."""
    return {"layers": [[n_features, *h, 2] for h in MLP_HIDDEN]}


def class_weights(df: DataFrame, label: str, out: str = "weight") -> DataFrame:
    """Balanced weight n / (n_classes · n_class) on every labelled row; rows
    without a label are dropped."""
    counts = df.where(F.col(label).isNotNull()).groupBy(label).agg(F.count(F.lit(1)).alias("_nc"))
    k, total = counts.agg(F.count(F.lit(1)), F.sum("_nc")).first()
    w = counts.select(label, (F.lit(float(total or 0)) / (F.lit(float(k)) * F.col("_nc"))).alias(out))
    return df.join(w, label)


def random_forest(label: str = "label", features: str = "features", trees: int = 250,
                  impurity: str = "gini", max_features: int | str = "sqrt", depth: int = 10,
                  seed: int = 2017) -> RandomForestClassifier:
    """An integer ``max_features`` becomes Spark's integer-string strategy.

    Each row's nodes are kept from level to level, so that a row is not led from
    the root of every tree anew; the trees are the same.  The chain of those
    updates is checkpointed where it gets long."""
    return RandomForestClassifier(labelCol=label, featuresCol=features, numTrees=trees,
                                  impurity=impurity, featureSubsetStrategy=str(max_features),
                                  maxDepth=depth, seed=seed, cacheNodeIds=True, checkpointInterval=30)


def gradient_boosting(label: str = "label", features: str = "features", trees: int = 100,
                      depth: int = 3, rate: float = 0.1, seed: int = 2017) -> GBTClassifier:
    return GBTClassifier(labelCol=label, featuresCol=features, maxIter=trees, maxDepth=depth,
                         stepSize=rate, seed=seed)


def boosted_shallow(label: str = "label", features: str = "features", trees: int = 100,
                    depth: int = 1, rate: float = 0.3, seed: int = 2017) -> GBTClassifier:
    """The second booster (rate 0.3, stumps).  First-order gradient boosting:
    regularised second-order boosting is not matched."""
    return gradient_boosting(label, features, trees, depth, rate, seed)


def perceptron(n_features: int, hidden: Sequence[int] = (20, 2), label: str = "label",
               features: str = "features", max_iter: int = 200, solver: str = "l-bfgs",
               seed: int = 2017) -> MultilayerPerceptronClassifier:
    """Sigmoid hidden layers; relu/tanh activations have no Spark equivalent."""
    return MultilayerPerceptronClassifier(labelCol=label, featuresCol=features,
                                          layers=[n_features, *hidden, 2], maxIter=max_iter,
                                          solver=solver, seed=seed)


def linear_sgd(loss: str = "log", penalty: str = "l2", alpha: float = 1e-4, label: str = "label",
               features: str = "features", weight: str | None = None, l1_ratio: float = 0.15):
    """Linear classifier with log loss (logistic) or hinge loss (SVM, L2 only).
    ``alpha`` is the regularisation strength; balanced weights via ``weight``."""
    if loss == "hinge":
        est = LinearSVC(labelCol=label, featuresCol=features, regParam=alpha, maxIter=100)
        if weight:
            est.setWeightCol(weight)
        return est
    enet = {"l2": 0.0, "l1": 1.0, "elasticnet": l1_ratio}[penalty]
    est = LogisticRegression(labelCol=label, featuresCol=features, regParam=alpha,
                             elasticNetParam=enet, maxIter=100)
    if weight:
        est.setWeightCol(weight)
    return est


def lasso(alpha: float = 1e-3, label: str = "label", features: str = "features",
          max_iter: int = 900) -> LinearRegression:
    """L1 linear regression on a 0/1 label; raw predictions may leave [0, 1]."""
    return LinearRegression(labelCol=label, featuresCol=features, elasticNetParam=1.0, regParam=alpha,
                            standardization=False, maxIter=max_iter)


def logistic(C: float = 1.0, n_rows: int = 1, label: str = "label", features: str = "features",
             max_iter: int = 900) -> LogisticRegression:
    """L2 logistic regression; inverse strength C maps to regParam = 1/(C·n)."""
    return LogisticRegression(labelCol=label, featuresCol=features, elasticNetParam=0.0,
                              regParam=1.0 / (C * max(n_rows, 1)), standardization=False,
                              maxIter=max_iter)


def auc_evaluator(label: str = "label", raw: str = "rawPrediction") -> BinaryClassificationEvaluator:
    """Exact ROC AUC (numBins=0: no down-sampling of the curve)."""
    return BinaryClassificationEvaluator(labelCol=label, rawPredictionCol=raw,
                                         metricName="areaUnderROC", numBins=0)


def grid_search(df: DataFrame, estimator, grid: Mapping[str, Sequence], fold_col: str | None = None,
                folds: int = 10, label: str = "label", parallelism: int = 4, seed: int = 2017,
                checkpoint: bool = True):
    """Exhaustive grid, k-fold cross-validation scored by ROC AUC, best model
    refitted on all rows.  With ``fold_col`` the folds are the given
    (class-balanced) column instead of random ones.

    Cross-validation reads its input once per fold and grid point; with
    ``checkpoint`` the input is first written to the shared checkpoint folder
    so those reads (and any recovery after a lost executor) start there
    instead of replaying the whole preparation lineage.

    With ``fold_col`` all folds and grid points are fitted side by side,
    ``parallelism`` at a time, on rows in few partitions (``fit_rows``); the
    points of a random forest that differ in the number of trees or the depth
    only share a forest a fold (``forest_grid``)."""
    from revisit.ml import forest_grid as FG
    if checkpoint:
        df = cut_lineage(df)
    builder = ParamGridBuilder()
    for name, values in grid.items():
        builder = builder.addGrid(estimator.getParam(name), list(values))
    points, evaluator = builder.build(), auc_evaluator(label)
    cv = CrossValidator(estimator=estimator, estimatorParamMaps=points, evaluator=evaluator, numFolds=folds,
                        parallelism=parallelism, seed=seed)
    if not fold_col:
        return cv.fit(df)
    cv.setFoldCol(fold_col)
    df = fit_rows(df, estimator.getOrDefault("featuresCol"))
    sizes = {r[0]: r["count"] for r in df.groupBy(fold_col).count().collect()}  # one row a fold
    if not set(sizes) <= set(range(folds)):
        raise ValueError(f"fold numbers must be in [0, {folds}): {sorted(map(str, sizes))}")
    if len(sizes) < folds:
        raise ValueError(f"rows of {len(sizes)} folds only, of {folds}")

    def one(fold: int, point: Mapping) -> float:
        model = estimator.fit(df.where(F.col(fold_col) != fold), point)
        return evaluator.evaluate(model.transform(df.where(F.col(fold_col) == fold)))

    scores = FG.fold_scores(df, estimator, grid, points, fold_col, sizes, label, parallelism) if FG.shares_trees(estimator, grid) else None
    if scores is None:
        scores = together({(i, k): lambda k=k, p=p: one(k, p) for i, p in enumerate(points) for k in range(folds)}, parallelism)
    per = np.array([[scores[i, k] for k in range(folds)] for i in range(len(points))])
    mean = per.mean(axis=1)
    best = estimator.fit(df, points[int(np.argmax(mean))])
    return cv._copyValues(CrossValidatorModel(best, mean.tolist(), stdMetrics=per.std(axis=1).tolist()))


def best_params(cv_model) -> dict:
    best = max(range(len(cv_model.avgMetrics)), key=lambda i: cv_model.avgMetrics[i])
    params = cv_model.getEstimatorParamMaps()[best]
    return {p.name: v for p, v in params.items()} | {"cv_auc": cv_model.avgMetrics[best]}


def _base_estimators(base: Mapping[str, object]) -> list:
    out = []
    for name, est in base.items():
        est = est.copy()
        est.setPredictionCol(f"{name}_pred").setRawPredictionCol(f"{name}_raw")
        if est.hasParam("probabilityCol"):
            est.setProbabilityCol(f"{name}_prob")
        out.append(est)
    return out


def stack(train: DataFrame, base: Mapping[str, object], label: str = "label",
          features: str = "features", C: float = 0.001, out_of_fold: int | None = None,
          key: str | None = None) -> PipelineModel:
    """Stacking: the base models' hard class labels are the inputs of an L2
    logistic meta-model.

    Default (as in the source): base models fitted on all training rows and
    the meta-model trained on their in-sample predictions.  With
    ``out_of_fold=k`` (needs a unique ``key``) the meta-model is trained on
    predictions for each fold made by base models fitted on the other folds,
    and the base models are then refitted on all rows for serving."""
    ests = _base_estimators(base)
    assembler = VectorAssembler(inputCols=[f"{n}_pred" for n in base], outputCol="_stack")
    train = fit_rows(train, features)  # read by every base model and the meta-model
    n = train.count()
    if not out_of_fold:
        got = together({name: lambda e=e: e.fit(train) for name, e in zip(base, ests)})
        fitted = [*(got[name] for name in base), assembler]
        inputs = keep(PipelineModel(stages=fitted).transform(train))
        return PipelineModel(stages=[*fitted, logistic(C, n, label, "_stack").fit(inputs)])
    if key is None:
        raise ValueError("out-of-fold stacking needs a unique key column")
    from revisit.ml.features import fold_column
    folded = keep(fold_column(train, key, label, out_of_fold, out="_fold"))
    held_out = None
    for f in range(out_of_fold):
        fitted = Pipeline(stages=list(ests)).fit(folded.where(F.col("_fold") != f))
        pred = fitted.transform(folded.where(F.col("_fold") == f))
        held_out = pred if held_out is None else held_out.unionByName(pred)
    meta = logistic(C, n, label, "_stack").fit(assembler.transform(held_out))
    full = Pipeline(stages=list(ests)).fit(train)
    return PipelineModel(stages=[*full.stages, assembler, meta])


def save_model(model, path: str) -> None:
    model.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)
