"""Catalog entries for feature preparation, models and evaluation (§2.9–2.11).

Bindings: ``embeddings`` give the model data (64 features; y = label < 5, or
y = label = 0 for the imbalanced oversampling case); ``events`` give the
given-score evaluation data (y = purchase, score = floor(value)).
"""

from __future__ import annotations

import uuid

from pyspark.ml import Pipeline
from pyspark.ml.feature import PCA, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Window
from pyspark.sql import functions as F

from revisit.ml import booster as BO
from revisit.ml import evaluate as EV
from revisit.ml import features as FE
from revisit.ml import gradient as GR
from revisit.ml import lasso as LA
from revisit.ml import models as M
from revisit.ml import sparse as SP
from revisit.ml import stages as SG
from revisit.ml.svm_smote import svm_smote
from revisit.operators import joins as J
from revisit.operators import profile as P
from revisit.plans import cohort as C
from revisit.plans.catalog import _b, query, r6
from revisit.session import checkpoint_dir, keep

SEED = 2017


def _emb(spark, d, positive="label < 5"):
    e = _b(spark, d, "embeddings")
    e = e.withColumn("y", F.expr(f"CAST({positive} AS INT)"))
    return FE.embedding_features(e).withColumn("label", F.col("y").cast("double"))


def _split(spark, d, positive="label < 5"):
    return FE.stratified_split(_emb(spark, d, positive), "vec_id", "y", 0.25, SEED)


def _events(spark, d):
    ev = _b(spark, d, "events")
    return ev.select("event_id", (F.col("event_type") == "purchase").cast("int").alias("y"),
                     F.floor("value").cast("double").alias("score"), "value")


_EVENTS_SQL = ("SELECT event_id, CAST(event_type = 'purchase' AS INTEGER) AS y, "
               "CAST(FLOOR(value) AS DOUBLE) AS score, value FROM events")

_SPLIT_SQL = f"""
WITH e AS (SELECT vec_id, CAST(label < 5 AS INTEGER) AS y FROM embeddings),
r AS (SELECT vec_id, y,
             ROW_NUMBER() OVER (PARTITION BY y ORDER BY md5('{SEED}:' || CAST(vec_id AS VARCHAR)), vec_id) AS rn,
             COUNT(*) OVER (PARTITION BY y) AS n
      FROM e)"""


# ------------------------------------------------------------------ 2.9 features

def _numbered(prefix, n):
    return [f"{prefix}{i}" for i in range(n)]


#: The nine category columns and the values that the bound tables hold.
_ONE_HOT = {
    "ADMISSION_TYPE": ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"],
    "ADMISSION_LOCATION": _numbered("LOC", 6), "DISCHARGE_LOCATION": _numbered("DIS", 9), "INSURANCE": ["F", "O", "P"],
    "RELIGION": _numbered("REL", 5), "MARITAL_STATUS": _numbered("MAR", 4), "ETHNICITY": _numbered("ETH", 8),
    "GENDER": ["F", "M"], "LAST_CAREUNIT": ["UFA", "UFN", "UFR", "UOA", "UON", "UOR"],
}


@query("one_hot", "SELECT HADM_ID, " + ", ".join(
    f"CAST({c} IS NOT DISTINCT FROM '{v}' AS INTEGER) AS \"{c}_{v}\""
    for c, vs in _ONE_HOT.items() for v in vs) + " FROM enriched", "enriched")
def q_one_hot(spark, d):
    e = keep(C.enriched(spark, d).select("HADM_ID", *_ONE_HOT))
    vocab = P.fit_vocabs(e, list(_ONE_HOT))
    return FE.one_hot(e, vocab)


def _rounded_array(v):
    return F.transform(vector_to_array(v), lambda x: F.round(x, 6))


@query("assemble_features", """
SELECT HADM_ID, [CAST(NO_OF_SURGERIES AS DOUBLE), ROUND(COALESCE(DRG_SEVERITY, 0), 6),
                 ROUND(COALESCE(DRG_MORTALITY, 0), 6)] AS features
FROM enriched""", "enriched")
def q_assemble(spark, d):
    e = C.enriched(spark, d).select("HADM_ID", "DAYS_TO_READMISSION", "NO_OF_SURGERIES",
                                    "DRG_SEVERITY", "DRG_MORTALITY").fillna(0.0)
    v = FE.assemble(e, exclude=["HADM_ID", "DAYS_TO_READMISSION"])
    return v.select("HADM_ID", _rounded_array("features").alias("features"))


@query("crosstab_vector", """
WITH vocabulary AS (SELECT v, CAST(ROW_NUMBER() OVER (ORDER BY v) - 1 AS INTEGER) AS i FROM (
       SELECT DISTINCT ICD9_CODE AS v FROM diagnoses WHERE ICD9_CODE IS NOT NULL)),
counts AS (SELECT HADM_ID, i, CAST(COUNT(*) AS DOUBLE) AS n FROM diagnoses JOIN vocabulary ON ICD9_CODE = v
           WHERE HADM_ID IN (SELECT HADM_ID FROM gaps) GROUP BY HADM_ID, i)
SELECT HADM_ID, (SELECT CAST(COUNT(*) AS INTEGER) FROM vocabulary) AS size, list(i ORDER BY i) AS indices, list(n ORDER BY i) AS counts
FROM counts GROUP BY HADM_ID""", "diagnoses", "gaps")
def q_crosstab_vector(spark, d):
    codes = _b(spark, d, "diagnoses")
    mine = J.semi(codes, C.readmission_gaps(spark, d).select("HADM_ID"), "HADM_ID")
    v = SP.count_vectors(mine, "HADM_ID", "ICD9_CODE", SP.fit_vocabulary(codes, "ICD9_CODE"))
    return v.select("HADM_ID", *SP.unpacked("codes"))


@query("stratified_split", _SPLIT_SQL + """
SELECT vec_id, y, CAST(rn <= ROUND(n * 0.25) AS INTEGER) AS is_test FROM r""")
def q_split(spark, d):
    return _split(spark, d).select("vec_id", "y", "is_test")


@query("stratified_folds", _SPLIT_SQL + """
SELECT vec_id, y, CAST((rn - 1) % 10 AS INTEGER) AS fold FROM r""")
def q_folds(spark, d):
    return FE.fold_column(_emb(spark, d), "vec_id", "y", 10, SEED).select("vec_id", "y", "fold")


@query("split_replay", _SPLIT_SQL + """
SELECT vec_id, y, CASE WHEN rn <= ROUND(n * 0.25) THEN 1 ELSE 0 END AS replayed_test FROM r""")
def q_split_replay(spark, d):
    split = _split(spark, d)
    saved_test_ids = split.where("is_test = 1").select("vec_id")
    test, train = FE.split_by_ids(_emb(spark, d), saved_test_ids, "vec_id")
    part = lambda df, flag: df.select("vec_id", "y", F.lit(flag).alias("replayed_test"))
    return part(test, 1).unionByName(part(train, 0))


_NUM = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


_MEASURED = ", ".join(f"{c} AS x{i}" for i, c in enumerate(_NUM))


@query("variance_filter", f"""
WITH x AS (SELECT l_orderkey, l_linenumber, l_partkey, {_MEASURED} FROM lineitem),
v AS (SELECT {", ".join(f"VAR_POP(x{i}) > 0.001 AS k{i}" for i in range(len(_NUM)))} FROM x WHERE l_orderkey % 4 <> 0)
SELECT l_orderkey, l_linenumber, l_partkey,
       list_filter([{", ".join(f"CASE WHEN k{i} THEN ROUND(x{i}, 6) END" for i in range(len(_NUM)))}], lambda e: e IS NOT NULL) AS kept
FROM x, v WHERE l_orderkey % 4 = 0""")
def q_variance_filter(spark, d):
    """Fitted on three quarters of the orders, applied to the others."""
    key = ["l_orderkey", "l_linenumber", "l_partkey"]
    x = VectorAssembler(inputCols=_NUM, outputCol="features").transform(_b(spark, d, "lineitem").select(*key, *_NUM))
    model = SG.VarianceFilter("features", "kept", 0.001).fit(x.where("l_orderkey % 4 <> 0"))
    return model.transform(x.where("l_orderkey % 4 = 0")).select(*key, _rounded_array("kept").alias("kept"))


@query("standardize", _SPLIT_SQL + """,
t AS (SELECT vec_id, CAST(rn <= ROUND(n * 0.25) AS INTEGER) AS is_test FROM r),
x AS (SELECT vec_id, CAST(UNNEST(embedding) AS DOUBLE) AS v, generate_subscripts(embedding, 1) AS i FROM embeddings),
s AS (SELECT i, AVG(v) AS m, STDDEV_POP(v) AS sd FROM x JOIN t USING (vec_id) WHERE is_test = 0 GROUP BY i)
SELECT vec_id, is_test, list(ROUND(CASE WHEN sd = 0 THEN 0 ELSE (v - m) / sd END, 6) ORDER BY i) AS scaled
FROM x JOIN s USING (i) JOIN t USING (vec_id) GROUP BY vec_id, is_test""")
def q_standardize(spark, d):
    """Means and deviations of the training rows, applied to all."""
    split = keep(_split(spark, d))
    model = SG.PopulationScaler("features", "scaled").fit(split.where("is_test = 0"))
    return model.transform(split).select("vec_id", "is_test", _rounded_array("scaled").alias("scaled"))


def _projected(spark, d, *stages):
    """All rows through scaling and ``stages``, fitted on the training rows."""
    split = keep(_split(spark, d))
    model = Pipeline(stages=[SG.PopulationScaler("features", "scaled"), *stages]).fit(split.where("is_test = 0"))
    return model, model.transform(split)


_PCA = dict(k=8, inputCol="scaled", outputCol="pca")


@query("pca_project")
def q_pca(spark, d):
    _, out = _projected(spark, d, PCA(**_PCA))
    return out.select("vec_id", "is_test", vector_to_array("pca").alias("pca"))


@query("cumulative_share")
def q_cum_share(spark, d):
    """The shares fall, and add up to at most 1; a row that breaks this fails."""
    model, _ = _projected(spark, d, PCA(**_PCA))
    shares = FE.explained_share(spark, model.stages[-1])
    order = Window.orderBy("component")  # one row a component
    sound = (F.col("share") >= F.lead("share", 1, 0.0).over(order)) & (F.col("cumulative") <= 1.0 + 1e-9)
    return shares.withColumn("share", F.when(sound, F.col("share")).otherwise(F.raise_error(F.lit("shares are not in order")).cast("double")))


@query("fisher_discriminant")
def q_lda(spark, d):
    _, out = _projected(spark, d, SG.FisherDiscriminant("scaled", "lda", "label"))
    return out.select("vec_id", "y", "is_test", vector_to_array("lda")[0].alias("lda"))


@query("oversample_minority")
def q_smote(spark, d):
    e = _emb(spark, d, positive="label = 0").select("vec_id", "y", "features")
    out = svm_smote(e, "vec_id", "y", "features", minority=1, seed=SEED)
    return out.select("vec_id", "y", "synthetic", vector_to_array("features").alias("features"))


_SLOTS = [f"e{i}" for i in range(64)]


def _forest(trees=M.RF_CHOSEN["numTrees"]):
    return M.random_forest(trees=trees, depth=M.RF_CHOSEN["maxDepth"], impurity=M.RF_CHOSEN["impurity"],
                           max_features=M.RF_CHOSEN["featureSubsetStrategy"])


def _boosting():
    return M.gradient_boosting(trees=M.GBT_CHOSEN["maxIter"], depth=M.GBT_CHOSEN["maxDepth"])


def _at_once(spark):
    """Fits of a search that run side by side: one a core, at most 32."""
    return min(32, spark.sparkContext.defaultParallelism)


def _folded(spark, d):
    """Training rows with their fold, and the test rows."""
    split = keep(_split(spark, d))
    return keep(FE.fold_column(split.where("is_test = 0"), "vec_id", "y", M.CV_FOLDS, SEED)), split.where("is_test = 1")


@query("select_features")
def q_select_features(spark, d):
    """The slots, by name, that the forest, boosting or Lasso use on the
    training rows; every row's vector of them."""
    from revisit.plans.compare import Settings, choose_features
    train, _ = _folded(spark, d)
    names = choose_features(SP.with_names(train, "features", _SLOTS), Settings(), "features")
    every = SP.with_names(_emb(spark, d), "features", _SLOTS)
    return SP.keep_slots(every, "features", names["union"], "kept").select(
        "vec_id", F.lit(",".join(names["union"])).alias("names"), vector_to_array("kept").alias("features"))


# ------------------------------------------------------------------ 2.10 models


def _fit_score(spark, d, est, positive="label < 5"):
    split = keep(_split(spark, d, positive))
    model = est.fit(M.fit_rows(split.where("is_test = 0")))
    return EV.score_batch(model, split.where("is_test = 1"), keep=["vec_id", "y"])


@query("train_random_forest")
def q_rf(spark, d):
    return _fit_score(spark, d, _forest())


@query("train_gradient_boosting")
def q_gbt(spark, d):
    return _fit_score(spark, d, _boosting())


@query("train_boosted_shallow")
def q_gbt_shallow(spark, d):
    """Second-order boosting at the chosen settings."""
    split = keep(_split(spark, d))
    c = M.BOOSTER_CHOSEN
    model = BO.fit_booster(split.where("is_test = 0"), trees=c["maxIter"], depth=c["maxDepth"], rate=c["stepSize"])
    return BO.score_booster(split.where("is_test = 1"), model, ["vec_id", "y"])


@query("train_mlp")
def q_mlp(spark, d):
    """Both hidden layouts, cross-validated."""
    train, test = _folded(spark, d)
    cv = M.grid_search(train, M.perceptron(64), M.mlp_grid(64), fold_col="fold", folds=M.CV_FOLDS,
                       parallelism=_at_once(spark))
    return EV.score_batch(cv.bestModel, test, keep=["vec_id", "y"])


@query("train_linear_sgd")
def q_sgd(spark, d):
    """Log and modified Huber loss, three penalties, every strength,
    cross-validated on balanced rows."""
    train, test = _folded(spark, d)
    grid = {"loss": ["log", "modified_huber"], "penalty": ["l1", "l2", "elasticnet"], "alpha": M.STRENGTHS}
    fit, _ = GR.search(M.class_weights(train, "y"), grid, "fold", weight="weight", steps=60, tol=1e-4)
    return GR.decision(test, fit).select("vec_id", "y", (F.col("margin") > 0).cast("int").alias("prediction"),
                                         GR.probability("margin", fit.config.loss).alias("p1"))


@query("class_weights", """
WITH e AS (SELECT vec_id, CAST(label < 5 AS INTEGER) AS y FROM embeddings),
c AS (SELECT y, COUNT(*) AS nc FROM e GROUP BY y)
SELECT vec_id, e.y, ROUND((SELECT COUNT(*) FROM e) / ((SELECT COUNT(*) FROM c) * nc), 6) AS weight
FROM e JOIN c ON e.y = c.y""")
def q_class_weights(spark, d):
    e = _b(spark, d, "embeddings").select("vec_id", F.expr("CAST(label < 5 AS INT)").alias("y"))
    return M.class_weights(e, "y").select("vec_id", "y", r6("weight").alias("weight"))


@query("train_lasso")
def q_lasso(spark, d):
    train, test = _folded(spark, d)
    return LA.predict(test, LA.fit_lasso(train, "fold")).select("vec_id", "y", "score")


@query("train_logistic")
def q_logistic(spark, d):
    """Every strength C, cross-validated; alpha = 1 / (C n)."""
    train, test = _folded(spark, d)
    n = train.count()
    fit, _ = GR.search(train, {"loss": ["log"], "penalty": ["l2"], "alpha": [1.0 / (c * n) for c in M.STRENGTHS]}, "fold", steps=60, tol=1e-4)
    out = GR.decision(test, fit).withColumn("p1", GR.probability("margin", "log"))
    return out.select("vec_id", "y", (F.col("p1") >= 0.5).cast("int").alias("prediction"), "p1")


@query("grid_search_cv")
def q_grid(spark, d):
    """All points of the forest grid, all folds."""
    train, _ = _folded(spark, d)
    cv = M.grid_search(train, _forest(), M.RF_GRID, fold_col="fold", folds=M.CV_FOLDS, parallelism=_at_once(spark))
    best = M.best_params(cv)
    return spark.createDataFrame([(k, str(v)) for k, v in best.items()], "param string, value string")


@query("stack_models")
def q_stack(spark, d):
    split = keep(_split(spark, d))
    c = M.BOOSTER_CHOSEN
    model = M.stack(split.where("is_test = 0"), {"rf": _forest(), "gb": _boosting(), "xb": M.boosted_shallow(
        trees=c["maxIter"], depth=c["maxDepth"], rate=c["stepSize"])}, C=M.STACK_C)
    return EV.score_batch(model, split.where("is_test = 1"), keep=["vec_id", "y"])


@query("soft_vote", f"""
WITH s AS (SELECT event_id, value / 500 AS gb, (value % 100) / 100 AS rf, (value % 50) / 50 AS xb FROM events)
SELECT event_id, ROUND(gb, 6) AS gb, ROUND(rf, 6) AS rf, ROUND(xb, 6) AS xb,
       ROUND((2 * gb + 1 * rf + 1.5 * xb) / 4.5, 6) AS vote_p1,
       CAST((2 * gb + 1 * rf + 1.5 * xb) / 4.5 >= 0.5 AS INTEGER) AS vote_class FROM s""")
def q_vote(spark, d):
    ev = _b(spark, d, "events")
    value = F.col("value")
    scores = ev.select("event_id", (value / 500).alias("gb"), ((value % 100) / 100).alias("rf"), ((value % 50) / 50).alias("xb"))
    v = EV.soft_vote(scores, {"gb": 2.0, "rf": 1.0, "xb": 1.5})
    return v.select("event_id", *[r6(c).alias(c) for c in ("gb", "rf", "xb", "vote_p1")], "vote_class")


# ------------------------------------------------------------------ 2.11 scoring, evaluation


@query("predict_batch")
def q_predict(spark, d):
    return _fit_score(spark, d, _forest())


@query("accuracy", f"""
WITH e AS ({_EVENTS_SQL})
SELECT ROUND(AVG(CAST(y = CAST(score >= 250 AS INTEGER) AS DOUBLE)), 6) AS accuracy FROM e""")
def q_accuracy(spark, d):
    e = _events(spark, d).withColumn("pred", (F.col("score") >= 250).cast("int"))
    return EV.accuracy(e, "y", "pred").select(r6("accuracy").alias("accuracy"))


@query("roc_auc", f"""
WITH e AS ({_EVENTS_SQL}),
p AS (SELECT score, COUNT(*) FILTER (WHERE y = 1) AS pos, COUNT(*) FILTER (WHERE y <> 1) AS neg
      FROM e GROUP BY score),
r AS (SELECT *, SUM(neg) OVER (ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cum_neg FROM p)
SELECT ROUND(SUM(pos * (cum_neg - neg + 0.5 * neg)) / (SUM(pos) * SUM(neg)), 6) AS auc FROM r""")
def q_auc(spark, d):
    return EV.roc_auc(_events(spark, d), "y", "score").select(r6("auc").alias("auc"))


@query("confusion_matrix", f"""
WITH e AS ({_EVENTS_SQL}),
g AS (SELECT * FROM (VALUES (0, 0), (0, 1), (1, 0), (1, 1)) AS t(actual, predicted))
SELECT g.actual, g.predicted,
       (SELECT COUNT(*) FROM e WHERE e.y = g.actual AND CAST(e.score >= 250 AS INTEGER) = g.predicted) AS count
FROM g""")
def q_confusion(spark, d):
    e = _events(spark, d).withColumn("pred", (F.col("score") >= 250).cast("int"))
    return EV.confusion(e, "y", "pred")


@query("roc_curve", f"""
WITH e AS ({_EVENTS_SQL}),
p AS (SELECT score, COUNT(*) FILTER (WHERE y = 1) AS pos, COUNT(*) FILTER (WHERE y <> 1) AS neg
      FROM e GROUP BY score),
r AS (SELECT score,
             SUM(pos) OVER (ORDER BY score DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cp,
             SUM(neg) OVER (ORDER BY score DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cn
      FROM p)
SELECT score AS threshold, ROUND(cn / (SELECT SUM(neg) FROM p), 6) AS fpr,
       ROUND(cp / (SELECT SUM(pos) FROM p), 6) AS tpr FROM r
UNION ALL SELECT 'inf'::DOUBLE, 0.0, 0.0""")
def q_roc(spark, d):
    r = EV.roc_points(_events(spark, d), "y", "score")
    return r.select("threshold", r6("fpr").alias("fpr"), r6("tpr").alias("tpr"))


def _sens_spec_sql(ts):
    return f"""
WITH e AS ({_EVENTS_SQL}), t AS (SELECT UNNEST([{', '.join(f'CAST({float(x)} AS DOUBLE)' for x in ts)}]) AS threshold)
SELECT threshold,
       ROUND(COUNT(*) FILTER (WHERE y = 1 AND score > threshold) / COUNT(*) FILTER (WHERE y = 1), 6) AS sensitivity,
       ROUND(COUNT(*) FILTER (WHERE y <> 1 AND score <= threshold) / COUNT(*) FILTER (WHERE y <> 1), 6) AS specificity
FROM e, t GROUP BY threshold"""


@query("sens_spec_at_threshold", _sens_spec_sql([250]))
def q_sens_spec(spark, d):
    r = EV.at_threshold(_events(spark, d), "y", "score", 250)
    return r.select("threshold", r6("sensitivity").alias("sensitivity"), r6("specificity").alias("specificity"))


@query("sens_spec_sweep", _sens_spec_sql([100, 250]))
def q_sweep(spark, d):
    r = EV.at_thresholds(_events(spark, d), "y", "score", [100, 250])
    return r.select("threshold", r6("sensitivity").alias("sensitivity"), r6("specificity").alias("specificity"))


def _train_forest(spark, d):
    return _forest().fit(M.fit_rows(_split(spark, d).where("is_test = 0")))


@query("feature_importance")
def q_importance(spark, d):
    imp = EV.importances(spark, _train_forest(spark, d), _SLOTS)
    return imp.where(F.col("importance") > 0)  # the non-zero ones, highest first


@query("coefficients")
def q_coef(spark, d):
    """The non-zero ones at the strength that cross-validation picks."""
    train, _ = _folded(spark, d)
    w = LA.fit_lasso(train, "fold").weights
    return spark.createDataFrame([(n, float(v)) for n, v in zip(_SLOTS, w) if v], "feature string, coefficient double")


def _saved_nodes(spark, d):
    path = f"{checkpoint_dir(spark)}/revisit-models/{uuid.uuid4().hex}"
    M.save_model(_train_forest(spark, d), path)
    return EV.tree_nodes(spark, path)


@query("tree_nodes")
def q_tree_nodes(spark, d):
    """Every node of the forest; inner ones with the split spelled out."""
    nodes = _saved_nodes(spark, d)
    cut = EV.splits(nodes, _SLOTS).select("treeID", "id", "feature", "threshold", "left_categories")
    return nodes.select("treeID", "id", "prediction", "impurity", "gain", "leftChild", "rightChild").join(cut, ["treeID", "id"], "left")


@query("tree_leaf_rules")
def q_leaf_rules(spark, d):
    """The condition of every leaf of the forest, from the root down."""
    return EV.leaf_rules(_saved_nodes(spark, d), _SLOTS)


@query("prediction_frame", f"""
WITH e AS ({_EVENTS_SQL})
SELECT event_id, y, CAST(score >= 250 AS INTEGER) AS pred, score,
       CASE WHEN y = 1 THEN 'true_positive' ELSE 'true_negative' END AS half
FROM e WHERE y = CAST(score >= 250 AS INTEGER)""")
def q_pred_frame(spark, d):
    """Scores of the rows that are predicted right, of either class."""
    e = _events(spark, d).select("event_id", "y", (F.col("score") >= 250).cast("int").alias("pred"), "score")
    half = F.when(F.col("y") == 1, "true_positive").otherwise("true_negative")
    return e.where(F.col("y") == F.col("pred")).withColumn("half", half)


@query("score_range_check", """
SELECT COUNT(*) FILTER (WHERE value / 250 > 1) AS n_above, COUNT(*) FILTER (WHERE value / 250 < 0.6) AS n_below,
       ROUND(MAX(value / 250), 6) AS max_score FROM events""")
def q_score_range(spark, d):
    ev = _b(spark, d, "events").select((F.col("value") / 250).alias("s"))
    r = EV.score_range(ev, "s", 0.6, 1.0)
    return r.select("n_above", "n_below", r6("max_score").alias("max_score"))


# ------------------------------------------------------------------ the readmission model


@query("readmission_model")
def q_readmission_model(spark, d):
    from revisit.plans.model import train_readmission_model
    _, scored = train_readmission_model(spark, d, trees=M.RF_CHOSEN["numTrees"], depth=M.RF_CHOSEN["maxDepth"])
    return scored


@query("readmission_model_auc")
def q_readmission_auc(spark, d):
    scored = keep(q_readmission_model(spark, d))
    auc = EV.roc_auc(scored, "READMISSION_30dAYS", "p1").select(
        F.lit("roc_auc").alias("metric"), F.col("auc").alias("value"))
    acc = EV.accuracy(scored, "READMISSION_30dAYS", "prediction").select(
        F.lit("accuracy").alias("metric"), F.col("accuracy").alias("value"))
    return auc.unionByName(acc)


@query("model_comparison")
def q_model_comparison(spark, d):
    """All models at the chosen settings on the readmission table."""
    from revisit.plans.compare import compare_models
    return compare_models(spark, d)
