"""Scoring and evaluation on (label, prediction, score) columns.

All metrics are aggregates.  Curve and AUC computations first aggregate per
distinct score (partial, map-side), then take running sums over the sorted
distinct scores with the skew-safe ``ordered_scan`` - no global single-task
window, however many distinct scores there are.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from revisit.operators.ordered import ordered_scan
from revisit.session import keep as keep_frame


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def score_batch(model, df: DataFrame, keep: Sequence[str] = (), prob: str = "probability") -> DataFrame:
    """Class and P(class 1) per row from a fitted ML model."""
    out = model.transform(df)
    cols = [*keep, F.col("prediction").cast("int").alias("prediction")]
    if prob in out.columns:
        cols.append(vector_to_array(F.col(prob))[1].alias("p1"))
    return out.select(*cols)


def accuracy(df: DataFrame, y: str, p: str) -> DataFrame:
    return df.agg(F.avg((_c(y) == _c(p)).cast("double")).alias("accuracy"))


def _per_score(df: DataFrame, y: str, s: str) -> DataFrame:
    return df.where(_c(s).isNotNull()).groupBy(_c(s).cast("double").alias("score")).agg(
        F.count_if(_c(y) == 1).alias("pos"), F.count_if(_c(y) != 1).alias("neg"))


def roc_auc(df: DataFrame, y: str, s: str) -> DataFrame:
    """Exact area under the ROC curve; tied scores count one half.  Null when
    only one class is there."""
    per = _per_score(df, y, s)
    run = ordered_scan(per, [], [F.col("score").asc()], running=[("neg", "cum_neg")])
    below = F.col("cum_neg") - F.col("neg")
    t = run.agg(F.sum(F.col("pos") * (below + 0.5 * F.col("neg"))).alias("_num"),
                F.sum("pos").alias("_p"), F.sum("neg").alias("_n"))
    return t.select(F.try_divide(F.col("_num"), F.col("_p") * F.col("_n")).alias("auc"))


def confusion(df: DataFrame, y: str, p: str) -> DataFrame:
    """(actual, predicted, count) for the full 2×2 grid, empty cells as 0."""
    cells = [(a, b) for a in (0, 1) for b in (0, 1)]
    wide = df.agg(*[F.count_if((_c(y) == a) & (_c(p) == b)).alias(f"c{a}{b}") for a, b in cells])
    return wide.select(F.explode(F.array(*[
        F.struct(F.lit(a).alias("actual"), F.lit(b).alias("predicted"), F.col(f"c{a}{b}").alias("count"))
        for a, b in cells])).alias("s")).select("s.*")


def roc_points(df: DataFrame, y: str, s: str) -> DataFrame:
    """(threshold, fpr, tpr) at every distinct score, highest first, plus the
    origin (threshold +inf).  Collinear points are kept."""
    per = keep_frame(_per_score(df, y, s))  # read by the totals and the scan
    tot = per.agg(F.sum("pos").alias("P"), F.sum("neg").alias("N")).first()
    run = ordered_scan(per, [], [F.col("score").desc()], running=[("pos", "cum_pos"), ("neg", "cum_neg")])
    P, N = float(tot["P"] or 0), float(tot["N"] or 0)
    pts = run.select(F.col("score").alias("threshold"),
                     F.try_divide("cum_neg", F.lit(N)).alias("fpr"), F.try_divide("cum_pos", F.lit(P)).alias("tpr"))
    origin = per.agg(F.lit(float("inf")).alias("threshold"), F.lit(0.0).alias("fpr"), F.lit(0.0).alias("tpr"))
    return pts.unionByName(origin)


def at_threshold(df: DataFrame, y: str, s: str, t: float) -> DataFrame:
    """Sensitivity and specificity when 'positive' means score > t."""
    return at_thresholds(df, y, s, [t])


def at_thresholds(df: DataFrame, y: str, s: str, ts: Sequence[float]) -> DataFrame:
    """(threshold, sensitivity, specificity) for several thresholds, one pass."""
    e = df.select(_c(y).alias("_y"), _c(s).alias("_s"),
                  F.explode(F.array(*[F.lit(float(t)) for t in ts])).alias("threshold"))
    pos = F.col("_s") > F.col("threshold")
    return e.groupBy("threshold").agg(
        F.try_divide(F.count_if((F.col("_y") == 1) & pos), F.count_if(F.col("_y") == 1)).alias("sensitivity"),
        F.try_divide(F.count_if((F.col("_y") != 1) & ~pos), F.count_if(F.col("_y") != 1)).alias("specificity"))


def importances(spark, model, names: Sequence[str]) -> DataFrame:
    """(feature, importance) sorted, highest first."""
    imp = model.featureImportances.toArray()
    rows = sorted(((n, float(v)) for n, v in zip(names, imp)), key=lambda r: (-r[1], r[0]))
    return spark.createDataFrame(rows, "feature string, importance double")


def coefficients(spark, model, names: Sequence[str]) -> DataFrame:
    """(feature, coefficient) of a linear model."""
    coef = model.coefficients.toArray()
    return spark.createDataFrame([(n, float(v)) for n, v in zip(names, coef)],
                                 "feature string, coefficient double")


def tree_nodes(spark, model_path: str) -> DataFrame:
    """Node table of a saved tree ensemble: tree id, node id, prediction,
    impurity, gain, children and split (the data Spark persists)."""
    data = spark.read.parquet(f"{model_path}/data")
    if "treeID" in data.columns:
        return data.select("treeID", "nodeData.*")
    return data.select(F.lit(0).alias("treeID"), "*")


def splits(nodes: DataFrame, names: Sequence[str]) -> DataFrame:
    """The split of each inner node, spelled out: feature name, threshold (left:
    at most it) or the categories that go left, and the two conditions as SQL."""
    split = F.col("split")
    lookup = F.array(*[F.lit(n) for n in names])
    inner = nodes.where("leftChild >= 0")
    feature = F.element_at(lookup, split["featureIndex"] + 1)
    number = lambda c: F.concat(c.cast("string"), F.lit("D"))
    continuous = split["numCategories"] < 0
    cut = F.when(continuous, split["leftCategoriesOrThreshold"][0])
    listed = F.when(~continuous, split["leftCategoriesOrThreshold"])
    among = F.concat(F.lit(" IN ("), F.array_join(F.transform(listed, number), ", "), F.lit(")"))
    quoted = F.concat(F.lit("`"), F.replace(feature, F.lit("`"), F.lit("``")), F.lit("`"))
    left = F.when(continuous, F.concat(quoted, F.lit(" <= "), number(cut))).otherwise(F.concat(quoted, among))
    right = F.when(continuous, F.concat(quoted, F.lit(" > "), number(cut))).otherwise(F.concat(F.lit("NOT "), quoted, among))
    return inner.select("treeID", "id", feature.alias("feature"), cut.alias("threshold"), listed.alias("left_categories"), "gain",
                        "leftChild", "rightChild", left.alias("left_rule"), right.alias("right_rule"))


def leaf_rules(nodes: DataFrame, names: Sequence[str]) -> DataFrame:
    """(treeID, id, prediction, depth, rule): the conditions from the root to
    each leaf as one SQL condition, by a recursive query over parent and child."""
    cut = splits(nodes, names)
    step = cut.select("treeID", F.col("leftChild").alias("child"), F.col("id").alias("parent"), F.col("left_rule").alias("rule")).unionByName(
        cut.select("treeID", F.col("rightChild").alias("child"), F.col("id").alias("parent"), F.col("right_rule").alias("rule")))
    return nodes.sparkSession.sql("""
        WITH RECURSIVE walk(treeID, id, depth, rule) AS (
          SELECT DISTINCT treeID, 0, 0, '' FROM {nodes}
          UNION ALL
          SELECT w.treeID, s.child, w.depth + 1, CASE WHEN w.rule = '' THEN s.rule ELSE concat(w.rule, ' AND ', s.rule) END
          FROM walk w JOIN {step} s ON w.treeID = s.treeID AND w.id = s.parent)
        SELECT w.treeID, w.id, n.prediction, w.depth, CASE WHEN w.rule = '' THEN 'true' ELSE w.rule END AS rule
        FROM walk w JOIN {nodes} n ON w.treeID = n.treeID AND w.id = n.id WHERE n.leftChild < 0""", nodes=nodes, step=step)


def soft_vote(scores: DataFrame, weights: dict[str, float], threshold: float = 0.5) -> DataFrame:
    """Weighted mean of class-1 probabilities held in the named columns
    (rows already aligned by key); class = mean ≥ threshold."""
    total = sum(weights.values())
    mean = sum(F.col(c) * F.lit(w) for c, w in weights.items()) / F.lit(total)
    return scores.withColumn("vote_p1", mean).withColumn(
        "vote_class", (F.col("vote_p1") >= threshold).cast("int"))


def score_range(df: DataFrame, s: str, low: float = 0.0, high: float = 1.0) -> DataFrame:
    """Scores outside [low, high], and the maximum."""
    return df.agg(F.count_if(_c(s) > high).alias("n_above"), F.count_if(_c(s) < low).alias("n_below"),
                  F.max(s).alias("max_score"))
