"""Cross-validated grid of a random forest without a fit per point.

A tree grown to a depth is the top of the tree grown deeper, and the first trees
of a forest are a forest.  The points that differ only in the number of trees or
the depth are therefore scored from one forest a fold, of the most trees and the
greatest depth: a prefix of the trees, each cut at the point's depth and pruned
as Spark prunes (sibling leaves of one class become one leaf).  Every point is
scored on every held-out row, by exact ROC AUC.

The forest is fitted in blocks of trees, so that the driver holds few nodes at a
time; block b has the seed plus b.  Where one block is enough, the points of the
most trees score as a fit of their own does.
"""

from __future__ import annotations

import uuid
from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from revisit.ml import evaluate as EV
from revisit.operators.ordered import ordered_scan
from revisit.session import checkpoint_dir

#: Nodes of a block of trees, at most.
NODES = 1 << 16
#: (row, tree) pairs that a task walks at a time.
PAIRS = 1 << 20


@dataclass
class Forest:
    """Nodes of all trees; a leaf has feature -1.  ``p`` is the share of class 1."""
    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    p: np.ndarray
    label: np.ndarray
    roots: np.ndarray

    def __add__(self, other: Forest) -> Forest:
        n = len(self.feature)
        both = lambda a, b: np.concatenate([a, b])
        return Forest(both(self.feature, other.feature), both(self.threshold, other.threshold), both(self.left, other.left + n),
                      both(self.right, other.right + n), both(self.p, other.p), both(self.label, other.label), both(self.roots, other.roots + n))

    def levels(self) -> list[np.ndarray]:
        """Inner nodes by depth."""
        out, at = [], self.roots
        while len(inner := at[self.feature[at] >= 0]):
            out.append(inner)
            at = np.concatenate([self.left[inner], self.right[inner]])
        return out

    def cut(self, depth: int, levels: Sequence[np.ndarray]) -> np.ndarray:
        """For each node the share of class 1 in the leaf that a row of that node
        ends in, when the trees are cut at ``depth`` and pruned."""
        leaf = self.feature < 0
        for inner in levels[depth:]:
            leaf[inner] = True
        for inner in reversed(levels[:depth]):
            a, b = self.left[inner], self.right[inner]
            leaf[inner] = leaf[a] & leaf[b] & (self.label[a] == self.label[b])
        p = self.p.copy()
        for inner in levels:
            ended = inner[leaf[inner]]
            for child in (self.left[ended], self.right[ended]):
                p[child], leaf[child] = p[ended], True
        return p

    def ends(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each row in each tree."""
        at = np.broadcast_to(self.roots, (len(x), len(self.roots))).copy()
        rows = np.arange(len(x))[:, None]
        while True:
            f = self.feature[at]
            inner = f >= 0
            if not inner.any():
                return at
            goes = x[rows, np.maximum(f, 0)] <= self.threshold[at]
            at = np.where(inner, np.where(goes, self.left[at], self.right[at]), at)


def shares_trees(estimator, grid: Mapping[str, Sequence]) -> bool:
    """Whether points of the grid can be scored from one forest."""
    return isinstance(estimator, RandomForestClassifier) and any(len(grid.get(n, ())) > 1 for n in ("numTrees", "maxDepth"))


def read_forest(model) -> Forest | None:
    """The nodes of a fitted forest by way of its saved form; None where a split
    is one of categories."""
    session = SparkSession.active()
    path = f"{checkpoint_dir(session).rstrip('/')}/revisit-models/{uuid.uuid4().hex}"
    model.write().save(path)
    stats = F.col("impurityStats")
    t = EV.tree_nodes(session, path).select(
        "treeID", "id", "leftChild", "rightChild", F.col("split.featureIndex").alias("f"), F.col("split.numCategories").alias("kinds"),
        F.coalesce(F.get("split.leftCategoriesOrThreshold", F.lit(0)), F.lit(0.0)).alias("threshold"), F.col("prediction").alias("label"),
        (F.coalesce(F.get(stats, F.lit(1)), F.lit(0.0)) / F.aggregate(stats, F.lit(0.0), lambda a, b: a + b)).alias("p")).toArrow()
    hadoop = session._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(session._jsc.hadoopConfiguration()).delete(hadoop, True)
    c = {n: t.column(n).to_numpy() for n in t.column_names}
    order = np.lexsort((c["id"], c["treeID"]))
    c = {n: v[order] for n, v in c.items()}
    if ((c["leftChild"] >= 0) & (c["kinds"] >= 0)).any():
        return None
    roots = np.flatnonzero(c["id"] == 0)
    start = roots[c["treeID"]]
    feature = np.where(c["leftChild"] >= 0, c["f"], -1).astype(np.int32)
    return Forest(feature, c["threshold"], (start + c["leftChild"]).astype(np.int32), (start + c["rightChild"]).astype(np.int32),
                  c["p"], c["label"].astype(np.int32), roots.astype(np.int32))


def held_out_scores(df: DataFrame, forest: Forest, trees: Sequence[int], depths: Sequence[int], features: str, label: str) -> DataFrame:
    """(y, score): for each row its score at every (trees, depth)."""
    levels = forest.levels()
    cuts = np.stack([forest.cut(d, levels) for d in depths])
    last = np.array(trees) - 1

    def batches(rows):
        step = max(1, PAIRS // len(forest.roots))
        for b in rows:
            if not len(b):
                continue
            x, out = b.column("x").flatten().to_numpy().reshape(len(b), -1), []
            for i in range(0, len(b), step):
                ends = forest.ends(x[i:i + step])
                out.append(np.stack([np.cumsum(p[ends], axis=1)[:, last] for p in cuts], axis=2).reshape(len(ends), -1))
            flat = np.concatenate(out)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(b) + 1) * flat.shape[1], pa.int32()), pa.array(flat.reshape(-1)))
            yield pa.RecordBatch.from_arrays([b.column("y"), lists], ["y", "score"])

    rows = df.select(vector_to_array(features).alias("x"), F.col(label).cast("double").alias("y"))
    return rows.mapInArrow(batches, "y double, score array<double>")


def areas(scores: DataFrame) -> dict[tuple[int, int], list[float]]:
    """Exact ROC AUC by (group, fold) and position in ``score``; as in Spark 0
    where no row is of class 1, else 1 where all are."""
    keys = ["grp", "fold", "i"]
    each = scores.select("grp", "fold", "y", F.posexplode("score").alias("i", "score"))
    per = each.groupBy(*keys, "score").agg(F.count_if(F.col("y") == 1).alias("pos"), F.count_if(F.col("y") != 1).alias("neg"))
    run = ordered_scan(per, keys, ["score"], running=[("neg", "upto")])
    area = F.sum(F.col("pos") * (F.col("upto") - F.col("neg") / 2)) / (F.sum("pos") * F.sum("neg"))
    got = run.groupBy(*keys).agg(F.when(F.sum("pos") == 0, 0.0).when(F.sum("neg") == 0, 1.0).otherwise(area).alias("auc"))
    out: dict[tuple[int, int], list[float]] = {}
    for r in got.orderBy(*keys).collect():  # points x folds rows
        out.setdefault((r["grp"], r["fold"]), []).append(r["auc"])
    return out


def fold_scores(df: DataFrame, estimator: RandomForestClassifier, grid: Mapping[str, Sequence], points: Sequence[Mapping], fold_col: str,
                sizes: Mapping[int, int], label: str, parallelism: int) -> dict[tuple[int, int], float] | None:
    """AUC of each (point, fold).  None where a forest splits by categories."""
    from revisit.ml.models import together
    trees, depths = (sorted(set(grid.get(n) or [estimator.getOrDefault(n)])) for n in ("numTrees", "maxDepth"))
    moving, groups = {estimator.numTrees, estimator.maxDepth}, {}
    for i, p in enumerate(points):
        rest = {k: v for k, v in p.items() if k not in moving}
        groups.setdefault(tuple(sorted((k.name, v) for k, v in rest.items())), (rest, []))[1].append(i)
    spark, features = df.sparkSession, estimator.getFeaturesCol()
    folder = f"{checkpoint_dir(spark).rstrip('/')}/grid-scores-{uuid.uuid4().hex}"

    def one(g: int, rest: Mapping, fold: int) -> bool:
        rows = sum(sizes.values()) - sizes[fold]
        blocks = ceil(trees[-1] * min(2 << depths[-1], rows + 1) / NODES)
        size = ceil(trees[-1] / blocks)
        train, forest = df.where(F.col(fold_col) != fold), None
        for b, first in enumerate(range(0, trees[-1], size)):
            part = {**rest, estimator.numTrees: min(size, trees[-1] - first), estimator.maxDepth: depths[-1],
                    estimator.seed: estimator.getSeed() + b}
            got = read_forest(estimator.fit(train, part))
            if got is None:
                return False
            forest = got if forest is None else forest + got
        held_out_scores(df.where(F.col(fold_col) == fold), forest, trees, depths, features, label).select(
            F.lit(g).alias("grp"), F.lit(fold).alias("fold"), "y", "score").write.parquet(f"{folder}/{g}-{fold}")
        spark._jvm.System.gc()  # Spark drops the shuffle files of the fits when their objects are gone
        return True

    jobs = {(g, k): lambda g=g, r=rest, k=k: one(g, r, k) for g, (rest, _) in enumerate(groups.values()) for k in sizes}
    if not all(together(jobs, parallelism).values()):
        return None
    by = areas(spark.read.parquet(*[f"{folder}/{g}-{k}" for g, k in jobs]))
    place = {(n, d): i for i, (n, d) in enumerate((n, d) for n in trees for d in depths)}
    value = lambda p, param: p.get(param, estimator.getOrDefault(param))
    return {(i, k): by[g, k][place[value(points[i], estimator.numTrees), value(points[i], estimator.maxDepth)]]
            for g, (_, own) in enumerate(groups.values()) for i in own for k in sizes}
