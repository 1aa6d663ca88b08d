"""Feature preparation: encoding, splits, folds, filters, scaling, projections
and minority oversampling.

Fitting steps aggregate on the executors and bring back only per-column or
per-class statistics (bounded by the number of features or classes, never by
the number of rows).  Applying a fit is a column expression.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
from pyspark.ml.feature import OneHotEncoder, StringIndexer, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from revisit.operators.ordered import ordered_scan

# ---------------------------------------------------------------- encoding


def one_hot(df: DataFrame, vocab: Mapping[str, Sequence[str]], keep_source: bool = False) -> DataFrame:
    """Wide 0/1 columns ``<col>_<value>`` for every value of a fitted
    vocabulary; a null or unseen value gives all zeros, no level is dropped."""
    cols = [(F.col(c).eqNullSafe(F.lit(v))).cast("int").alias(f"{c}_{v}")
            for c, values in vocab.items() for v in values]
    base = df.columns if keep_source else [c for c in df.columns if c not in vocab]
    return df.select(*base, *cols)


def one_hot_stages(cols: Sequence[str]) -> list:
    """The same encoding as ML stages: the index of unseen/null values is the
    dropped last slot, so no real category is lost."""
    idx = [StringIndexer(inputCol=c, outputCol=f"{c}__idx", handleInvalid="keep",
                         stringOrderType="alphabetAsc") for c in cols]
    ohe = OneHotEncoder(inputCols=[f"{c}__idx" for c in cols], outputCols=[f"{c}__vec" for c in cols],
                        dropLast=True)
    return [*idx, ohe]


def assemble(df: DataFrame, exclude: Sequence[str], output: str = "features") -> DataFrame:
    """All numeric columns except ``exclude`` (ids, labels) into one vector."""
    numeric = [f.name for f in df.schema.fields
               if f.name not in exclude and f.dataType.typeName() in
               ("integer", "long", "double", "float", "short", "byte")]
    return VectorAssembler(inputCols=numeric, outputCol=output, handleInvalid="error").transform(df)


def embedding_features(df: DataFrame, col: str = "embedding", output: str = "features") -> DataFrame:
    """array<float> column to an ML vector (JVM-side, no UDF)."""
    return df.withColumn(output, array_to_vector(F.col(col).cast("array<double>")))


# ---------------------------------------------------------------- splits and folds


def _hash_order(key: str, seed: int) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")))


def _ranked_in_class(df: DataFrame, key: str, label: str, seed: int) -> tuple[DataFrame, DataFrame]:
    """Rows ranked within their class, and the class sizes (_class, _n)."""
    sizes = df.groupBy(F.col(label).alias("_class")).agg(F.count(F.lit(1)).alias("_n"))
    ranked = ordered_scan(df.withColumn("_h", _hash_order(key, seed)), [label],
                          [F.col("_h"), F.col(key)], rn="_rn")
    return ranked, sizes


def stratified_split(df: DataFrame, key: str, label: str, test_frac: float = 0.25,
                     seed: int = 2017, out: str = "is_test") -> DataFrame:
    """Exact stratified split: within each class, rows ordered by
    md5(seed:key); the first round(test_frac · class size) go to test.

    Independent of partitioning and of row order, and reproducible in SQL.
    The per-class order runs through ``ordered_scan`` (a class may hold half
    of the rows; a plain window would then put it in one task).  Class sizes
    are joined, so any number of classes works; null labels are a class."""
    ranked, sizes = _ranked_in_class(df, key, label, seed)
    cut = F.floor(F.col("_n") * F.lit(float(test_frac)) + 0.5)  # round half up
    return (ranked.join(sizes, F.col(label).eqNullSafe(F.col("_class")))
            .withColumn(out, (F.col("_rn") <= cut).cast("int")).drop("_h", "_rn", "_n", "_class"))


def fold_column(df: DataFrame, key: str, label: str, k: int = 10, seed: int = 2017,
                out: str = "fold") -> DataFrame:
    """Class-balanced fold number 0..k−1: position in md5 order within the
    class, modulo k."""
    ranked, _ = _ranked_in_class(df, key, label, seed)
    return ranked.withColumn(out, ((F.col("_rn") - 1) % k).cast("int")).drop("_h", "_rn")


def split_by_ids(df: DataFrame, ids: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Rebuild a split from saved ids: (rows with a saved id, the rest)."""
    return df.join(ids.select(key), key, "left_semi"), df.join(ids.select(key), key, "left_anti")


# ---------------------------------------------------------------- filters and scaling


def fit_variances(df: DataFrame, cols: Sequence[str]) -> dict[str, float]:
    """Population variance (ddof 0) of each column, one pass."""
    row = df.agg(*[F.var_pop(c).alias(c) for c in cols]).first()
    return {c: row[c] for c in cols}


def variance_filter(train: DataFrame, cols: Sequence[str], threshold: float = 0.001) -> list[str]:
    """Columns whose population variance on ``train`` exceeds the threshold."""
    v = fit_variances(train, cols)
    return [c for c in cols if v[c] is not None and v[c] > threshold]


def fit_standardizer(df: DataFrame, cols: Sequence[str]) -> dict[str, tuple[float, float]]:
    """(mean, population std) per column."""
    aggs = []
    for c in cols:
        aggs += [F.avg(c).alias(f"m_{c}"), F.stddev_pop(c).alias(f"s_{c}")]
    row = df.agg(*aggs).first()
    return {c: (row[f"m_{c}"], row[f"s_{c}"]) for c in cols}


def standardize(df: DataFrame, fit: Mapping[str, tuple[float, float]]) -> DataFrame:
    """(x − mean) / std with the fitted statistics; zero-variance columns → 0."""
    cols = {}
    for c, (m, s) in fit.items():
        cols[c] = F.lit(0.0) if not s else (F.col(c) - F.lit(m)) / F.lit(s)
    return df.withColumns(cols)


def vector_stats(df: DataFrame, features: str = "features") -> tuple[np.ndarray, np.ndarray, int]:
    """Mean and population std of each vector slot (distributed Summarizer)."""
    from pyspark.ml.stat import Summarizer
    row = df.select(Summarizer.metrics("mean", "variance", "count").summary(F.col(features)).alias("s")).first()
    n = int(row.s["count"])
    var = row.s["variance"].toArray() * ((n - 1) / n if n > 1 else 0.0)  # sample → population
    return row.s["mean"].toArray(), np.sqrt(var), n


def standardize_vector(df: DataFrame, mean: np.ndarray, std: np.ndarray,
                       features: str = "features", output: str = "scaled") -> DataFrame:
    """Vector form of ``standardize`` as array arithmetic (no UDF)."""
    inv = [0.0 if s == 0 else 1.0 / float(s) for s in std]
    arr = vector_to_array(F.col(features))
    m = F.array(*[F.lit(float(x)) for x in mean])
    k = F.array(*[F.lit(x) for x in inv])
    scaled = F.zip_with(F.zip_with(arr, m, lambda x, y: x - y), k, lambda x, y: x * y)
    return df.withColumn(output, array_to_vector(scaled))


# ---------------------------------------------------------------- projections


def fit_pca(df: DataFrame, k: int, features: str = "scaled", output: str = "pca"):
    """Principal components of already-centred (standardised) vectors.
    Spark's PCA does not centre, hence the standardised input."""
    from pyspark.ml.feature import PCA
    return PCA(k=k, inputCol=features, outputCol=output).fit(df)


def explained_share(spark, model) -> DataFrame:
    """(component, share, cumulative share): k rows."""
    shares = [float(x) for x in model.explainedVariance.toArray()]
    cum = np.cumsum(shares).tolist()
    return spark.createDataFrame([(i, s, c) for i, (s, c) in enumerate(zip(shares, cum))],
                                 "component int, share double, cumulative double")


def fit_discriminant(df: DataFrame, label: str, features: str = "features") -> dict:
    """Fisher linear discriminant for two classes: w = Sw⁻¹ (μ1 − μ0).

    Per class, the mean and variance come from ``Summarizer`` and the
    correlation matrix from ``ml.stat.Correlation`` (both distributed tree
    aggregations on the JVM); covariance = D·R·D.  Only d-sized statistics
    reach the driver, where the d×d system is solved."""
    from pyspark.ml.stat import Correlation, Summarizer
    stats = {}
    for cls in (0, 1):
        part = df.where(F.col(label) == cls).select(features)
        s = part.select(Summarizer.metrics("mean", "variance", "count").summary(F.col(features))
                        .alias("s")).first().s
        mu, var, n = s["mean"].toArray(), s["variance"].toArray(), int(s["count"])
        corr = np.nan_to_num(Correlation.corr(part, features).first()[0].toArray())
        sd = np.sqrt(var)
        stats[cls] = (mu, (n - 1) * corr * np.outer(sd, sd), n)
    sw = stats[0][1] + stats[1][1]
    w = np.linalg.solve(sw + 1e-9 * np.eye(sw.shape[0]), stats[1][0] - stats[0][0])
    mid = float(w @ (stats[0][0] + stats[1][0]) / 2)
    return {"w": w, "threshold": mid}


def project(df: DataFrame, w: Sequence[float], features: str = "features", output: str = "lda") -> DataFrame:
    """Dot product with a fixed direction, as array arithmetic."""
    arr = vector_to_array(F.col(features))
    prod = F.zip_with(arr, F.array(*[F.lit(float(x)) for x in w]), lambda x, y: x * y)
    return df.withColumn(output, F.aggregate(prod, F.lit(0.0), lambda acc, x: acc + x))


# ---------------------------------------------------------------- oversampling


#: Bytes of vectors that the exact neighbour search may broadcast.
EXACT_BYTES = 256 << 20
#: Distances that a task of the exact neighbour search holds at once (32 MB).
KNN_CELLS = 4 << 20


def _projection_neighbours(pts: DataFrame, key: str, d: int, k: int, seed: int,
                           projections: int, window: int) -> DataFrame:
    """Approximate k nearest neighbours: candidates are the points within
    ``window`` positions along each of ``projections`` seeded random
    directions (an equi-join on position blocks, at most 3·window partners per
    point and direction), ranked by exact distance."""
    from pyspark.sql import Window
    rng = np.random.default_rng(seed)
    cands = None
    for _ in range(projections):
        v = rng.standard_normal(d)
        proj = F.aggregate(F.zip_with(F.col("_x"), F.array(*[F.lit(float(t)) for t in v]),
                                      lambda a, b: a * b), F.lit(0.0), lambda acc, t: acc + t)
        ranked = ordered_scan(pts.withColumn("_p", proj), [], [F.col("_p"), F.col(key)], rn="_rn")
        blk = F.floor((F.col("_rn") - 1) / window)
        a = ranked.select(F.col(key).alias("_a"), F.col("_rn").alias("_ra"),
                          F.explode(F.array(blk - 1, blk, blk + 1)).alias("_b"))
        b = ranked.select(F.col(key).alias("_c"), blk.alias("_b"), F.col("_rn").alias("_rc"))
        near = a.join(b, "_b")  # equi-join on block
        near = near.where((F.col("_a") != F.col("_c")) & (F.abs(F.col("_ra") - F.col("_rc")) <= window))
        cands = near.select("_a", "_c") if cands is None else cands.unionByName(near.select("_a", "_c"))
    xa = pts.select(F.col(key).alias("_a"), F.col("_x").alias("_xa"))
    xc = pts.select(F.col(key).alias("_c"), F.col("_x").alias("_xc2"))
    dist = cands.distinct().join(xa, "_a").join(xc, "_c").withColumn(
        "_d", F.aggregate(F.zip_with("_xa", "_xc2", lambda p, q: (p - q) * (p - q)), F.lit(0.0),
                          lambda acc, t: acc + t))
    w = Window.partitionBy("_a").orderBy("_d", "_c")  # group = one point's candidates (bounded)
    return dist.withColumn("_j", F.row_number().over(w)).where(F.col("_j") <= k).select("_a", "_c", "_j")


def _exact_neighbours(pts: DataFrame, key: str, k: int) -> DataFrame:
    """Exact k nearest neighbours within a minority set of checked, bounded
    size: the set is broadcast once as a matrix and every task computes its
    rows' distances to it, ``KNN_CELLS`` distances at a time (Spark partitions
    the query points)."""
    import pandas as pd
    rows = pts.select(key, "_x").collect()
    ids = np.array([r[0] for r in rows])
    mat = np.array([r[1] for r in rows], dtype=np.float64)
    bc = pts.sparkSession.sparkContext.broadcast((ids, mat, (mat * mat).sum(axis=1)))
    kk = min(k, len(ids) - 1)

    def knn(batches):
        all_ids, all_x, all_sq = bc.value
        step = max(1, KNN_CELLS // max(1, len(all_ids)))
        for pdf in (whole[i:i + step] for whole in batches for i in range(0, len(whole), step)):
            q = np.stack(pdf["_x"].to_numpy()).astype(np.float64)
            d2 = (q * q).sum(axis=1)[:, None] + all_sq[None, :] - 2.0 * q @ all_x.T
            self_mask = pdf[key].to_numpy()[:, None] == all_ids[None, :]
            d2[self_mask] = np.inf
            # order by (distance, id) for a deterministic tie-break
            order = np.lexsort((np.broadcast_to(all_ids, d2.shape), d2), axis=1)[:, :kk]
            yield pd.DataFrame({
                "_a": np.repeat(pdf[key].to_numpy(), kk),
                "_c": all_ids[order].reshape(-1),
                "_j": np.tile(np.arange(1, kk + 1, dtype=np.int32), len(pdf)),
            })

    key_type = pts.schema[key].dataType.simpleString()
    return pts.select(key, "_x").mapInPandas(knn, f"_a {key_type}, _c {key_type}, _j int")


def smote(df: DataFrame, key: str, label: str, features: str = "features", minority: int = 1,
          k: int = 5, seed: int = 2017, projections: int = 8, window: int = 8,
          neighbours: str = "projections", provenance: bool = False) -> DataFrame:
    """SMOTE: add synthetic minority rows until both classes have equal size.

    Each synthetic row is x + u·(x' − x): x a minority point (points are
    used in turn), x' one of its k nearest minority neighbours and u in
    [0, 1) - both picked from a hash of (seed, key, copy), so the output is
    deterministic.

    The caller chooses the neighbour search, the size of the data never does.
    ``projections``: ``_projection_neighbours``, an approximate search with
    ``3 * window`` candidates per point and direction, at any size.  ``exact``:
    the minority points are broadcast and every distance is computed; more
    than ``EXACT_BYTES`` of vectors raise.
    Output: the input rows (synthetic = 0) plus synthetic rows (key = null,
    synthetic = 1).  With ``provenance`` three more columns tell, for a
    synthetic row, its source point, the neighbour and the fraction u."""
    mino = df.where(F.col(label) == minority).select(key, features)
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("n")).collect()
    by = {r[label]: r["n"] for r in counts}
    n_min = by.get(minority, 0)
    n_maj = max((v for c, v in by.items() if c != minority), default=0)
    need = n_maj - n_min
    base = df.withColumn("synthetic", F.lit(0))
    if need <= 0 or n_min < 2:
        return base
    arr = vector_to_array(F.col(features))
    pts = mino.select(key, arr.alias("_x"))
    d = len(mino.first()[features])
    if neighbours == "exact":
        if 8 * n_min * d > EXACT_BYTES:
            raise ValueError(f"{n_min} points of {d} features exceed the broadcast bound; use neighbours='projections'")
        knn = _exact_neighbours(pts, key, k)
    else:
        knn = _projection_neighbours(pts, key, d, k, seed, projections, window)
    knn = knn.join(pts.select(F.col(key).alias("_c"), F.col("_x").alias("_xc")), "_c")
    # copies: synthetic row number s = 0..need−1 goes to minority point s mod n_min
    ranked_min = ordered_scan(pts, [], [F.col(key)], rn="_m")
    reps = (need + n_min - 1) // n_min
    copies = ranked_min.select(key, "_x", "_m", F.explode(F.sequence(F.lit(0), F.lit(reps - 1))).alias("_copy"))
    copies = copies.where((F.col("_copy") * n_min + F.col("_m") - 1) < need)
    hsh = F.xxhash64(F.lit(seed), F.col(key), F.col("_copy"))
    copies = copies.withColumn("_pick", (F.abs(hsh) % k + 1).cast("int")).withColumn(
        "_u", (F.abs(F.xxhash64(hsh)) % 1_000_000) / 1_000_000.0)
    # a point with fewer than k neighbours uses its last one
    nk = knn.groupBy("_a").agg(F.max("_j").alias("_kmax"))
    c2 = copies.join(nk, copies[key] == nk["_a"]).withColumn("_pick", F.least("_pick", "_kmax"))
    syn = c2.join(knn.select(F.col("_a").alias("_a2"), "_j", "_c", "_xc"),
                  (c2["_a"] == F.col("_a2")) & (c2["_pick"] == F.col("_j")))
    new = F.zip_with("_x", "_xc", lambda p, q: p + (q - p) * F.col("_u"))
    out_cols = []
    for f in df.schema.fields:
        if f.name == features:
            out_cols.append(array_to_vector(new).alias(features))
        elif f.name == label:
            out_cols.append(F.lit(minority).cast(f.dataType).alias(label))
        else:
            out_cols.append(F.lit(None).cast(f.dataType).alias(f.name))
    synth = syn.select(*out_cols, F.lit(1).alias("synthetic"),
                       *([F.col(key).alias("_src"), F.col("_c").alias("_nbr"), F.col("_u")] if provenance else []))
    if provenance:
        kt = df.schema[key].dataType
        base = base.select("*", F.lit(None).cast(kt).alias("_src"), F.lit(None).cast(kt).alias("_nbr"),
                           F.lit(None).cast("double").alias("_u"))
    return base.unionByName(synth)


def select_features(df: DataFrame, names: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    return df.select(*keep, *names)
