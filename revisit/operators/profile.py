"""Aggregates and data profiling: counts, distincts, nulls, quantiles, bins,
correlations, variances, histograms and density grids.

Every aggregate here is partial (map-side combine), so a hot group is reduced
on each map task before the shuffle.  Where a statistic needs a global order
(quantiles), values are first counted per distinct value and the running count
is taken with the skew-safe ``ordered_scan``; only the handful of order
statistics asked for reach the driver.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from revisit.operators.ordered import ordered_scan
from revisit.session import keep

# ---------------------------------------------------------------- counting


def group_count(df: DataFrame, key: str, out: str = "count") -> DataFrame:
    """Rows per key; null keys left out (as a pandas groupby does)."""
    return df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias(out))


def group_nonnull(df: DataFrame, key: str) -> DataFrame:
    """Per group, the non-null count of every other column."""
    return df.where(F.col(key).isNotNull()).groupBy(key).agg(
        *[F.count(c).alias(c) for c in df.columns if c != key])


def group_count_two_keys(df: DataFrame, a: str, b: str, value: str, out: str = "count") -> DataFrame:
    """Non-null ``value`` count by (a, b); rows with a null key are left out."""
    return (df.where(F.col(a).isNotNull() & F.col(b).isNotNull())
            .groupBy(a, b).agg(F.count(value).alias(out)))


def distinct_values(df: DataFrame, c: str) -> DataFrame:
    return df.select(c).distinct()


def n_distinct(df: DataFrame, c: str, null_counts: bool = True) -> DataFrame:
    """Number of distinct values; with ``null_counts`` a null counts as one."""
    n = F.count_distinct(c)
    if null_counts:
        n = n + F.coalesce(F.max(F.col(c).isNull().cast("long")), F.lit(0))
    return df.agg(n.alias("n_distinct"))


def multiplicity(df: DataFrame, c: str) -> DataFrame:
    """Non-null rows, distinct values and the surplus (rows − distinct).  A
    positive surplus means some value occurs more than once."""
    return df.agg(F.count(c).alias("n_rows"), F.count_distinct(c).alias("n_distinct")).select(
        "n_rows", "n_distinct", (F.col("n_rows") - F.col("n_distinct")).alias("n_extra"))


def is_unique(df: DataFrame, c: str) -> DataFrame:
    """One row: the number of values occurring more than once (0 = unique)."""
    dup = df.groupBy(c).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1")
    return dup.agg(F.count(F.lit(1)).alias("n_repeated_values"))


def value_counts(df: DataFrame, c: str, out: str = "count") -> DataFrame:
    """Frequency of each non-null value, most frequent first."""
    return (df.where(F.col(c).isNotNull()).groupBy(c).agg(F.count(F.lit(1)).alias(out))
            .orderBy(F.col(out).desc(), F.col(c).asc()))


def count_where(df: DataFrame, cond: Column, out: str = "n") -> DataFrame:
    return df.agg(F.count_if(cond).alias(out))


def crosstab(df: DataFrame, row: str, col: str, vocab: Sequence[str]) -> DataFrame:
    """Row × value counts as columns (absent = 0); null values are dropped.
    The vocabulary is passed in (fitted once), so no extra job discovers it
    and the output schema is fixed."""
    return (df.where(F.col(col).isNotNull()).groupBy(row).pivot(col, list(vocab))
            .agg(F.count(F.lit(1))).fillna(0, subset=list(vocab)))


def fit_vocab(df: DataFrame, col: str) -> list:
    """Sorted distinct non-null values of a column: the fitted vocabulary of a
    crosstab or one-hot step (its size is the number of output columns)."""
    return fit_vocabs(df, [col])[col]


MAX_VOCAB = 100_000


def fit_vocabs(df: DataFrame, cols: Sequence[str], max_values: int = MAX_VOCAB) -> dict[str, list]:
    """Vocabularies of several columns in one distributed pass: distinct
    (column, value) pairs; only the vocabularies reach the driver.  Each value
    becomes an output column, so the total is checked against ``max_values``
    (an id-like column would otherwise be pulled to the driver whole)."""
    pairs = df.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("c"), F.col(c).cast("string").alias("v")) for c in cols])).alias("p"))
    rows = pairs.select("p.*").where(F.col("v").isNotNull()).distinct().limit(max_values + 1).collect()
    if len(rows) > max_values:
        raise ValueError(f"more than {max_values} distinct values in {list(cols)}: not a vocabulary")
    out: dict[str, list] = {c: [] for c in cols}
    for r in rows:
        out[r["c"]].append(r["v"])
    return {c: sorted(v) for c, v in out.items()}


def null_profile(df: DataFrame) -> DataFrame:
    """(column, n_null) for columns with at least one null, in one pass."""
    wide = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in df.columns])
    long = wide.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(c).alias("n_null")) for c in df.columns])).alias("s"))
    return long.select("s.*").where("n_null > 0")


def table_info(df: DataFrame) -> DataFrame:
    """(position, column, type, non_null) for every column, in one pass."""
    wide = df.agg(*[F.count(c).alias(c) for c in df.columns])
    return wide.select(F.explode(F.array(*[
        F.struct(F.lit(i).alias("position"), F.lit(f.name).alias("column"),
                 F.lit(f.dataType.simpleString()).alias("type"), F.col(f.name).alias("non_null"))
        for i, f in enumerate(df.schema.fields)])).alias("s")).select("s.*")


def table_shape(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("n_rows")).withColumn("n_columns", F.lit(len(df.columns)))


# ---------------------------------------------------------------- quantiles


def exact_quantiles(df: DataFrame, c: str, probs: Sequence[float]) -> list[float | None]:
    """Exact quantiles with linear interpolation (numpy's default).

    Values are counted per distinct value (partial aggregate), the running
    count over the sorted distinct values comes from ``ordered_scan``, and only
    the rows holding the needed order statistics are fetched."""
    vals = keep(df.where(F.col(c).isNotNull()).groupBy(F.col(c).cast("double").alias("v")).agg(
        F.count(F.lit(1)).alias("n")))  # read by the total and the scan
    total = vals.agg(F.sum("n")).first()[0]
    run = ordered_scan(vals, [], [F.col("v").asc()], running=[("n", "cum")])
    if not total:
        return [None for _ in probs]
    wanted = set()
    for p in probs:
        pos = p * (total - 1)
        wanted.update({math.floor(pos), math.ceil(pos)})
    cond = F.lit(False)
    for i in wanted:
        cond = cond | ((F.col("cum") - F.col("n") <= i) & (F.lit(i) < F.col("cum")))
    picked = run.where(cond).select("v", "n", "cum").collect()

    def at(i: int) -> float:
        for r in picked:
            if r["cum"] - r["n"] <= i < r["cum"]:
                return r["v"]
        raise AssertionError(i)

    out = []
    for p in probs:
        pos = p * (total - 1)
        lo, hi = math.floor(pos), math.ceil(pos)
        out.append(at(lo) + (at(hi) - at(lo)) * (pos - lo))
    return out


def describe(df: DataFrame, c: str) -> DataFrame:
    """count, mean, sample std, min, exact 25/50/75 % quantiles, max."""
    q1, q2, q3 = exact_quantiles(df, c, [0.25, 0.5, 0.75])
    return df.agg(
        F.count(c).alias("count"), F.avg(c).alias("mean"), F.stddev_samp(c).alias("std"),
        F.min(c).cast("double").alias("min"),
        F.lit(q1).cast("double").alias("q25"), F.lit(q2).cast("double").alias("q50"),
        F.lit(q3).cast("double").alias("q75"), F.max(c).cast("double").alias("max"))


def iqr_outliers(df: DataFrame, c: str, k: float = 1.5) -> DataFrame:
    """Rows strictly outside [Q1 − k·IQR, Q3 + k·IQR]."""
    q1, q3 = exact_quantiles(df, c, [0.25, 0.75])
    if q1 is None:
        return df.limit(0)
    iqr = q3 - q1
    return df.where((F.col(c) < q1 - k * iqr) | (F.col(c) > q3 + k * iqr))


# ---------------------------------------------------------------- bins


def _min_max(df: DataFrame, c: str) -> tuple:
    r = df.agg(F.min(c).cast("double"), F.max(c).cast("double")).first()
    return r[0], r[1]


def equal_width_bins(df: DataFrame, c: str, n: int, out: str = "bin") -> DataFrame:
    """0-based bin of ``n`` equal-width, right-closed bins over [min, max];
    the minimum falls into the first bin and a null stays null."""
    lo, hi = _min_max(df, c)
    if lo is None:
        return df.withColumn(out, F.lit(None).cast("int"))
    if hi == lo:
        return df.withColumn(out, F.when(F.col(c).isNotNull(), F.lit(0)))
    b = F.greatest(F.lit(0), F.ceil((F.col(c) - lo) / (hi - lo) * n).cast("int") - 1)
    return df.withColumn(out, F.when(F.col(c).isNotNull(), F.least(b, F.lit(n - 1))))


def histogram(df: DataFrame, c: str, n: int = 10) -> DataFrame:
    """(bin, lower, upper, count) for ``n`` equal bins over [min, max], the last
    closed on the right; empty bins are listed with count 0."""
    lo, hi = _min_max(df, c)
    if lo is None:
        return df.sparkSession.createDataFrame([], "bin int, lower double, upper double, count long")
    width = (hi - lo) / n if hi > lo else 1.0
    b = F.least(F.floor((F.col(c) - lo) / width).cast("int"), F.lit(n - 1))
    counts = df.where(F.col(c).isNotNull()).groupBy(b.alias("bin")).agg(F.count(F.lit(1)).alias("count"))
    grid = counts.select(F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("bin")).distinct()
    return (grid.join(counts, "bin", "left")
            .select("bin", (F.lit(lo) + F.col("bin") * width).alias("lower"),
                    (F.lit(lo) + (F.col("bin") + 1) * width).alias("upper"),
                    F.coalesce("count", F.lit(0)).cast("long").alias("count")))


# ---------------------------------------------------------------- moments


def _paired(a: str, b: str) -> tuple[Column, Column]:
    both = F.col(a).isNotNull() & F.col(b).isNotNull()
    return F.when(both, F.col(a)), F.when(both, F.col(b))


def corr_expr(a: str, b: str) -> Column:
    """Pearson correlation over rows where both are present; null when either
    side is constant (Spark's ``corr`` raises there under ANSI)."""
    x, y = _paired(a, b)
    den = F.stddev_pop(x) * F.stddev_pop(y)
    return F.covar_pop(x, y) / F.when(den != 0, den)


def corr_matrix(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Long correlation matrix (a, b, r) of every ordered pair, one pass.
    Only pairs a < b are aggregated (r is symmetric); the diagonal is 1, or
    null for a constant column."""
    upper = [(i, j) for i in range(len(cols)) for j in range(i + 1, len(cols))]
    aggs = [corr_expr(cols[i], cols[j]).alias(f"r{i}_{j}") for i, j in upper]
    aggs += [F.var_pop(c).alias(f"v{i}") for i, c in enumerate(cols)]
    wide = df.agg(*aggs)

    def cell(i: int, j: int):
        if i == j:
            return F.when(F.col(f"v{i}") > 0, F.lit(1.0))
        a, b = min(i, j), max(i, j)
        return F.col(f"r{a}_{b}")

    return wide.select(F.explode(F.array(*[
        F.struct(F.lit(cols[i]).alias("a"), F.lit(cols[j]).alias("b"), cell(i, j).cast("double").alias("r"))
        for i in range(len(cols)) for j in range(len(cols))])).alias("s")).select("s.*")


def vector_corr(df: DataFrame, features: str, names: Sequence[str]) -> DataFrame:
    """Long Pearson matrix (a, b, r) of a wide feature vector, computed by
    ``ml.stat.Correlation`` (one distributed pass on the JVM; only the d×d
    matrix comes back).  Rows must be complete - impute first; a constant
    slot gives null."""
    import math as _m

    from pyspark.ml.stat import Correlation
    mat = Correlation.corr(df.select(features), features).first()[0].toArray()
    rows = [(names[i], names[j], None if _m.isnan(mat[i, j]) else float(mat[i, j]))
            for i in range(len(names)) for j in range(len(names))]
    return df.sparkSession.createDataFrame(rows, "a string, b string, r double")


def variances(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(column, variance) with population variance (ddof 0), one pass."""
    wide = df.agg(*[F.var_pop(c).alias(c) for c in cols])
    return wide.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("variance")) for c in cols]
    )).alias("s")).select("s.*")


def counts_by_label(df: DataFrame, cats: Sequence[str], label: str) -> DataFrame:
    """(variable, value, label, count) for several categorical columns: the
    table under per-category count plots."""
    long = df.select(label, F.explode(F.array(*[
        F.struct(F.lit(c).alias("variable"), F.col(c).cast("string").alias("value")) for c in cats
    ])).alias("s")).select("s.variable", "s.value", label)
    return long.groupBy("variable", "value", label).agg(F.count(F.lit(1)).alias("count"))


# ---------------------------------------------------------------- density


SQRT_2PI = math.sqrt(2 * math.pi)


def kde(df: DataFrame, c: str, by: str, grid: Sequence[float], bandwidth: float | None = None) -> DataFrame:
    """Gaussian kernel density of ``c`` per ``by`` group on a fixed grid.

    Bandwidth per group: Scott's rule (sample std · n^(−1/5)) unless given.
    Values are first counted per distinct (group, value), then each distinct
    value contributes to every grid point; the result is aggregated per
    (group, grid point)."""
    pts = df.where(F.col(c).isNotNull()).groupBy(by, F.col(c).cast("double").alias("x")).agg(
        F.count(F.lit(1)).alias("w"))
    stats = df.where(F.col(c).isNotNull()).groupBy(by).agg(
        F.count(F.lit(1)).alias("n"), F.stddev_samp(c).alias("sd"))
    h = F.lit(bandwidth) if bandwidth else F.col("sd") * F.pow(F.col("n"), F.lit(-0.2))
    stats = stats.select(by, "n", h.alias("h"))
    g = F.array(*[F.lit(float(v)) for v in grid])
    j = pts.join(stats, by, "inner")
    e = j.select(by, "x", "w", "n", "h", F.posexplode(g).alias("gi", "grid"))
    k = F.col("w") * F.exp(-0.5 * F.pow((F.col("grid") - F.col("x")) / F.col("h"), 2))
    return e.groupBy(by, "gi", "grid").agg(
        (F.sum(k) / (F.first("n") * F.first("h") * F.lit(SQRT_2PI))).alias("density"))


def scalar_max(df: DataFrame, c: str) -> DataFrame:
    return df.agg(F.max(c).alias(f"max_{c}"))
