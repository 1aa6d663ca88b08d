import numpy as np
import pytest
from pyspark.sql import functions as F

from revisit.operators import profile as P
from revisit.operators import relational as R
from revisit.operators import sets as ST


def test_mode_ties_go_to_smallest(spark):
    df = spark.createDataFrame([("b",), ("a",), ("b",), ("a",), (None,), ("c",)], "x string")
    assert R.fit_modes(df, ["x"]) == {"x": "a"}
    filled = R.fill_mode(df, ["x"])
    assert filled.where("x IS NULL").count() == 0


def test_corr_constant_column_is_null_not_error(spark):
    df = spark.createDataFrame([(1.0, 5.0, 2.0), (2.0, 5.0, 4.1), (3.0, 5.0, 5.9), (None, 5.0, 1.0)],
                               "a double, b double, c double")
    m = {(r.a, r.b): r.r for r in P.corr_matrix(df, ["a", "b", "c"]).collect()}
    assert m[("a", "b")] is None and m[("b", "b")] is None
    assert m[("a", "c")] == pytest.approx(np.corrcoef([1, 2, 3], [2, 4.1, 5.9])[0, 1])
    assert m[("a", "a")] == pytest.approx(1.0)


def test_exact_quantiles_match_numpy(spark):
    rng = np.random.default_rng(7)
    vals = np.round(rng.gamma(2.0, 3.0, 997), 2)
    df = spark.createDataFrame([(float(v),) for v in vals], "x double")
    got = P.exact_quantiles(df, "x", [0.0, 0.25, 0.5, 0.75, 1.0])
    assert got == pytest.approx(np.quantile(vals, [0.0, 0.25, 0.5, 0.75, 1.0]).tolist())


def test_iqr_outliers_strict(spark):
    vals = [1.0, 2.0, 3.0, 4.0, 100.0]
    df = spark.createDataFrame([(v,) for v in vals], "x double")
    q1, q3 = np.quantile(vals, [0.25, 0.75])
    expect = [v for v in vals if v < q1 - 1.5 * (q3 - q1) or v > q3 + 1.5 * (q3 - q1)]
    assert [r.x for r in P.iqr_outliers(df, "x").collect()] == expect


def test_equal_width_bins_right_closed_min_included(spark):
    df = spark.createDataFrame([(v,) for v in [0.0, 1.0, 2.0, 2.5, 4.0]], "x double")
    got = [r.bin for r in P.equal_width_bins(df, "x", 4).orderBy("x").collect()]
    assert got == [0, 0, 1, 2, 3]


def test_histogram_matches_numpy(spark):
    rng = np.random.default_rng(3)
    vals = rng.normal(0, 1, 500)
    df = spark.createDataFrame([(float(v),) for v in vals], "x double")
    got = [r["count"] for r in P.histogram(df, "x", 10).orderBy("bin").collect()]
    assert got == np.histogram(vals, 10)[0].tolist()


def test_null_profile_and_shape(spark):
    df = spark.createDataFrame([(1, None, "a"), (2, None, None), (3, 1.0, "c")], "a int, b double, c string")
    assert {(r.column, r.n_null) for r in P.null_profile(df).collect()} == {("b", 2), ("c", 1)}
    s = P.table_shape(df).first()
    assert (s.n_rows, s.n_columns) == (3, 3)


def test_crosstab_drops_null_codes_and_fills_zero(spark):
    df = spark.createDataFrame([(1, "x"), (1, "x"), (1, None), (2, "y")], "k long, c string")
    got = {r.k: (r.x, r.y) for r in P.crosstab(df, "k", "c", ["x", "y"]).collect()}
    assert got == {1: (2, 0), 2: (0, 1)}


def test_align_schema_idempotent_and_fills(spark):
    df = spark.createDataFrame([(1, 2, 3)], "k long, a long, b long")
    same = R.align_schema(df, ["k"], ["a", "b"])
    ST.assert_same(same, df)
    grown = R.align_schema(df, ["k"], ["a", "z", "b"])
    assert grown.columns == ["k", "a", "z", "b"] and grown.first().z == 0


def test_same_keys(spark):
    a = spark.createDataFrame([(1,), (2,), (3,)], "k long")
    b = spark.createDataFrame([(2,), (3,), (4,), (4,)], "k long")
    r = ST.same_keys(a, b, "k").first()
    assert (r.only_left, r.only_right, r.equal) == (1, 1, False)
    assert ST.same_keys(a, a, "k").first().equal


def test_kde_integrates_to_one(spark):
    rng = np.random.default_rng(5)
    df = spark.createDataFrame([(int(i % 2), float(v)) for i, v in enumerate(rng.normal(0, 1, 400))],
                               "g int, x double")
    grid = list(np.linspace(-6, 6, 241))
    out = P.kde(df, "x", "g", grid).collect()
    for g in (0, 1):
        dens = sorted((r.gi, r.density) for r in out if r.g == g)
        area = np.trapezoid([d for _, d in dens], grid)
        assert area == pytest.approx(1.0, abs=0.01)


def test_vocab_size_is_checked(spark):
    df = spark.range(0, 50).withColumn("c", F.col("id").cast("string"))
    assert len(P.fit_vocab(df, "c")) == 50
    with pytest.raises(ValueError):
        P.fit_vocabs(df, ["c"], max_values=10)


def test_vector_corr_matches_column_corr(spark):
    from pyspark.ml.feature import VectorAssembler
    rng = np.random.default_rng(9)
    x = rng.normal(0, 1, (200, 3))
    x[:, 2] = x[:, 0] * 0.5 + rng.normal(0, 0.1, 200)
    df = spark.createDataFrame([tuple(map(float, r)) for r in x], "a double, b double, c double")
    v = VectorAssembler(inputCols=["a", "b", "c"], outputCol="f").transform(df)
    got = {(r.a, r.b): r.r for r in P.vector_corr(v, "f", ["a", "b", "c"]).collect()}
    want = {(r.a, r.b): r.r for r in P.corr_matrix(df, ["a", "b", "c"]).collect()}
    for k, val in want.items():
        assert got[k] == pytest.approx(val, abs=1e-9)


def test_kde_takes_any_number_of_groups(spark):
    df = spark.range(0, 24_000).select((F.col("id") % 12_000).alias("g"), F.col("id").cast("double").alias("x"))
    assert P.kde(df, "x", "g", [0.0], bandwidth=1.0).count() == 12_000


def test_scratch_folder_only_on_one_machine():
    from revisit.session import one_machine
    assert one_machine("local") and one_machine("local[8]") and one_machine("local[*]")
    assert not any(map(one_machine, ("yarn", "local-cluster[3,2,1024]", "k8s://https://host", "spark://host:7077")))


def test_checkpoint_dir_honours_cluster_setting(spark, tmp_dir):
    from revisit.session import checkpoint_dir
    from revisit.sources.files import scratch_path
    # the session already has one (tests set it only where unset); it is reused, never replaced
    current = spark.sparkContext.getCheckpointDir()
    assert checkpoint_dir(spark) == current
    assert scratch_path(spark, "x").startswith(current)
