"""Leaf rules of trees, the scoring stream's outputs, explicit sources."""

import json
import os

import numpy as np
import pytest
from pyspark.ml import PipelineModel
from pyspark.ml.feature import VectorAssembler, VectorIndexer
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from revisit.ml import evaluate as EV
from revisit.ml import models as M
from revisit.sources.tables import bound
from revisit.streaming.scoring import parsed, scored, score_stream

from .conftest import SMALL


# ---------------------------------------------------------------- rules


def forest(spark, tmp_dir, trees=4, categories=0):
    """A saved forest over three named columns, the first one categorical."""
    r = np.random.default_rng(5)
    x = np.column_stack([r.integers(0, 6, 400), r.standard_normal(400), np.round(r.standard_normal(400), 2)]).astype(float)
    y = ((np.isin(x[:, 0], [1, 4])) ^ (x[:, 1] > 0.3) | (x[:, 2] > 1)).astype(float)
    df = spark.createDataFrame([(i, *map(float, a), float(b)) for i, (a, b) in enumerate(zip(x, y))],
                               "id long, `a``b` double, c double, d double, label double")
    df = df.withColumn("raw", array_to_vector(F.array("`a``b`", "c", "d")))
    df = VectorIndexer(inputCol="raw", outputCol="features", maxCategories=categories or 2).fit(df).transform(df)
    model = M.random_forest(trees=trees, depth=5, max_features=3).fit(df)
    M.save_model(model, f"{tmp_dir}/forest")
    return df, model, EV.tree_nodes(spark, f"{tmp_dir}/forest")


@pytest.mark.parametrize("categories", [0, 6])
def test_rules_reproduce_every_tree(spark, tmp_dir, categories):
    df, model, nodes = forest(spark, tmp_dir, categories=categories)
    names = ["a`b", "c", "d"]
    rules = EV.leaf_rules(nodes, names).collect()
    # categories are indices of the sorted values; here those are the values
    for tree_id, tree in enumerate(model.trees):
        own = [r for r in rules if r["treeID"] == tree_id]
        assert len(own) == (tree.numNodes + 1) // 2 and max(r["depth"] for r in own) == tree.depth
        case = " ".join(f"WHEN {r['rule']} THEN {r['prediction']}D" for r in own)
        want = tree.setPredictionCol("want").setRawPredictionCol("_r").setProbabilityCol("_p").transform(df)
        wrong = want.withColumn("got", F.expr(f"CASE {case} END")).where("not (got <=> want)").count()
        hits = want.select(sum(F.expr(r["rule"]).cast("int") for r in own).alias("n")).where("n <> 1").count()
        assert wrong == 0 and hits == 0  # each row satisfies exactly one rule
    cut = EV.splits(nodes, names).collect()
    assert {s["feature"] for s in cut} <= set(names)
    assert all((s["threshold"] is None) != (s["left_categories"] is None) for s in cut)
    assert any(s["left_categories"] for s in cut) == bool(categories)
    # every inner node's children are nodes
    ids = {(r["treeID"], r["id"]) for r in nodes.collect()}
    assert all((s["treeID"], s[c]) in ids for s in cut for c in ("leftChild", "rightChild"))


def test_a_tree_of_one_leaf(spark, tmp_dir):
    df = spark.createDataFrame([(float(i), 1.0) for i in range(20)], "c double, label double")
    df = VectorAssembler(inputCols=["c"], outputCol="features").transform(df)
    M.save_model(M.random_forest(trees=1, depth=3, max_features=1).fit(df), f"{tmp_dir}/one")
    (r,) = EV.leaf_rules(EV.tree_nodes(spark, f"{tmp_dir}/one"), ["c"]).collect()
    assert (r["rule"], r["depth"], r["id"]) == ("true", 0, 0)


# ---------------------------------------------------------------- stream


def test_lines_of_all_forms_are_parsed(spark):
    recs = [{"id": 1, "a": 1.5}, {"id": 2, "a": None}, {"id": 3}]
    lines = [json.dumps(recs[0]), json.dumps(recs), json.dumps(json.dumps(recs)), json.dumps(json.dumps(recs[1])), "", "   ", "{broken",
             '{"id": "x", "a": 1}', json.dumps(json.dumps([recs[0], {"id": "no"}])), "[]", '"not json"', "[1, null]", "null"]
    df = spark.createDataFrame([(x,) for x in lines], "value string")
    got = parsed(df, spark.createDataFrame([], "id long, a double").schema).collect()
    good = sorted((r["record"]["id"], r["record"]["a"]) for r in got if r["bad"] is None and r["record"]["a"] is not None)
    assert good == [(1, 1.5)] * 4
    assert sum(r["bad"] is None for r in got) == 1 + 3 + 3 + 1 + 1
    assert sorted(r["bad"] for r in got if r["bad"] is not None) == sorted(
        ["{broken", '{"id": "x", "a": 1}', '{"id":"no"}', "not json", "1", "null", "null"])


def served(spark, tmp_dir):
    r = np.random.default_rng(4)
    rows = [(i, float(i % 2), *[float(v) for v in r.normal(i % 2, 1, 2)]) for i in range(40)]
    df = spark.createDataFrame(rows, "id long, label double, a double, b double")
    asm = VectorAssembler(inputCols=["a", "b"], outputCol="features")
    model = PipelineModel(stages=[asm, M.random_forest(trees=3, depth=2, max_features=1).fit(asm.transform(df))])
    M.save_model(model, f"{tmp_dir}/m")
    return df.select("id", "a", "b"), model


def test_posted_batches_restart_and_bad_lines(spark, tmp_dir):
    """Twice-dumped batches; a batch that runs again replaces its own files; what
    is no record lands in the bad output without asking for it."""
    from revisit.streaming.scoring import replace_batch
    recs, model = served(spark, tmp_dir)
    rows = [r.asDict() for r in recs.orderBy("id").collect()]
    os.makedirs(f"{tmp_dir}/in")

    def post(name, lines):
        with open(f"{tmp_dir}/in/{name}", "w") as f:
            f.write("\n".join(lines))

    args = (spark, f"{tmp_dir}/in", recs.schema, f"{tmp_dir}/m", "id", ["a", "b"], f"{tmp_dir}/out", f"{tmp_dir}/ckpt")
    read = lambda: sorted(map(tuple, spark.read.parquet(f"{tmp_dir}/out").collect()))
    bad = lambda: sorted(r["value"] for r in spark.read.text(f"{tmp_dir}/out-bad").collect())
    want = lambda ids: sorted(map(tuple, scored(model, recs.where(F.col("id").isin(ids)), "id", ["a", "b"]).collect()))
    post("one", [json.dumps(json.dumps(rows[:15])), "{broken"])
    score_stream(*args).awaitTermination()
    assert read() == want(list(range(15))) and bad() == ["{broken"]
    post("two", [json.dumps(x) for x in rows[15:30]] + [json.dumps(json.dumps([{"id": "z"}]))])
    score_stream(*args).awaitTermination()
    assert read() == want(list(range(30))) and bad() == ['{"id":"z"}', "{broken"]
    # the last batch again, as after a failure before its commit
    for kind in ("offsets", "commits"):
        last = max((n for n in os.listdir(f"{tmp_dir}/ckpt/{kind}") if n.isdigit()), key=int)
        if kind == "commits":
            os.remove(f"{tmp_dir}/ckpt/{kind}/{last}")
            if os.path.exists(f"{tmp_dir}/ckpt/{kind}/.{last}.crc"):
                os.remove(f"{tmp_dir}/ckpt/{kind}/.{last}.crc")
    score_stream(*args).awaitTermination()
    assert read() == want(list(range(30))) and bad() == ['{"id":"z"}', "{broken"]
    for _ in range(2):
        replace_batch(recs.limit(3), f"{tmp_dir}/twice", 7, "parquet")
    assert spark.read.parquet(f"{tmp_dir}/twice").count() == 3


# ---------------------------------------------------------------- sources


def test_sources_are_explicit(spark, tmp_dir):
    assert bound(spark, SMALL, "patients", "any").count() == bound(spark, SMALL, "patients", "fixtures").count() > 0
    with pytest.raises(FileNotFoundError, match="patients"):
        bound(spark, SMALL, "patients", "tables")
    spark.conf.set("revisit.sources", "tables")
    try:
        with pytest.raises(FileNotFoundError, match="admissions"):
            bound(spark, SMALL, "admissions")
        assert bound(spark, SMALL, "orders").count() > 0
    finally:
        spark.conf.unset("revisit.sources")
    with pytest.raises(ValueError, match="unknown source"):
        bound(spark, SMALL, "patients", "both")
    bound(spark, SMALL, "patients").limit(2).write.parquet(f"{tmp_dir}/patients.parquet")
    assert bound(spark, tmp_dir, "patients").count() == 2
