"""The registered text queries: rows, columns, types and SQL on the smallest
tables, and the stages of the pipeline one by one."""

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from revisit.llm.common import table
from revisit.llm.queries import QUERIES, SQL

from ..conftest import SMALL

TYPES = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}
WHOLE = {"op1_curve_packing": "documents", "op2_toxicity": "documents", "op4_quality_rules": "documents", "op5_url_aliases": "pages",
         "op6_simhash_pivots": "documents", "op7_html_scoring": "pages", "op8_pii_offsets": "documents", "op9_decontaminate": "documents",
         "op13_shallot_means": "embeddings"}


@pytest.mark.parametrize("key", sorted(set(QUERIES) - set(SQL)))
def test_query_runs(spark, key):
    df = QUERIES[key](spark, SMALL)
    assert df.count() > 0 and len(df.columns) == len(set(df.columns))


@pytest.mark.parametrize("key", sorted(WHOLE))
def test_query_covers_its_table(spark, key):
    df, name = QUERIES[key](spark, SMALL), WHOLE[key]
    own = df.columns[0]
    asked = table(spark, SMALL, name).select(own)
    assert asked.exceptAll(df.select(own).distinct()).count() == asked.count() - asked.distinct().count()


@pytest.mark.parametrize("key", sorted(SQL))
def test_query_matches_sql(spark, key):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "pages", "embeddings"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    df, rel = QUERIES[key](spark, SMALL), con.sql(SQL[key])
    assert sorted(df.columns) == sorted(rel.columns)
    assert {f.name: TYPES[f.dataType.simpleString()] for f in df.schema.fields} == {c: str(t) for c, t in zip(rel.columns, rel.types)}
    order = lambda rows: sorted((tuple(r) for r in rows), key=repr)
    assert order(df.select(*rel.columns).collect()) == order(rel.fetchall())


def test_stages_keep_columns_and_rows(spark):
    """Each stage on its predecessor's output; a stage on an empty table."""
    docs = table(spark, SMALL, "documents")
    columns, n = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), SMALL).count() == 0
        out = stage(spark, docs, SMALL).cache()
        if name != "packing":
            assert out.columns == columns and 0 < out.count() <= n
            wrong = out.where("n_chars <> length(text)").count()
            assert wrong == docs.where("n_chars <> length(text)").count() if name in ("quality_rules", "simhash_dedup") else not wrong
            docs, n = out, out.count()
    assert set(out.select("doc_id").distinct().collect()) == set(docs.select("doc_id").distinct().collect())


def test_stages_on_null_and_repeated_ids(spark):
    """Three documents of ids null, 1 and 1 are three; copies are one; nulls and
    empty texts are one group; extra columns with clashing names stay."""
    long = lambda word: " ".join(f"{word}{i}" for i in range(80))
    rows = [(None, long("a")), (1, long("b")), (1, long("c")), (1, long("c")), (2, long("c")), (None, None), (3, ""), (4, None), (None, long("d"))]
    docs = spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t), "x", "x") for i, t in rows],
                                 "doc_id long, text string, lang string, source string, n_chars long, rules string, leak string")
    stages = dict(corpus_pipeline.STAGES)
    out = stages["simhash_dedup"](spark, docs, SMALL).collect()
    assert sorted((r["doc_id"] or 0, r["text"] or "") for r in out) == sorted(
        [(0, long("a")), (1, long("b")), (1, long("c")), (0, ""), (0, long("d"))])
    for name in ("quality_rules", "line_dedup", "simhash_dedup", "benchmark_decontamination"):
        got = stages[name](spark, docs, SMALL)
        assert got.columns == docs.columns and stages[name](spark, docs.limit(0), SMALL).count() == 0
        texts = sorted(r["text"] or "" for r in got.collect())
        if name == "line_dedup":
            assert len(texts) == len(rows) and all(long(w) in texts for w in "abcd")
        if name == "benchmark_decontamination":
            assert texts == sorted(t or "" for _, t in rows)
        if name == "quality_rules":
            assert set(texts) <= {long(w) for w in "abcd"}
    assert stages["packing"](spark, docs, SMALL).where("start = 0").count() == len(rows)
