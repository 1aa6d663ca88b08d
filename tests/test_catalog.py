"""Every registered query against its DuckDB oracle on the smallest fixture,
plus the flagship's known answer at sf 0.01."""

import duckdb
import pytest

import __spark_entry__ as E
from revisit.sources.tables import DRIVER_TABLES
from scripts.check_oracle import rows_of

from .conftest import MEDIUM, SMALL

#: The library's own queries; those of the text operators are tested in tests/llm.
OWN = {k: fn for k, (fn, _) in E._registry().items()}
SQL = {k: sql for k, (_, sql) in E._registry().items() if sql}


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in DRIVER_TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    return c


def test_every_oracle_key_is_a_query():
    assert set(E.oracle_sql()) <= set(E.queries())


@pytest.mark.parametrize("key", sorted(SQL))
def test_query_matches_oracle(spark, con, key):
    df = OWN[key](spark, SMALL)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    rel = con.sql(SQL[key])
    want = rows_of(rel.columns, rel.fetchall())
    assert sorted(df.columns) == sorted(rel.columns)
    assert got == want


def test_entry_runs(spark):
    rows = E.entry(spark).collect()
    assert rows and set(rows[0].asDict()) == {"ADMISSION_TYPE", "n_admissions", "readmit_rate", "n_negative_gaps"}


def test_flagship_known_answer(spark):
    from revisit.plans.cohort import readmission_rate_by_type
    got = {r.ADMISSION_TYPE: (r.n_admissions, r.readmit_rate, r.n_negative_gaps)
           for r in readmission_rate_by_type(spark, MEDIUM).collect()}
    assert got == {"1-URGENT": (1951, 0.169144, 108), "2-HIGH": (1991, 0.1778, 105),
                   "3-MEDIUM": (1979, 0.163719, 102), "4-NOT SPECIFIED": (1979, 0.180899, 91),
                   "5-LOW": (2029, 0.172006, 107)}


#: model_comparison runs with small models in tests/test_compare.py.
ROWS_ONLY = sorted(set(OWN) - set(SQL) - {"model_comparison"})


@pytest.mark.parametrize("key", ROWS_ONLY)
def test_rows_only_query_runs(spark, key):
    from revisit.session import release_intermediates
    df = OWN[key](spark, SMALL)
    n = df.count()
    release_intermediates()
    assert n > 0 and len(df.columns) == len(set(df.columns))


SPARK_TO_DUCK = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR",
                 "timestamp_ntz": "TIMESTAMP", "boolean": "BOOLEAN", "array<double>": "DOUBLE[]", "array<int>": "INTEGER[]"}


@pytest.mark.parametrize("key", sorted(SQL))
def test_query_types_match_oracle(spark, con, key):
    from revisit.session import release_intermediates
    df = OWN[key](spark, SMALL)
    release_intermediates()
    rel = con.sql(SQL[key]).limit(0)
    duck = {c: str(t) for c, t in zip(rel.columns, rel.types)}
    for f in df.schema.fields:
        s = f.dataType.simpleString()
        assert duck[f.name] == SPARK_TO_DUCK.get(s, s), (f.name, s, duck[f.name])
