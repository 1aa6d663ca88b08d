import gzip
import os

from pyspark.sql import functions as F
from pyspark.sql import types as T

from revisit.sources import files as IO

SCHEMA = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.StringType()),
                       T.StructField("c", T.DoubleType())])


def test_csv_short_row_kept_long_row_dropped(spark, tmp_dir):
    path = os.path.join(tmp_dir, "bad.csv.gz")
    with gzip.open(path, "wt") as f:
        f.write('a,b,c\n1,"x, quoted",1.5\n2,short\n3,y,2.5,extra\n4,z,3.5\n')
    rows = sorted(map(tuple, IO.scan_csv(spark, path, SCHEMA).collect()))
    assert rows == [(1, "x, quoted", 1.5), (2, "short", None), (4, "z", 3.5)]


def test_csv_limit_needs_order(spark, tmp_dir):
    path = os.path.join(tmp_dir, "plain.csv")
    with open(path, "w") as f:
        f.write("a,b,c\n3,c,1\n1,a,2\n2,b,3\n")
    assert [r.a for r in IO.scan_csv(spark, path, SCHEMA, limit=2, order=["a"]).collect()] == [1, 2]
    try:
        IO.scan_csv(spark, path, SCHEMA, limit=2)
        raise AssertionError("expected ValueError")
    except ValueError:
        pass


def test_csv_round_trip(spark, tmp_dir):
    df = spark.createDataFrame([(1, "a", 0.5), (2, None, None)], SCHEMA)
    path = IO.write_csv(df, os.path.join(tmp_dir, "out"))
    assert sorted(map(tuple, IO.scan_csv(spark, path, SCHEMA).collect())) == sorted(map(tuple, df.collect()))


def test_json_records_nested_round_trip(spark):
    df = spark.createDataFrame([(1, 'he said "hi"'), (2, "b\\c")], "k long, s string")
    payload = df.agg(IO.dump_json_string(F.to_json(F.collect_list(F.struct("k", "s")))).alias("p"))
    back = IO.from_json_records(payload, "p", T.StructType.fromDDL("k long, s string"), nested_string=True)
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, df.collect()))
    rec = IO.to_json_records(df).collect()
    assert rec[0].json.startswith("{")


def test_ingested_sources_replace_the_fixture_bindings(spark, tmp_dir):
    from revisit.plans.cohort import readmission_rate_by_type
    from revisit.sources.schemas import SOURCE_COLUMNS, SOURCE_FILES, ingest_sources
    from revisit.sources.tables import bound
    small = "/root/testdata/sf0.001"
    csv_dir, out_dir = os.path.join(tmp_dir, "csv"), os.path.join(tmp_dir, "tables")
    for name, file in SOURCE_FILES.items():
        df = bound(spark, small, name)
        # an export has more columns than the analysis uses, e.g. a leading row id
        df = df.select(F.monotonically_increasing_id().alias("ROW_ID"), *SOURCE_COLUMNS[name])
        df.coalesce(1).write.option("header", True).option("compression", "gzip").csv(os.path.join(csv_dir, file))
    assert ingest_sources(spark, csv_dir, out_dir) == list(SOURCE_FILES)
    a = sorted(map(tuple, readmission_rate_by_type(spark, out_dir).collect()))
    b = sorted(map(tuple, readmission_rate_by_type(spark, small).collect()))
    assert a == b
