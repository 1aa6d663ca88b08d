import datetime as dt

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from revisit.operators import journey as JR
from revisit.operators.ordered import ordered_scan

T0 = dt.datetime(2020, 1, 1)


def adm(spark, rows):
    return spark.createDataFrame(
        rows, "SUBJECT_ID long, HADM_ID long, ADMITTIME timestamp_ntz, DISCHTIME timestamp_ntz")


def h(n):
    return T0 + dt.timedelta(hours=n)


def test_sequence_ties_broken_by_id_and_nulls_last(spark):
    df = adm(spark, [(1, 30, h(5), h(6)), (1, 10, h(5), h(6)), (1, 20, None, None), (2, 40, h(1), h(2))])
    got = {(r.HADM_ID, r.SEQUENCE) for r in JR.sequence_events(df, "SUBJECT_ID", ["ADMITTIME", "HADM_ID"]).collect()}
    assert got == {(10, 1), (30, 2), (20, 3), (40, 1)}


def test_next_gap_drops_last_and_single_events_and_keeps_negative(spark):
    df = adm(spark, [(1, 1, h(0), h(48)), (1, 2, h(24), h(30)), (2, 3, h(0), h(1))])
    rows = JR.next_event_gap(df).collect()
    assert len(rows) == 1
    r = rows[0]
    assert r.HADM_ID == 1 and r.NXT_ADMITTIME == h(24)
    assert r.DAYS_TO_READMISSION == pytest.approx(-1.0)  # next admission before this discharge


def test_lead_and_self_join_agree(spark):
    rows = [(s, s * 100 + i, h((i * 7919) % 97), h((i * 7919) % 97 + 5)) for s in range(5) for i in range(9)]
    df = adm(spark, rows)
    a = JR.next_event_gap(df)
    b = JR.next_event_selfjoin(JR.sequence_events(df, "SUBJECT_ID", ["ADMITTIME", "HADM_ID"]))
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.select(*a.columns).collect()))


@pytest.mark.parametrize("chunks", [1, 4, 17])
def test_hot_entity_is_split_and_result_is_partition_independent(spark, chunks):
    # entity 0 holds ~2/3 of all rows; with several chunks it spans many of them
    rows = [(0, i, h(i), h(i + 1)) for i in range(400)] + \
           [(s, 1000 + s * 10 + i, h(i), h(i + 1)) for s in range(1, 40) for i in range(5)]
    df = adm(spark, rows).repartition(5)
    seq = JR.sequence_events(df, "SUBJECT_ID", ["ADMITTIME", "HADM_ID"], chunks=chunks)
    w = Window.partitionBy("SUBJECT_ID").orderBy("ADMITTIME", "HADM_ID")
    ref = df.select("HADM_ID", F.row_number().over(w).alias("ref"))
    bad = seq.join(ref, "HADM_ID").where("SEQUENCE != ref").count()
    assert bad == 0 and seq.count() == len(rows)
    gaps = JR.next_event_gap(df, chunks=chunks)
    assert gaps.count() == len(rows) - 40
    assert gaps.where("DAYS_TO_READMISSION IS NULL").count() == 0


def test_ordered_scan_running_sum_global(spark):
    df = spark.range(1, 101).withColumn("v", F.col("id") % 7)
    out = ordered_scan(df, [], [F.col("id")], rn="rn", running=[("v", "cum")], chunks=6).orderBy("id").collect()
    cum = 0
    for r in out:
        cum += r.v
        assert r.cum == cum and r.rn == r.id


def test_repeat_entities_and_counts(spark):
    df = adm(spark, [(1, 1, h(0), h(1)), (1, 2, h(2), h(3)), (2, 3, h(0), h(1)), (None, 4, h(0), h(1))])
    got = JR.repeat_entities(df, "SUBJECT_ID", 2, "READMISSION_COUNT").collect()
    assert sorted((r.HADM_ID, r.READMISSION_COUNT) for r in got) == [(1, 2), (2, 2)]
    counts = {r.SUBJECT_ID: r.READMISSION_COUNT for r in JR.entity_counts(df, "SUBJECT_ID").collect()}
    assert counts == {1: 2, 2: 1}


def test_latest_with_total_all_missing_is_zero(spark):
    df = spark.createDataFrame([(1, 1, 10, "A", None), (1, 1, 11, "B", None), (2, 2, 20, "C", 1.5),
                                (2, 2, 21, None, 2.0)],
                               "HADM_ID long, SUBJECT_ID long, ICUSTAY_ID long, LAST_CAREUNIT string, LOS double")
    got = {r.HADM_ID: (r.ICUSTAY_ID, r.LAST_CAREUNIT, r.LOS) for r in JR.latest_with_total(df).collect()}
    assert got == {1: (11, "B", 0.0), 2: (21, None, 3.5)}


def test_group_mean_fill(spark):
    df = spark.createDataFrame([(1, None), (1, None), (2, 1.0), (2, 3.0), (2, None)], "k long, v double")
    got = {r.k: r.v for r in JR.group_mean_fill(df, "k", ["v"]).collect()}
    assert got == {1: 0.0, 2: 2.0}


@pytest.mark.parametrize("chunks", [1, 2, 7, 40])
def test_scan_equals_window_whatever_the_chunks(spark, chunks):
    """A hot key over many chunks, null keys, keys that end at a chunk's end, and
    keys of one row: positions, next rows and running sums of plain windows."""
    rows = [(0, i, i % 5) for i in range(300)] + [(k, i, k) for k in range(1, 60) for i in range(k % 4 + 1)] + [(None, i, 2) for i in range(50)]
    df = spark.createDataFrame(rows, "k int, i int, v long").repartition(5)
    order = [F.col("i").desc(), "v"]
    got = ordered_scan(df, ["k"], order, rn="n", leads=[("v", "nv"), ("i", "ni")], has_next="more", running=[("v", "sum")], chunks=chunks)
    w = Window.partitionBy("k").orderBy(F.col("i").desc(), "v")
    upto = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    want = df.select("*", F.row_number().over(w).cast("long").alias("n"), F.lead("v").over(w).alias("nv"), F.lead("i").over(w).alias("ni"),
                     F.lead(F.lit(1)).over(w).isNotNull().alias("more"), F.sum("v").over(upto).alias("sum"))
    assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))
    whole = ordered_scan(df, [], ["k", *order], rn="n", running=[("v", "sum")], chunks=chunks)
    w = Window.orderBy("k", *order)
    want = df.select("*", F.row_number().over(w).cast("long").alias("n"), F.sum("v").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("sum"))
    assert sorted(map(repr, whole.collect())) == sorted(map(repr, want.collect()))
    assert ordered_scan(df.limit(0), ["k"], order, rn="n", leads=[("v", "nv")]).count() == 0


def test_scan_counts_nothing_first_and_broadcasts_ends_only(spark):
    """Building the scan runs no job; joins with the chunk ends are broadcast."""
    df = spark.range(0, 2000).withColumn("k", (F.col("id") % 3).cast("int"))
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("scan", "scan")
    try:
        out = ordered_scan(df, ["k"], ["id"], rn="n")
        assert not tracker.getJobIdsForGroup("scan")
        out.collect()
    finally:
        spark.sparkContext._jsc.sc().clearJobGroup()
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan


def test_split_whatever_the_partitions(spark):
    from revisit.ml.features import stratified_split
    df = spark.range(0, 600).withColumn("y", (F.col("id") % 4 == 0).cast("int"))
    a = sorted(map(tuple, stratified_split(df, "id", "y").collect()))
    b = sorted(map(tuple, stratified_split(df.repartition(11, "y"), "id", "y").collect()))
    assert a == b and sum(r[2] for r in a) == 113 + 38


def test_scan_equals_window_on_real_hot_keys(spark):
    from revisit.sources.tables import table
    li = table(spark, "/root/testdata/sf0.001", "lineitem").select(
        "l_returnflag", "l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    order = ["l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]  # total order
    a = ordered_scan(li, ["l_returnflag"], order, rn="seq", leads=[("l_shipdate", "nxt")])
    w = Window.partitionBy("l_returnflag").orderBy(*order)
    b = li.select("*", F.row_number().over(w).cast("long").alias("seq"), F.lead("l_shipdate").over(w).alias("nxt"))
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0
