"""Driver tables and the hospital-shaped views bound onto them.

Every binding is a lazy DataFrame over the parquet scans, so Catalyst prunes the
columns a query does not use and pushes filters into the scan.  The bindings
follow FIXTURES.md §3 (fixed formulas that inject nulls and derive stays); the
same formulas are written as SQL text in ``revisit.plans.oracle``.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DRIVER_TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem",
    "events", "documents", "embeddings", "pages", "benchmark", "labels",
    "conversations",
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One driver table (one parquet file or folder per table)."""
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


#: Rows of a keyed step that one task holds.
TASK_ROWS = 1 << 18


def task_parts(df: DataFrame) -> int | None:
    """Partitions of about ``TASK_ROWS`` rows for a step over the rows of ``df``, a
    scan (counted from its footers); None where one task can hold them all."""
    n = df.select(F.lit(1)).count()
    if n <= TASK_ROWS:
        return None
    own = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    return max(own, -(-n // TASK_ROWS))


def dealt(df: DataFrame, *keys: str, of: DataFrame | None = None) -> DataFrame:
    """Rows hashed by ``keys`` into partitions of about ``TASK_ROWS`` rows, where the
    session's partitions may hold more: joins and aggregates that follow on the keys
    run in those partitions, so a task's sort and hash buffers keep their size as
    the table grows (partitions of a given number are not merged again).  ``of`` is
    a scan with as many rows, counted in place of a ``df`` that is no scan."""
    parts = task_parts(df if of is None else of)
    return df.repartition(parts, *keys) if parts else df


def _hours(n):
    return F.make_dt_interval(F.lit(0), n.cast("int"))


def _days(n):
    return F.make_dt_interval(n.cast("int"))


def admissions(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    key, cust = F.col("o_orderkey"), F.col("o_custkey")
    start_h = key * 7 % 24
    return o.select(
        cust.alias("SUBJECT_ID"),
        key.alias("HADM_ID"),
        (F.col("o_orderdate") + _hours(start_h)).alias("ADMITTIME"),
        (F.col("o_orderdate") + _hours(start_h + 12 + key * 31 % 500)).alias("DISCHTIME"),
        F.col("o_orderpriority").alias("ADMISSION_TYPE"),
        F.concat(F.lit("LOC"), (key % 6).cast("string")).alias("ADMISSION_LOCATION"),
        F.concat(F.lit("DIS"), (key % 9).cast("string")).alias("DISCHARGE_LOCATION"),
        F.col("o_orderstatus").alias("INSURANCE"),
        F.when(key % 17 == 0, F.lit(None).cast("string"))
         .otherwise(F.concat(F.lit("REL"), (cust % 5).cast("string"))).alias("RELIGION"),
        F.when(key % 11 == 0, F.lit(None).cast("string"))
         .otherwise(F.concat(F.lit("MAR"), (cust % 4).cast("string"))).alias("MARITAL_STATUS"),
        F.concat(F.lit("ETH"), (cust % 8).cast("string")).alias("ETHNICITY"),
    )


def services(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    rf, ls = F.col("l_returnflag"), F.col("l_linestatus")
    return li.select(
        F.col("l_orderkey").alias("HADM_ID"),
        F.when((rf == "R") & (ls == "F"), "CSURG")
         .when((rf == "A") & (ls == "F"), "CMED")
         .otherwise("MED").alias("CURR_SERVICE"),
    )


def diagnoses(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey")
    part = table(spark, sf_dir, "part").select("p_partkey", "p_brand")
    j = li.join(part, li.l_partkey == part.p_partkey, "inner")
    return j.select(
        F.col("l_orderkey").alias("HADM_ID"),
        F.when(F.col("l_partkey") % 41 == 0, F.lit(None).cast("string"))
         .otherwise(F.col("p_brand")).alias("ICD9_CODE"),
    )


def diagnosis_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    return part.groupBy(F.col("p_brand").alias("ICD9_CODE")).agg(
        F.min("p_name").alias("SHORT_TITLE"))


def icu_stays(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_linestatus", "l_returnflag", "l_quantity")
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    parts = task_parts(li)
    if parts:
        # packed files look small enough to broadcast; a task then holds every order
        li, o = li.repartition(parts, "l_orderkey"), o.hint("shuffle_hash")
    j = li.join(o, li.l_orderkey == o.o_orderkey, "inner")
    # max('U' || status || flag) over one-character codes, taken on the
    # character codes so the aggregate stays a hash aggregate (a string max
    # needs a sort-based one); the name is rebuilt afterwards
    code = F.ascii("l_linestatus") * 65536 + F.ascii("l_returnflag")
    g = j.groupBy("l_orderkey", "o_custkey", "l_linenumber").agg(
        F.max(code).alias("_code"),
        F.sum("l_quantity").alias("_qty"),
    ).withColumn("_unit", F.concat(F.lit("U"), F.char(F.floor(F.col("_code") / 65536)),
                                   F.char(F.col("_code") % 65536)))
    k = F.col("l_orderkey") + F.col("l_linenumber")
    return g.select(
        F.col("l_orderkey").alias("HADM_ID"),
        F.col("o_custkey").alias("SUBJECT_ID"),
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("ICUSTAY_ID"),
        F.when(k % 13 == 0, F.lit(None).cast("string")).otherwise(F.col("_unit")).alias("LAST_CAREUNIT"),
        F.when(k % 19 == 0, F.lit(None).cast("double")).otherwise(F.col("_qty") / 20).alias("LOS"),
    )


def patients(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").select("c_custkey")
    key = F.col("c_custkey")
    base = F.when(key % 89 == 0, F.expr("TIMESTAMP_NTZ'1680-01-01 00:00:00'")).otherwise(
        F.expr("TIMESTAMP_NTZ'1915-01-01 00:00:00'"))
    return c.select(
        key.alias("SUBJECT_ID"),
        F.when(key % 2 == 0, "F").otherwise("M").alias("GENDER"),
        (base + _days(key * 37 % 25000)).alias("DOB"),
    )


def drg_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    q = F.col("l_quantity")
    missing = q % 7 == 0
    return li.select(
        F.col("l_orderkey").alias("HADM_ID"),
        F.when(missing, F.lit(None).cast("double")).otherwise(q % 5).alias("DRG_SEVERITY"),
        F.when(missing, F.lit(None).cast("double"))
         .otherwise((F.col("l_linenumber") % 5).cast("double")).alias("DRG_MORTALITY"),
    )


def lab_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = table(spark, sf_dir, "events")
    return ev.select(F.col("event_type").alias("FLAG"), F.col("value").alias("VALUE"))


BINDINGS = {
    "admissions": admissions,
    "services": services,
    "diagnoses": diagnoses,
    "diagnosis_names": diagnosis_names,
    "icu_stays": icu_stays,
    "patients": patients,
    "drg_codes": drg_codes,
    "lab_events": lab_events,
}


#: The driver table whose rows a binding goes through.
OVER = {"admissions": "orders", "services": "lineitem", "diagnoses": "lineitem", "diagnosis_names": "part",
        "icu_stays": "lineitem", "patients": "customer", "drg_codes": "lineitem", "lab_events": "events"}


#: Session setting: "tables" reads hospital tables only, "fixtures" the bindings
#: only, "any" (the default) a hospital table where the folder holds it.
SOURCE_SETTING = "revisit.sources"


def bound(spark: SparkSession, sf_dir: str, name: str, source: str | None = None) -> DataFrame:
    """A hospital table: the real one when the folder holds ``<name>.parquet``
    (see ``revisit.sources.schemas.ingest_sources``), otherwise the fixture
    binding over the driver tables; a driver table if ``name`` is one.

    ``source`` (else the session's ``revisit.sources``) says which may be read:
    with "tables" a missing table raises and no fixture stands in for it.  A
    folder that cannot be looked into raises in any case."""
    if name not in BINDINGS or _stored(spark, sf_dir, name, source):
        return table(spark, sf_dir, name)
    return BINDINGS[name](spark, sf_dir)


def scan(spark: SparkSession, sf_dir: str, name: str, source: str | None = None) -> DataFrame:
    """The table that ``bound`` reads the rows of a hospital table from."""
    if name not in BINDINGS or _stored(spark, sf_dir, name, source):
        return table(spark, sf_dir, name)
    return table(spark, sf_dir, OVER[name])


def _stored(spark: SparkSession, sf_dir: str, name: str, source: str | None) -> bool:
    """Whether the hospital table itself is read, by the rules of ``bound``."""
    source = source or spark.conf.get(SOURCE_SETTING, "any")
    if source not in ("any", "tables", "fixtures"):
        raise ValueError(f"unknown source {source!r}")
    path = os.path.join(sf_dir, f"{name}.parquet")
    if source != "fixtures" and _exists(spark, path):
        return True
    if source == "tables":
        raise FileNotFoundError(f"no table {path}")
    return False


def _exists(spark: SparkSession, path: str) -> bool:
    """Whether the file system of the path, local or not, holds it; what keeps it
    from answering (permission, time-out) is raised."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)
