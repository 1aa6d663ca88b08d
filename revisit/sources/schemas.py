"""Source tables of the analysis as exported (gzip CSV with a header) and the
columns the analysis uses, with their types.

Fixed values: the export file names and column names of the source data.
"""

from __future__ import annotations

import csv
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

SOURCE_FILES = {
    "admissions": "ADMISSIONS.csv.gz",
    "services": "SERVICES.csv.gz",
    "diagnoses": "DIAGNOSES_ICD.csv.gz",
    "diagnosis_names": "D_ICD_DIAGNOSES.csv.gz",
    "icu_stays": "ICUSTAYS.csv.gz",
    "patients": "PATIENTS.csv.gz",
    "drg_codes": "DRGCODES.csv.gz",
}

SOURCE_COLUMNS = {
    "admissions": {"SUBJECT_ID": "bigint", "HADM_ID": "bigint", "ADMITTIME": "timestamp_ntz",
                   "DISCHTIME": "timestamp_ntz", "ADMISSION_TYPE": "string", "ADMISSION_LOCATION": "string",
                   "DISCHARGE_LOCATION": "string", "INSURANCE": "string", "RELIGION": "string",
                   "MARITAL_STATUS": "string", "ETHNICITY": "string"},
    "services": {"HADM_ID": "bigint", "CURR_SERVICE": "string"},
    "diagnoses": {"HADM_ID": "bigint", "ICD9_CODE": "string"},
    "diagnosis_names": {"ICD9_CODE": "string", "SHORT_TITLE": "string"},
    "icu_stays": {"HADM_ID": "bigint", "SUBJECT_ID": "bigint", "ICUSTAY_ID": "bigint",
                  "LAST_CAREUNIT": "string", "LOS": "double"},
    "patients": {"SUBJECT_ID": "bigint", "GENDER": "string", "DOB": "timestamp_ntz"},
    "drg_codes": {"HADM_ID": "bigint", "DRG_SEVERITY": "double", "DRG_MORTALITY": "double"},
}


def scan_csv_by_header(spark: SparkSession, path: str, columns: dict[str, str]) -> DataFrame:
    """Header CSV read by column *name*: the header line gives the field
    count and names, rows with more fields than the header are dropped,
    shorter rows are padded with nulls (the ``scan_csv`` rule), and only the
    requested columns are kept, cast leniently (bad values → null)."""
    from revisit.sources.files import scan_csv
    header = spark.read.text(path).first()[0]
    names = next(csv.reader([header]))
    raw = scan_csv(spark, path, T.StructType([T.StructField(n, T.StringType()) for n in names]))
    missing = [c for c in columns if c not in names]
    if missing:
        raise ValueError(f"{path}: columns {missing} not in header")
    out = []
    for c, t in columns.items():
        if t == "timestamp_ntz":
            out.append(F.when(F.try_to_timestamp(F.col(c)).isNotNull(), F.to_timestamp_ntz(F.col(c))).alias(c))
        else:
            out.append(F.col(c).try_cast(t).alias(c))
    return raw.select(*out)


def ingest_sources(spark: SparkSession, csv_dir: str, out_dir: str) -> list[str]:
    """Each exported source table → ``<out_dir>/<name>.parquet`` (the layout
    ``revisit.sources.tables.bound`` reads).  Returns the names written."""
    done = []
    for name, file in SOURCE_FILES.items():
        path = os.path.join(csv_dir, file)
        df = scan_csv_by_header(spark, path, SOURCE_COLUMNS[name])
        df.write.mode("overwrite").parquet(os.path.join(out_dir, f"{name}.parquet"))
        done.append(name)
    return done
