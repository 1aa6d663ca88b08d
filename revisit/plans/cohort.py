"""The cohort pipeline: journeys → cardiac cohort → enrichment → features.

Each function returns a lazy DataFrame; nothing is collected.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from revisit.functions.scalar import label_within
from revisit.operators.journey import next_event_gap
from revisit.sources.tables import bound, dealt, scan, task_parts

CARDIAC_SERVICES = ("CMED", "CSURG")


def cardiac_admissions(services: DataFrame, codes: Sequence[str] = CARDIAC_SERVICES,
                       key: str = "HADM_ID", service: str = "CURR_SERVICE") -> DataFrame:
    """Distinct admission ids that used one of the given services.  The
    partial distinct collapses repeated ids (even one id holding a third of
    the rows) on the map side, and its hash partitioning on the key is reused
    by the semi join that follows."""
    return services.where(F.col(service).isin(list(codes))).select(key).distinct()


def readmission_gaps(spark: SparkSession, sf_dir: str, keep: Sequence[str] = ()) -> DataFrame:
    """Cardiac admissions that have a next admission, with the gap in days."""
    adm = bound(spark, sf_dir, "admissions")
    gaps = next_event_gap(adm, keep=keep, chunks=task_parts(scan(spark, sf_dir, "admissions")))
    return gaps.join(cardiac_admissions(bound(spark, sf_dir, "services")), "HADM_ID", "left_semi")


def readmission_rate_by_type(spark: SparkSession, sf_dir: str, days: int = 30) -> DataFrame:
    """Flagship: share of cardiac admissions followed by another admission
    within ``days`` days, per admission type."""
    gaps = readmission_gaps(spark, sf_dir, keep=["ADMISSION_TYPE"])
    lab = label_within("DAYS_TO_READMISSION", days)
    return gaps.groupBy("ADMISSION_TYPE").agg(
        F.count(F.lit(1)).alias("n_admissions"),
        F.round(F.avg(lab.cast("double")), 6).alias("readmit_rate"),
        F.count_if(F.col("DAYS_TO_READMISSION") < 0).alias("n_negative_gaps"),
    )


def surgeries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Surgical service rows per admission."""
    from revisit.operators.journey import filtered_group_count
    return filtered_group_count(bound(spark, sf_dir, "services"), "CURR_SERVICE", ["CSURG"],
                                ["CURR_SERVICE", "HADM_ID"], "NO_OF_SURGERIES")


def drg_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    from revisit.operators.journey import group_mean_fill
    return group_mean_fill(_by_admission(spark, sf_dir, "drg_codes"), "HADM_ID",
                           ["DRG_SEVERITY", "DRG_MORTALITY"])


def latest_icu(spark: SparkSession, sf_dir: str) -> DataFrame:
    from revisit.operators.journey import latest_with_total
    return latest_with_total(bound(spark, sf_dir, "icu_stays"), "HADM_ID", "ICUSTAY_ID", "LOS",
                             keep=["SUBJECT_ID", "LAST_CAREUNIT"])


def _by_admission(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table dealt by admission, so that its roll-up and the joins of the cohort
    with it keep their share of a task as the tables grow."""
    return dealt(bound(spark, sf_dir, name), "HADM_ID", of=scan(spark, sf_dir, name))


ADMISSION_ATTRS = ["ADMISSION_TYPE", "ADMITTIME", "ADMISSION_LOCATION", "DISCHARGE_LOCATION",
                   "INSURANCE", "RELIGION", "MARITAL_STATUS", "ETHNICITY"]


def cardiac_surgeries(spark: SparkSession, sf_dir: str, codes: Sequence[str] = CARDIAC_SERVICES,
                      surgical: str = "CSURG") -> DataFrame:
    """One row per admission that used a cardiac service, with its number of
    surgical service rows (0 if none): the cohort filter and the surgery count
    in one aggregate over the services table."""
    svc = _by_admission(spark, sf_dir, "services")
    return (svc.where(F.col("CURR_SERVICE").isin(list(codes))).groupBy("HADM_ID")
            .agg(F.count_if(F.col("CURR_SERVICE") == surgical).alias("NO_OF_SURGERIES")))


def enriched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cardiac readmission gaps with surgeries, admission, patient, DRG and
    ICU attributes.

    Equivalent to the gaps, semi-joined to cardiac services, then five left
    joins on unique keys (surgeries, admissions, patients, DRG means, latest
    ICU stay).  Written to read each source once: admission attributes ride
    along through the gap computation, and the cardiac filter plus the
    surgery count is one aggregate joined once (inner join = semi join, since
    the aggregate has one row per cardiac admission)."""
    from revisit.operators.joins import enrich_all
    gaps = next_event_gap(bound(spark, sf_dir, "admissions"), keep=ADMISSION_ATTRS,
                          chunks=task_parts(scan(spark, sf_dir, "admissions")))
    cohort = gaps.join(cardiac_surgeries(spark, sf_dir), "HADM_ID", "inner")
    # the one SUBJECT_ID-keyed join first; the HADM_ID-keyed joins then run
    # back to back on one hash partitioning of the left side
    out = enrich_all(cohort, [
        (bound(spark, sf_dir, "patients"), "SUBJECT_ID", ["GENDER", "DOB"]),
        (drg_means(spark, sf_dir), "HADM_ID", ["DRG_SEVERITY", "DRG_MORTALITY"]),
        (latest_icu(spark, sf_dir), "HADM_ID", ["LAST_CAREUNIT", "LOS"]),
    ])
    out = out.withColumn("NO_OF_SURGERIES", F.col("NO_OF_SURGERIES").cast("long"))
    return out.select("SUBJECT_ID", "HADM_ID", "CURR_DISCHTIME", "NXT_ADMITTIME", "DAYS_TO_READMISSION",
                      "NO_OF_SURGERIES", *ADMISSION_ATTRS, "GENDER", "DOB", "DRG_SEVERITY", "DRG_MORTALITY",
                      "LAST_CAREUNIT", "LOS")


IMPUTE_MODE = ["RELIGION", "MARITAL_STATUS", "LAST_CAREUNIT"]
HOUR_BANDS = ["EarlyMorning", "Evening", "Morning", "Noon"]


def with_derived(df: DataFrame) -> DataFrame:
    """The enriched cohort with missing LOS as 0, both labels, hour bands and
    their codes, age, its logarithm and the LOS bin."""
    from revisit.functions import scalar as S
    disch_band = S.hour_band(S.hour_of_day("CURR_DISCHTIME"))
    admit_band = S.hour_band(S.hour_of_day("ADMITTIME"))
    age = S.age_years("ADMITTIME", "DOB")
    return df.fillna({"LOS": 0.0}).select(
        "*",
        S.label_within("DAYS_TO_READMISSION", 30).alias("READMISSION_30dAYS"),
        S.label_within("DAYS_TO_READMISSION", 60).alias("READMISSION_60dAYS"),
        disch_band.alias("DISCH_HOUR_BAND"), admit_band.alias("ADMIT_HOUR_BAND"),
        S.ordinal_encode(disch_band, HOUR_BANDS).alias("DISCH_HOUR_CODE"),
        S.ordinal_encode(admit_band, HOUR_BANDS).alias("ADMIT_HOUR_CODE"),
        age.alias("AGE"), S.ln0(age).alias("LOG_AGE"), S.los_bin("LOS").alias("LOS_BIN"))


def final_dataset(spark: SparkSession, sf_dir: str, vocab: Sequence[str] | None = None,
                  fit_on: DataFrame | None = None, base: DataFrame | None = None) -> DataFrame:
    """The modelling table: enriched cohort, imputed, labelled, with derived
    features and one count column per diagnosis code.

    - missing RELIGION / MARITAL_STATUS / LAST_CAREUNIT → column mode (fitted on
      ``fit_on``, default the cohort itself), missing LOS → 0
    - READMISSION_30dAYS / READMISSION_60dAYS labels
    - discharge/admission hour bands and their alphabetical codes
    - AGE (whole years, half to even), LOG_AGE (ln, −inf at 0), LOS_BIN
    - diagnosis code counts over ``vocab`` (absent → 0)

    ``base`` passes an already computed ``enriched`` cohort.
    """
    from revisit.operators import profile as P
    from revisit.operators import relational as R
    from revisit.operators.joins import semi
    from revisit.session import keep

    base = keep(base if base is not None else enriched(spark, sf_dir))
    modes = R.fit_modes(fit_on if fit_on is not None else base, IMPUTE_MODE)
    df = with_derived(base.fillna({c: v for c, v in modes.items() if v is not None}))
    codes_vocab = list(vocab) if vocab is not None else P.fit_vocab(bound(spark, sf_dir, "diagnosis_names"),
                                                                     "ICD9_CODE")
    diag = semi(bound(spark, sf_dir, "diagnoses"), base.select("HADM_ID"), "HADM_ID")
    codes = P.crosstab(diag, "HADM_ID", "ICD9_CODE", codes_vocab)
    return df.join(codes, "HADM_ID", "left").fillna(0, subset=codes_vocab)
