"""Query catalog: one entry per operator of the inventory.

Each entry pairs a Spark query ``fn(spark, sf_dir) -> DataFrame`` with an
independent DuckDB SQL text over the same parquet tables (or ``None`` where the
operator is not expressible in SQL and is checked by invariant tests instead).
Every query runs over whole tables.  Doubles are rounded to 6 decimals on both
sides at the very end, never before an aggregate.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from revisit.functions import scalar as S
from revisit.operators import joins as J
from revisit.operators import journey as JR
from revisit.operators import ordering as O
from revisit.operators import profile as P
from revisit.operators import relational as R
from revisit.operators import sets as ST
from revisit.plans import cohort as C
from revisit.plans.oracle import compose
from revisit.session import keep
from revisit.sources.tables import bound, dealt, scan

QueryFn = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, tuple[QueryFn, str | None]] = {}


def query(key: str, sql: str | None = None, *tables: str):
    def deco(fn: QueryFn) -> QueryFn:
        REGISTRY[key] = (fn, compose(sql, *tables) if sql else None)
        return fn
    return deco


def r6(c) -> F.Column:
    return F.round(F.col(c) if isinstance(c, str) else c, 6)


# Diagnosis-code vocabulary of the fixtures (fixed values of the bound data):
# part brands "Brand#1" … "Brand#25".
ICD_VOCAB = sorted(f"Brand#{i}" for i in range(1, 26))


def _b(spark, d, name):
    return bound(spark, d, name)


# ------------------------------------------------------------------ 2.1 scans


@query("scan_limit", "SELECT * FROM admissions ORDER BY HADM_ID LIMIT 2", "admissions")
def q_scan_limit(spark, d):
    return O.head_rows(_b(spark, d, "admissions"), 2, ["HADM_ID"])


@query("lab_scan", "SELECT DISTINCT FLAG FROM lab_events", "lab_events")
def q_lab_scan(spark, d):
    return P.distinct_values(_b(spark, d, "lab_events"), "FLAG")


@query("lab_values_as_string",
       "SELECT CAST(VALUE AS VARCHAR) AS VALUE FROM lab_events ORDER BY 1", "lab_events")
def q_lab_values(spark, d):
    lab = _b(spark, d, "lab_events")
    return lab.select(S.to_string("VALUE").alias("VALUE")).orderBy("VALUE")


# ------------------------------------------------------------------ 2.2 projections, filters


@query("project_columns", "SELECT HADM_ID, ADMISSION_TYPE, ADMITTIME FROM admissions", "admissions")
def q_project(spark, d):
    return R.project(_b(spark, d, "admissions"), ["HADM_ID", "ADMISSION_TYPE", "ADMITTIME"])


@query("sql_project_alias", """
SELECT SUBJECT_ID, HADM_ID, DISCHTIME AS CURR_DISCHTIME, ADMITTIME AS START_TIME,
       CONCAT(ADMISSION_TYPE, '/', INSURANCE) AS ADM_KIND
FROM admissions""", "admissions")
def q_sql_alias(spark, d):
    return spark.sql(
        "SELECT SUBJECT_ID, HADM_ID, DISCHTIME AS CURR_DISCHTIME, ADMITTIME AS START_TIME, "
        "CONCAT(ADMISSION_TYPE, '/', INSURANCE) AS ADM_KIND FROM {adm}",
        adm=_b(spark, d, "admissions"))


@query("select_star_qualified", """
SELECT a.* FROM admissions a JOIN patients b ON a.SUBJECT_ID = b.SUBJECT_ID
WHERE b.GENDER = 'F'""", "admissions", "patients")
def q_star(spark, d):
    a = _b(spark, d, "admissions").alias("a")
    b = _b(spark, d, "patients").alias("b")
    return a.join(b, F.col("a.SUBJECT_ID") == F.col("b.SUBJECT_ID")).where(
        F.col("b.GENDER") == "F").select("a.*")


@query("rename_all", "SELECT SUBJECT_ID AS PID, GENDER AS SEX, DOB AS BIRTH FROM patients", "patients")
def q_rename_all(spark, d):
    return R.rename_all(_b(spark, d, "patients"), ["PID", "SEX", "BIRTH"])


@query("rename_one", "SELECT HADM_ID, ADMISSION_TYPE AS ADM_TYPE FROM admissions", "admissions")
def q_rename_one(spark, d):
    a = _b(spark, d, "admissions").select("HADM_ID", "ADMISSION_TYPE")
    return R.rename(a, {"ADMISSION_TYPE": "ADM_TYPE"})


@query("drop_columns", """
SELECT SUBJECT_ID, HADM_ID, ADMITTIME, DISCHTIME, ADMISSION_TYPE, ADMISSION_LOCATION,
       DISCHARGE_LOCATION, INSURANCE FROM admissions""", "admissions")
def q_drop(spark, d):
    return R.drop_columns(_b(spark, d, "admissions"), ["RELIGION", "MARITAL_STATUS", "ETHNICITY"])


@query("filter_equals", "SELECT * FROM services WHERE CURR_SERVICE = 'CSURG'", "services")
def q_filter_eq(spark, d):
    return _b(spark, d, "services").where(F.col("CURR_SERVICE") == "CSURG")


@query("filter_compare", "SELECT * FROM gaps WHERE DAYS_TO_READMISSION < 120.0", "gaps")
def q_filter_cmp(spark, d):
    return C.readmission_gaps(spark, d).where(F.col("DAYS_TO_READMISSION") < 120.0)


@query("filter_not_equal", """
SELECT HADM_ID, DRG_SEVERITY FROM drg_codes WHERE DRG_SEVERITY IS DISTINCT FROM 0""", "drg_codes")
def q_filter_ne(spark, d):
    drg = _b(spark, d, "drg_codes")
    return drg.where(R.filter_not_equal("DRG_SEVERITY", 0.0)).select("HADM_ID", "DRG_SEVERITY")


@query("filter_in_list", "SELECT * FROM services WHERE CURR_SERVICE IN ('CMED', 'CSURG')", "services")
def q_filter_in(spark, d):
    return _b(spark, d, "services").where(F.col("CURR_SERVICE").isin("CMED", "CSURG"))


@query("filter_is_null", "SELECT * FROM admissions WHERE RELIGION IS NULL", "admissions")
def q_filter_null(spark, d):
    return _b(spark, d, "admissions").where(F.col("RELIGION").isNull())


@query("filter_conjunction", """
SELECT event_id, value FROM events WHERE event_type = 'purchase' AND floor(value) >= 100""")
def q_filter_and(spark, d):
    ev = _b(spark, d, "events")
    return ev.where((F.col("event_type") == "purchase") & (F.floor("value") >= 100)).select(
        "event_id", "value")


@query("conditional_update", """
SELECT HADM_ID, CASE WHEN RELIGION IS NULL THEN 'UNKNOWN' ELSE RELIGION END AS RELIGION
FROM admissions""", "admissions")
def q_cond_update(spark, d):
    a = _b(spark, d, "admissions").select("HADM_ID", "RELIGION")
    return R.update_where(a, F.col("RELIGION").isNull(), "RELIGION", "UNKNOWN")


@query("fill_const", """
SELECT HADM_ID, COALESCE(DRG_SEVERITY, 0) AS DRG_SEVERITY, COALESCE(DRG_MORTALITY, 0) AS DRG_MORTALITY
FROM drg_codes""", "drg_codes")
def q_fill_const(spark, d):
    return R.fill_const(_b(spark, d, "drg_codes"), {"DRG_SEVERITY": 0.0, "DRG_MORTALITY": 0.0})


@query("fill_mode", """
WITH m AS (
  SELECT c, v FROM (
    SELECT c, v, ROW_NUMBER() OVER (PARTITION BY c ORDER BY n DESC, v ASC) AS rk FROM (
      SELECT 'RELIGION' AS c, RELIGION AS v, COUNT(*) AS n FROM enriched WHERE RELIGION IS NOT NULL GROUP BY 2
      UNION ALL
      SELECT 'MARITAL_STATUS', MARITAL_STATUS, COUNT(*) FROM enriched WHERE MARITAL_STATUS IS NOT NULL GROUP BY 2
      UNION ALL
      SELECT 'LAST_CAREUNIT', LAST_CAREUNIT, COUNT(*) FROM enriched WHERE LAST_CAREUNIT IS NOT NULL GROUP BY 2))
  WHERE rk = 1)
SELECT HADM_ID,
       COALESCE(RELIGION, (SELECT v FROM m WHERE c = 'RELIGION')) AS RELIGION,
       COALESCE(MARITAL_STATUS, (SELECT v FROM m WHERE c = 'MARITAL_STATUS')) AS MARITAL_STATUS,
       COALESCE(LAST_CAREUNIT, (SELECT v FROM m WHERE c = 'LAST_CAREUNIT')) AS LAST_CAREUNIT
FROM enriched""", "enriched")
def q_fill_mode(spark, d):
    e = keep(C.enriched(spark, d).select("HADM_ID", "RELIGION", "MARITAL_STATUS", "LAST_CAREUNIT"))
    return R.fill_mode(e, ["RELIGION", "MARITAL_STATUS", "LAST_CAREUNIT"])


@query("cast_int", "SELECT HADM_ID, TRY_CAST(TRUNC(LOS) AS BIGINT) AS LOS FROM icu_stays", "icu_stays")
def q_cast_int(spark, d):
    i = _b(spark, d, "icu_stays")
    return i.select("HADM_ID", S.cast_int("LOS").alias("LOS"))


@query("select_by_type", """
SELECT ADMISSION_TYPE, ADMISSION_LOCATION, DISCHARGE_LOCATION, INSURANCE, RELIGION, MARITAL_STATUS,
       ETHNICITY FROM admissions""", "admissions")
def q_select_type(spark, d):
    return R.select_by_type(_b(spark, d, "admissions"), T.StringType)


@query("reorder_columns", """
SELECT HADM_ID, ADMISSION_LOCATION, ADMISSION_TYPE, ADMITTIME, DISCHARGE_LOCATION, DISCHTIME,
       ETHNICITY, INSURANCE, MARITAL_STATUS, RELIGION, SUBJECT_ID FROM admissions""", "admissions")
def q_reorder(spark, d):
    return R.reorder(_b(spark, d, "admissions"), ["HADM_ID"])


def _code_matrix(spark, d, vocab):
    """Cardiac admissions × diagnosis code counts."""
    cohort = C.readmission_gaps(spark, d).select("HADM_ID")
    diag = J.semi(_b(spark, d, "diagnoses"), cohort, "HADM_ID")
    return P.crosstab(diag, "HADM_ID", "ICD9_CODE", vocab)


def _code_matrix_sql(vocab, extra_cols=()):
    cols = ",\n       ".join(
        f"CAST(COUNT(*) FILTER (WHERE ICD9_CODE = '{v}') AS BIGINT) AS \"{v}\"" for v in vocab)
    return f"""
SELECT HADM_ID,
       {cols}
FROM diagnoses WHERE ICD9_CODE IS NOT NULL AND HADM_ID IN (SELECT HADM_ID FROM gaps)
GROUP BY HADM_ID"""


@query("crosstab_wide", _code_matrix_sql(ICD_VOCAB), "diagnoses", "gaps")
def q_crosstab(spark, d):
    vocab = P.fit_vocab(_b(spark, d, "diagnosis_names"), "ICD9_CODE")
    return _code_matrix(spark, d, vocab)


_ALIGN_VOCAB = ICD_VOCAB + ["Brand#99"]


@query("align_schema", "SELECT * FROM (" + _code_matrix_sql(ICD_VOCAB[:20]) + ") x",
       "diagnoses", "gaps")
def q_align(spark, d):
    # matrix over the full vocabulary, aligned to a saved vocabulary that
    # lacks the last five codes and has one unseen code (added as 0, then the
    # unseen one dropped again by a second alignment)
    m = _code_matrix(spark, d, ICD_VOCAB)
    step = R.align_schema(m, ["HADM_ID"], ICD_VOCAB[:20] + ["Brand#99"])
    return R.align_schema(step, ["HADM_ID"], ICD_VOCAB[:20])


# ------------------------------------------------------------------ 2.3 joins


@query("join_left", """
SELECT g.*, a.ADMISSION_TYPE, a.INSURANCE FROM gaps g LEFT JOIN admissions a ON g.HADM_ID = a.HADM_ID""",
       "gaps", "admissions")
def q_join_left(spark, d):
    return J.enrich(C.readmission_gaps(spark, d), _b(spark, d, "admissions"), "HADM_ID",
                    ["ADMISSION_TYPE", "INSURANCE"])


@query("enrich_chain", "SELECT * FROM enriched", "enriched")
def q_enrich_chain(spark, d):
    return C.enriched(spark, d)


@query("join_left_sql", """
SELECT a.HADM_ID, a.SUBJECT_ID, b.GENDER FROM admissions a LEFT OUTER JOIN patients b
ON a.SUBJECT_ID = b.SUBJECT_ID""", "admissions", "patients")
def q_join_left_sql(spark, d):
    return spark.sql(
        "SELECT a.HADM_ID, a.SUBJECT_ID, b.GENDER FROM {adm} a LEFT OUTER JOIN {pat} b "
        "ON a.SUBJECT_ID = b.SUBJECT_ID",
        adm=_b(spark, d, "admissions"), pat=_b(spark, d, "patients"))


@query("join_inner_composite", """
SELECT i.HADM_ID, i.ICUSTAY_ID, i.SUBJECT_ID, i.LAST_CAREUNIT, i.LOS AS LOS_x, t.LOS AS LOS_y
FROM icu_stays i JOIN (SELECT HADM_ID, MAX(ICUSTAY_ID) AS ICUSTAY_ID, SUM(LOS) AS LOS
                       FROM icu_stays GROUP BY HADM_ID) t
ON i.HADM_ID = t.HADM_ID AND i.ICUSTAY_ID = t.ICUSTAY_ID""", "icu_stays")
def q_join_composite(spark, d):
    icu = _b(spark, d, "icu_stays")
    agg = JR.group_max_sum(icu, "HADM_ID", "ICUSTAY_ID", "LOS")
    on = ["HADM_ID", "ICUSTAY_ID"]
    return J.join_suffix(dealt(icu, *on, of=scan(spark, d, "icu_stays")), agg, on)


@query("join_self_successor", """
SELECT SUBJECT_ID, HADM_ID, DISCHTIME AS CURR_DISCHTIME, NXT AS NXT_ADMITTIME,
       (epoch_us(NXT) - epoch_us(DISCHTIME)) / 86400e6 AS DAYS_TO_READMISSION FROM (
  SELECT SUBJECT_ID, HADM_ID, DISCHTIME,
         LEAD(ADMITTIME) OVER w AS NXT, LEAD(HADM_ID) OVER w AS NXT_ID FROM admissions
  WINDOW w AS (PARTITION BY SUBJECT_ID ORDER BY ADMITTIME ASC NULLS LAST, HADM_ID ASC NULLS LAST))
WHERE NXT_ID IS NOT NULL""", "admissions")
def q_self_successor(spark, d):
    adm = _b(spark, d, "admissions")
    seq = JR.sequence_events(adm, "SUBJECT_ID", ["ADMITTIME", "HADM_ID"])
    return JR.next_event_selfjoin(seq)


@query("semi_join_subquery", "SELECT * FROM gaps", "gaps")
def q_semi_subquery(spark, d):
    return C.readmission_gaps(spark, d)


@query("semi_join_idlist", """
SELECT HADM_ID, ICD9_CODE FROM diagnoses WHERE HADM_ID IN (SELECT HADM_ID FROM gaps)""",
       "diagnoses", "gaps")
def q_semi_idlist(spark, d):
    ids = C.readmission_gaps(spark, d).select("HADM_ID")
    return J.semi(_b(spark, d, "diagnoses"), ids, "HADM_ID")


@query("anti_join_check", """
SELECT DISTINCT HADM_ID FROM gaps WHERE HADM_ID NOT IN (
  SELECT HADM_ID FROM diagnoses WHERE ICD9_CODE IS NOT NULL)""", "gaps", "diagnoses")
def q_anti(spark, d):
    codes = _b(spark, d, "diagnoses").where(F.col("ICD9_CODE").isNotNull())
    return J.missing_keys(C.readmission_gaps(spark, d), codes, "HADM_ID").distinct()


@query("join_where_count", """
SELECT a.SUBJECT_ID, a.HADM_ID, b.READMISSION_COUNT FROM admissions a,
  (SELECT SUBJECT_ID, COUNT(SUBJECT_ID) AS READMISSION_COUNT FROM admissions GROUP BY SUBJECT_ID) b
WHERE a.SUBJECT_ID = b.SUBJECT_ID""", "admissions")
def q_join_where(spark, d):
    adm = _b(spark, d, "admissions")
    counts = JR.entity_counts(adm, "SUBJECT_ID")
    return J.count_joined(adm.select("SUBJECT_ID", "HADM_ID"), counts, "SUBJECT_ID")


@query("zip_columns", """
SELECT HADM_ID, CAST(HOUR(ADMITTIME) AS INTEGER) AS ADMIT_HOUR, CAST(HOUR(DISCHTIME) AS INTEGER) AS DISCH_HOUR
FROM admissions""", "admissions")
def q_zip(spark, d):
    adm = _b(spark, d, "admissions")
    left = adm.select("HADM_ID", S.hour_of_day("ADMITTIME").alias("ADMIT_HOUR"))
    right = adm.select("HADM_ID", S.hour_of_day("DISCHTIME").alias("DISCH_HOUR"))
    return J.zip_by_key(left, right, "HADM_ID")


# ------------------------------------------------------------------ 2.4 aggregates


@query("group_max_sum", """
SELECT HADM_ID, MAX(ICUSTAY_ID) AS ICUSTAY_ID, ROUND(SUM(LOS), 6) AS LOS FROM icu_stays GROUP BY HADM_ID""",
       "icu_stays")
def q_group_max_sum(spark, d):
    g = JR.group_max_sum(_b(spark, d, "icu_stays"), "HADM_ID", "ICUSTAY_ID", "LOS")
    return g.withColumn("LOS", r6("LOS"))


@query("latest_record_rollup", "SELECT HADM_ID, SUBJECT_ID, LAST_CAREUNIT, ICUSTAY_ID, ROUND(LOS, 6) AS LOS FROM latest_icu",
       "latest_icu")
def q_latest(spark, d):
    return C.latest_icu(spark, d).withColumn("LOS", r6("LOS"))


@query("group_mean_fill", """
SELECT HADM_ID, ROUND(DRG_SEVERITY, 6) AS DRG_SEVERITY, ROUND(DRG_MORTALITY, 6) AS DRG_MORTALITY
FROM drg_means""", "drg_means")
def q_group_mean(spark, d):
    m = C.drg_means(spark, d)
    return m.select("HADM_ID", r6("DRG_SEVERITY").alias("DRG_SEVERITY"),
                    r6("DRG_MORTALITY").alias("DRG_MORTALITY"))


@query("group_count", """
SELECT SUBJECT_ID, COUNT(*) AS READMISSION_COUNT FROM admissions WHERE SUBJECT_ID IS NOT NULL
GROUP BY SUBJECT_ID""", "admissions")
def q_group_count(spark, d):
    return JR.entity_counts(_b(spark, d, "admissions"), "SUBJECT_ID")


@query("filter_repeat_entities", """
SELECT a.*, c.READMISSION_COUNT FROM admissions a JOIN (
  SELECT SUBJECT_ID, COUNT(*) AS READMISSION_COUNT FROM admissions GROUP BY SUBJECT_ID) c
ON a.SUBJECT_ID = c.SUBJECT_ID WHERE c.READMISSION_COUNT > 1""", "admissions")
def q_repeat(spark, d):
    return JR.repeat_entities(_b(spark, d, "admissions"), "SUBJECT_ID", 2, "READMISSION_COUNT")


@query("count_repeat_entities", """
SELECT COUNT(*) AS n_entities FROM (
  SELECT SUBJECT_ID FROM admissions GROUP BY SUBJECT_ID HAVING COUNT(*) > 1)""", "admissions")
def q_count_repeat(spark, d):
    c = JR.entity_counts(_b(spark, d, "admissions"), "SUBJECT_ID")
    return c.where(F.col("READMISSION_COUNT") > 1).agg(F.count(F.lit(1)).alias("n_entities"))


@query("filtered_group_count", "SELECT * FROM surgeries", "surgeries")
def q_surgeries(spark, d):
    return C.surgeries(spark, d)


@query("group_count_all", """
SELECT SUBJECT_ID, COUNT(HADM_ID) AS HADM_ID, COUNT(RELIGION) AS RELIGION,
       COUNT(MARITAL_STATUS) AS MARITAL_STATUS FROM admissions GROUP BY SUBJECT_ID""", "admissions")
def q_group_nonnull(spark, d):
    a = _b(spark, d, "admissions").select("SUBJECT_ID", "HADM_ID", "RELIGION", "MARITAL_STATUS")
    return P.group_nonnull(a, "SUBJECT_ID")


@query("group_count_two_keys", """
SELECT CASE WHEN DAYS_TO_READMISSION <= 30 THEN 1 ELSE 0 END AS READMISSION_30dAYS,
       CAST(HOUR(CURR_DISCHTIME) AS INTEGER) AS DISCH_HOUR, COUNT(HADM_ID) AS n
FROM gaps GROUP BY 1, 2""", "gaps")
def q_count_two(spark, d):
    g = C.readmission_gaps(spark, d).select(
        "HADM_ID", S.label_within("DAYS_TO_READMISSION", 30).alias("READMISSION_30dAYS"),
        S.hour_of_day("CURR_DISCHTIME").alias("DISCH_HOUR"))
    return P.group_count_two_keys(g, "READMISSION_30dAYS", "DISCH_HOUR", "HADM_ID", "n")


@query("distinct_values", "SELECT DISTINCT CURR_SERVICE FROM services", "services")
def q_distinct(spark, d):
    return P.distinct_values(_b(spark, d, "services"), "CURR_SERVICE")


@query("distinct_count", """
SELECT COUNT(DISTINCT RELIGION) + MAX(CASE WHEN RELIGION IS NULL THEN 1 ELSE 0 END) AS n_distinct
FROM admissions""", "admissions")
def q_ndistinct(spark, d):
    return P.n_distinct(_b(spark, d, "admissions"), "RELIGION")


@query("multiplicity_check", """
SELECT COUNT(HADM_ID) AS n_rows, COUNT(DISTINCT HADM_ID) AS n_distinct,
       COUNT(HADM_ID) - COUNT(DISTINCT HADM_ID) AS n_extra FROM icu_stays""", "icu_stays")
def q_multiplicity(spark, d):
    return P.multiplicity(_b(spark, d, "icu_stays"), "HADM_ID")


@query("unique_key_check", """
SELECT COUNT(*) AS n_repeated_values FROM (
  SELECT HADM_ID FROM admissions GROUP BY HADM_ID HAVING COUNT(*) > 1)""", "admissions")
def q_unique(spark, d):
    return P.is_unique(_b(spark, d, "admissions"), "HADM_ID")


@query("value_counts", """
SELECT MARITAL_STATUS, COUNT(*) AS count FROM admissions WHERE MARITAL_STATUS IS NOT NULL
GROUP BY 1 ORDER BY 2 DESC, 1""", "admissions")
def q_value_counts(spark, d):
    return P.value_counts(_b(spark, d, "admissions"), "MARITAL_STATUS")


@query("count_where", "SELECT COUNT(*) AS n FROM gaps WHERE DAYS_TO_READMISSION >= 30", "gaps")
def q_count_where(spark, d):
    return P.count_where(C.readmission_gaps(spark, d), F.col("DAYS_TO_READMISSION") >= 30)


@query("null_profile", """
SELECT column_name AS "column", n_null FROM (
  SELECT 'RELIGION' AS column_name, COUNT(*) FILTER (WHERE RELIGION IS NULL) AS n_null FROM enriched
  UNION ALL SELECT 'MARITAL_STATUS', COUNT(*) FILTER (WHERE MARITAL_STATUS IS NULL) FROM enriched
  UNION ALL SELECT 'LAST_CAREUNIT', COUNT(*) FILTER (WHERE LAST_CAREUNIT IS NULL) FROM enriched
  UNION ALL SELECT 'LOS', COUNT(*) FILTER (WHERE LOS IS NULL) FROM enriched
  UNION ALL SELECT 'DRG_SEVERITY', COUNT(*) FILTER (WHERE DRG_SEVERITY IS NULL) FROM enriched
  UNION ALL SELECT 'DRG_MORTALITY', COUNT(*) FILTER (WHERE DRG_MORTALITY IS NULL) FROM enriched
  UNION ALL SELECT 'GENDER', COUNT(*) FILTER (WHERE GENDER IS NULL) FROM enriched
  UNION ALL SELECT 'NO_OF_SURGERIES', COUNT(*) FILTER (WHERE NO_OF_SURGERIES IS NULL) FROM enriched)
WHERE n_null > 0""", "enriched")
def q_null_profile(spark, d):
    e = C.enriched(spark, d).select("RELIGION", "MARITAL_STATUS", "LAST_CAREUNIT", "LOS",
                                    "DRG_SEVERITY", "DRG_MORTALITY", "GENDER", "NO_OF_SURGERIES")
    return P.null_profile(e)


@query("table_info", """
SELECT * FROM (VALUES
  (0, 'SUBJECT_ID', 'bigint', (SELECT COUNT(SUBJECT_ID) FROM patients)),
  (1, 'GENDER', 'string', (SELECT COUNT(GENDER) FROM patients)),
  (2, 'DOB', 'timestamp_ntz', (SELECT COUNT(DOB) FROM patients)))
  AS t(position, "column", "type", non_null)""", "patients")
def q_table_info(spark, d):
    return P.table_info(_b(spark, d, "patients"))


@query("table_shape", "SELECT COUNT(*) AS n_rows, 11 AS n_columns FROM admissions", "admissions")
def q_table_shape(spark, d):
    return P.table_shape(_b(spark, d, "admissions"))


@query("describe_column", """
SELECT COUNT(l_quantity) AS count, ROUND(AVG(l_quantity), 6) AS mean,
       ROUND(STDDEV_SAMP(l_quantity), 6) AS std, MIN(l_quantity) AS min,
       ROUND(QUANTILE_CONT(l_quantity, 0.25), 6) AS q25, ROUND(QUANTILE_CONT(l_quantity, 0.5), 6) AS q50,
       ROUND(QUANTILE_CONT(l_quantity, 0.75), 6) AS q75, MAX(l_quantity) AS max
FROM lineitem""")
def q_describe(spark, d):
    out = P.describe(_b(spark, d, "lineitem"), "l_quantity")
    return out.select("count", *[r6(c).alias(c) for c in ("mean", "std", "min", "q25", "q50", "q75", "max")])


@query("iqr_outliers", """
WITH q AS (SELECT QUANTILE_CONT(l_extendedprice, 0.25) AS q1, QUANTILE_CONT(l_extendedprice, 0.75) AS q3
           FROM lineitem)
SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem, q
WHERE l_extendedprice < q1 - 0.25 * (q3 - q1) OR l_extendedprice > q3 + 0.25 * (q3 - q1)""")
def q_iqr(spark, d):
    """With a quarter of the range: at 1.5 these prices have no outlier."""
    li = _b(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice")
    return P.iqr_outliers(li, "l_extendedprice", 0.25)


@query("equal_width_bins", """
WITH m AS (SELECT MIN(l_quantity) AS lo, MAX(l_quantity) AS hi FROM lineitem)
SELECT bin, COUNT(*) AS n FROM (
  SELECT LEAST(GREATEST(0, CAST(CEIL((l_quantity - lo) / (hi - lo) * 4) AS INTEGER) - 1), 3) AS bin
  FROM lineitem, m) GROUP BY bin""")
def q_bins(spark, d):
    b = P.equal_width_bins(_b(spark, d, "lineitem"), "l_quantity", 4)
    return b.groupBy("bin").agg(F.count(F.lit(1)).alias("n"))


_NUM = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def _corr_sql():
    rows = []
    for a in _NUM:
        for b in _NUM:
            rows.append(f"SELECT '{a}' AS a, '{b}' AS b, ROUND(CASE WHEN STDDEV_POP({a}) * STDDEV_POP({b}) = 0 "
                        f"THEN NULL ELSE COVAR_POP({a}, {b}) / (STDDEV_POP({a}) * STDDEV_POP({b})) END, 6) AS r "
                        f"FROM lineitem")
    return "\nUNION ALL ".join(rows)


@query("correlation_matrix", _corr_sql())
def q_corr(spark, d):
    m = P.corr_matrix(_b(spark, d, "lineitem"), _NUM)
    return m.withColumn("r", r6("r"))


@query("column_variance", "\nUNION ALL ".join(
    f"SELECT '{c}' AS \"column\", ROUND(VAR_POP({c}), 6) AS variance FROM lineitem" for c in _NUM))
def q_variance(spark, d):
    return P.variances(_b(spark, d, "lineitem"), _NUM).withColumn("variance", r6("variance"))


_CATS = ["ADMISSION_TYPE", "ADMISSION_LOCATION", "DISCHARGE_LOCATION", "INSURANCE", "RELIGION", "MARITAL_STATUS", "ETHNICITY",
         "GENDER", "LAST_CAREUNIT"]


@query("category_by_label_counts", "\nUNION ALL ".join(
    f"SELECT '{c}' AS variable, CAST({c} AS VARCHAR) AS value, "
    f"CASE WHEN DAYS_TO_READMISSION <= 30 THEN 1 ELSE 0 END AS label, COUNT(*) AS count "
    f"FROM enriched GROUP BY 2, 3" for c in _CATS), "enriched")
def q_cat_label(spark, d):
    e = C.enriched(spark, d).withColumn("label", S.label_within("DAYS_TO_READMISSION", 30))
    return P.counts_by_label(e, _CATS, "label")


@query("histogram", """
WITH m AS (SELECT MIN(l_extendedprice) AS lo, MAX(l_extendedprice) AS hi FROM lineitem),
c AS (SELECT LEAST(CAST(FLOOR((l_extendedprice - lo) / ((hi - lo) / 10)) AS INTEGER), 9) AS bin, COUNT(*) AS n
      FROM lineitem, m GROUP BY 1)
SELECT CAST(g.bin AS INTEGER) AS bin, ROUND(lo + g.bin * (hi - lo) / 10, 6) AS lower, ROUND(lo + (g.bin + 1) * (hi - lo) / 10, 6) AS upper,
       COALESCE(c.n, 0) AS count
FROM (SELECT UNNEST(RANGE(0, 10)) AS bin) g CROSS JOIN m LEFT JOIN c ON g.bin = c.bin""")
def q_hist(spark, d):
    h = P.histogram(_b(spark, d, "lineitem"), "l_extendedprice", 10)
    return h.select("bin", r6("lower").alias("lower"), r6("upper").alias("upper"), "count")


_KDE_GRID = [float(x) for x in range(0, 500, 25)]


@query("kde_grid", f"""
WITH p AS (SELECT CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END AS y, value AS x FROM events),
s AS (SELECT y, COUNT(*) AS n, STDDEV_SAMP(x) * POW(COUNT(*), -0.2) AS h FROM p GROUP BY y),
g AS (SELECT UNNEST(RANGE(0, {len(_KDE_GRID)})) AS gi)
SELECT p.y, g.gi, CAST(g.gi * 25 AS DOUBLE) AS g,
       ROUND(SUM(EXP(-0.5 * POW((g.gi * 25 - p.x) / s.h, 2))) / (ANY_VALUE(s.n) * ANY_VALUE(s.h) * SQRT(2 * PI())), 6) AS density
FROM p JOIN s ON p.y = s.y CROSS JOIN g GROUP BY p.y, g.gi""")
def q_kde(spark, d):
    ev = _b(spark, d, "events").select(
        (F.col("event_type") == "purchase").cast("int").alias("y"), "value")
    k = P.kde(ev, "value", "y", _KDE_GRID)
    return k.select("y", F.col("gi").cast("bigint").alias("gi"), F.col("grid").alias("g"),
                    r6("density").alias("density"))


@query("scalar_max", "SELECT MAX(l_extendedprice) AS max_l_extendedprice FROM lineitem")
def q_max(spark, d):
    return P.scalar_max(_b(spark, d, "lineitem"), "l_extendedprice")


# ------------------------------------------------------------------ 2.5 windows


@query("sequence_events", """
SELECT SUBJECT_ID, HADM_ID, ROW_NUMBER() OVER (PARTITION BY SUBJECT_ID
       ORDER BY ADMITTIME ASC NULLS LAST, HADM_ID ASC NULLS LAST) AS SEQUENCE FROM admissions""",
       "admissions")
def q_sequence(spark, d):
    a = _b(spark, d, "admissions").select("SUBJECT_ID", "HADM_ID", "ADMITTIME")
    return JR.sequence_events(a, "SUBJECT_ID", ["ADMITTIME", "HADM_ID"]).select(
        "SUBJECT_ID", "HADM_ID", "SEQUENCE")


@query("next_event_gap", """
SELECT SUBJECT_ID, HADM_ID, CURR_DISCHTIME, NXT_ADMITTIME, ROUND(DAYS_TO_READMISSION, 6) AS DAYS_TO_READMISSION
FROM (
  SELECT SUBJECT_ID, HADM_ID, DISCHTIME AS CURR_DISCHTIME, LEAD(ADMITTIME) OVER w AS NXT_ADMITTIME,
         (epoch_us(LEAD(ADMITTIME) OVER w) - epoch_us(DISCHTIME)) / 86400e6 AS DAYS_TO_READMISSION,
         LEAD(HADM_ID) OVER w AS NXT_ID FROM admissions
  WINDOW w AS (PARTITION BY SUBJECT_ID ORDER BY ADMITTIME ASC NULLS LAST, HADM_ID ASC NULLS LAST))
WHERE NXT_ID IS NOT NULL""", "admissions")
def q_next_gap(spark, d):
    g = JR.next_event_gap(_b(spark, d, "admissions"))
    return g.withColumn("DAYS_TO_READMISSION", r6("DAYS_TO_READMISSION"))


# ------------------------------------------------------------------ 2.6 sorts


@query("sort_multi", "SELECT SUBJECT_ID, ADMITTIME, HADM_ID FROM admissions ORDER BY 1, 2, 3", "admissions")
def q_sort(spark, d):
    a = _b(spark, d, "admissions").select("SUBJECT_ID", "ADMITTIME", "HADM_ID")
    return O.sort_multi(a, ["SUBJECT_ID", "ADMITTIME", "HADM_ID"])


@query("sort_desc", """
SELECT ICD9_CODE, COUNT(*) AS count FROM diagnoses WHERE ICD9_CODE IS NOT NULL GROUP BY 1
ORDER BY 2 DESC, 1""", "diagnoses")
def q_sort_desc(spark, d):
    return P.value_counts(_b(spark, d, "diagnoses"), "ICD9_CODE")


@query("head_rows", "SELECT * FROM admissions ORDER BY SUBJECT_ID, ADMITTIME, HADM_ID LIMIT 5", "admissions")
def q_head(spark, d):
    return O.head_rows(_b(spark, d, "admissions"), 5, ["SUBJECT_ID", "ADMITTIME", "HADM_ID"])


@query("top_k", """
SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice FROM lineitem
ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber, l_partkey LIMIT 251""")
def q_topk(spark, d):
    li = _b(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice")
    return O.top_k(li, "l_extendedprice", 251, ["l_orderkey", "l_linenumber", "l_partkey"])


# ------------------------------------------------------------------ 2.7 set operations


@query("set_union", """
SELECT ICD9_CODE FROM diagnoses WHERE HADM_ID % 2 = 0 AND ICD9_CODE IS NOT NULL
UNION
SELECT ICD9_CODE FROM diagnoses WHERE HADM_ID % 3 = 0 AND ICD9_CODE IS NOT NULL""", "diagnoses")
def q_union(spark, d):
    dg = _b(spark, d, "diagnoses").where(F.col("ICD9_CODE").isNotNull())
    return ST.union_distinct(dg.where(F.col("HADM_ID") % 2 == 0).select("ICD9_CODE"),
                             dg.where(F.col("HADM_ID") % 3 == 0).select("ICD9_CODE"))


@query("set_difference", """
SELECT HADM_ID FROM admissions EXCEPT SELECT HADM_ID FROM gaps""", "admissions", "gaps")
def q_except(spark, d):
    return ST.except_(_b(spark, d, "admissions").select("HADM_ID"),
                      C.readmission_gaps(spark, d).select("HADM_ID"))


@query("set_equality", """
WITH a AS (SELECT DISTINCT HADM_ID FROM gaps),
     b AS (SELECT DISTINCT HADM_ID FROM diagnoses WHERE HADM_ID IN (SELECT HADM_ID FROM gaps))
SELECT (SELECT COUNT(*) FROM (SELECT * FROM a EXCEPT SELECT * FROM b)) AS only_left,
       (SELECT COUNT(*) FROM (SELECT * FROM b EXCEPT SELECT * FROM a)) AS only_right,
       (SELECT COUNT(*) FROM (SELECT * FROM a EXCEPT SELECT * FROM b)) = 0
   AND (SELECT COUNT(*) FROM (SELECT * FROM b EXCEPT SELECT * FROM a)) = 0 AS equal""",
       "gaps", "diagnoses")
def q_set_eq(spark, d):
    ids = C.readmission_gaps(spark, d).select("HADM_ID")
    diag_ids = J.semi(_b(spark, d, "diagnoses"), ids, "HADM_ID").select("HADM_ID")
    return ST.same_keys(ids, diag_ids, "HADM_ID")


@query("append_columns_union", """
SELECT HADM_ID, ICD9_CODE, NULL::VARCHAR AS SHORT_TITLE FROM diagnoses
UNION ALL SELECT NULL::BIGINT, ICD9_CODE, SHORT_TITLE FROM diagnosis_names""", "diagnoses", "diagnosis_names")
def q_union_by_name(spark, d):
    return R.union_by_name(_b(spark, d, "diagnoses"), _b(spark, d, "diagnosis_names"))


# ------------------------------------------------------------------ 2.8 scalar functions


@query("julian_day", """
SELECT HADM_ID, ROUND(epoch_us(ADMITTIME) / 86400e6 + 2440587.5, 6) AS ADMIT_JULIAN FROM admissions""",
       "admissions")
def q_julian(spark, d):
    a = _b(spark, d, "admissions")
    return a.select("HADM_ID", r6(S.julian_day("ADMITTIME")).alias("ADMIT_JULIAN"))


@query("days_between", """
SELECT HADM_ID, ROUND((epoch_us(DISCHTIME) - epoch_us(ADMITTIME)) / 86400e6, 6) AS STAY_DAYS
FROM admissions""", "admissions")
def q_days(spark, d):
    a = _b(spark, d, "admissions")
    return a.select("HADM_ID", r6(S.days_between("ADMITTIME", "DISCHTIME")).alias("STAY_DAYS"))


@query("parse_timestamp", """
SELECT event_id, TRY_CAST(CAST(ts AS VARCHAR) AS TIMESTAMP) AS parsed FROM events""")
def q_parse(spark, d):
    ev = _b(spark, d, "events")
    return ev.select("event_id", S.parse_ts(F.col("ts").cast("string"), "yyyy/MM/dd").alias("parsed"))


@query("format_date", "SELECT HADM_ID, strftime(ADMITTIME, '%Y-%m-%d') AS ADMIT_DATE FROM admissions",
       "admissions")
def q_format(spark, d):
    return _b(spark, d, "admissions").select("HADM_ID", S.format_date("ADMITTIME").alias("ADMIT_DATE"))


@query("hour_of_day", """
SELECT HADM_ID, CAST(HOUR(ADMITTIME) AS INTEGER) AS ADMIT_HOUR, CAST(HOUR(DISCHTIME) AS INTEGER) AS DISCH_HOUR
FROM admissions""", "admissions")
def q_hour(spark, d):
    a = _b(spark, d, "admissions")
    return a.select("HADM_ID", S.hour_of_day("ADMITTIME").alias("ADMIT_HOUR"),
                    S.hour_of_day("DISCHTIME").alias("DISCH_HOUR"))


_AGE_SQL = "CAST(ABS(ROUND_EVEN((epoch_us(a.ADMITTIME) - epoch_us(p.DOB)) / 86400e6 / 365.0, 0)) AS INTEGER)"


@query("age_years", f"""
SELECT a.HADM_ID, {_AGE_SQL} AS AGE FROM admissions a JOIN patients p ON a.SUBJECT_ID = p.SUBJECT_ID""",
       "admissions", "patients")
def q_age(spark, d):
    j = _b(spark, d, "admissions").join(_b(spark, d, "patients"), "SUBJECT_ID")
    return j.select("HADM_ID", S.age_years("ADMITTIME", "DOB").alias("AGE"))


@query("natural_log", f"""
SELECT HADM_ID, ROUND(CASE WHEN AGE = 0 THEN -'inf'::DOUBLE ELSE LN(AGE) END, 6) AS LOG_AGE FROM (
  SELECT a.HADM_ID, {_AGE_SQL} AS AGE FROM admissions a JOIN patients p ON a.SUBJECT_ID = p.SUBJECT_ID)""",
       "admissions", "patients")
def q_ln(spark, d):
    j = _b(spark, d, "admissions").join(_b(spark, d, "patients"), "SUBJECT_ID")
    a = j.select("HADM_ID", S.age_years("ADMITTIME", "DOB").alias("AGE"))
    return a.select("HADM_ID", r6(S.ln0("AGE")).alias("LOG_AGE"))


_BAND_SQL = """CASE WHEN HOUR({c}) <= 10 THEN 'EarlyMorning' WHEN HOUR({c}) <= 12 THEN 'Morning'
            WHEN HOUR({c}) <= 18 THEN 'Noon' ELSE 'Evening' END"""


@query("hour_band", f"""
SELECT HADM_ID, {_BAND_SQL.format(c='ADMITTIME')} AS ADMIT_BAND,
       {_BAND_SQL.format(c='DISCHTIME')} AS DISCH_BAND FROM admissions""", "admissions")
def q_band(spark, d):
    a = _b(spark, d, "admissions")
    return a.select("HADM_ID", S.hour_band(S.hour_of_day("ADMITTIME")).alias("ADMIT_BAND"),
                    S.hour_band(S.hour_of_day("DISCHTIME")).alias("DISCH_BAND"))


@query("los_bin", """
SELECT ICUSTAY_ID, CASE WHEN LOS < 0.6 THEN 0 WHEN LOS > 0.6 AND LOS <= 1.3 THEN 1
                        WHEN LOS > 1.3 AND LOS <= 2.3 THEN 2 ELSE 3 END AS LOS_BIN FROM icu_stays""",
       "icu_stays")
def q_los_bin(spark, d):
    # per stay: the rolled-up total is a float sum whose last bit depends on
    # summation order, which decides values sitting exactly on a bin edge
    return _b(spark, d, "icu_stays").select("ICUSTAY_ID", S.los_bin("LOS").alias("LOS_BIN"))


@query("label_within", """
SELECT HADM_ID, CASE WHEN DAYS_TO_READMISSION <= 60 THEN 1 ELSE 0 END AS READMISSION_60dAYS,
       CASE WHEN DAYS_TO_READMISSION <= 30 THEN 1 ELSE 0 END AS READMISSION_30dAYS FROM gaps""", "gaps")
def q_label(spark, d):
    g = C.readmission_gaps(spark, d)
    return g.select("HADM_ID", S.label_within("DAYS_TO_READMISSION", 60).alias("READMISSION_60dAYS"),
                    S.label_within("DAYS_TO_READMISSION", 30).alias("READMISSION_30dAYS"))


@query("threshold_label", """
SELECT event_id, CASE WHEN value / 500 < 0.5 THEN 0 WHEN value / 500 >= 0.5 THEN 1 END AS pred FROM events""")
def q_threshold(spark, d):
    ev = _b(spark, d, "events")
    return ev.select("event_id", S.threshold_label(F.col("value") / 500, 0.5).alias("pred"))


# Fixture recode: eight ethnicity codes to four groups, one code left unmapped.
ETHNICITY_GROUPS = {"ETH0": "WHITE", "ETH1": "WHITE", "ETH2": "BLACK", "ETH3": "ASIAN",
                    "ETH4": "HISPANIC", "ETH5": "OTHER", "ETH6": "OTHER"}


@query("map_values", "SELECT HADM_ID, CASE ETHNICITY " + " ".join(
    f"WHEN '{k}' THEN '{v}'" for k, v in ETHNICITY_GROUPS.items()) + " END AS ETHNICITY_GROUP FROM admissions",
       "admissions")
def q_recode(spark, d):
    a = _b(spark, d, "admissions")
    return a.select("HADM_ID", S.recode("ETHNICITY", ETHNICITY_GROUPS).alias("ETHNICITY_GROUP"))


HOUR_BANDS = ["EarlyMorning", "Evening", "Morning", "Noon"]


@query("ordinal_encode", f"""
SELECT HADM_ID, CASE {_BAND_SQL.format(c='ADMITTIME')} WHEN 'EarlyMorning' THEN 0 WHEN 'Evening' THEN 1
       WHEN 'Morning' THEN 2 WHEN 'Noon' THEN 3 END AS ADMIT_BAND_CODE FROM admissions""", "admissions")
def q_ordinal(spark, d):
    a = _b(spark, d, "admissions")
    return a.select("HADM_ID", S.ordinal_encode(S.hour_band(S.hour_of_day("ADMITTIME")), HOUR_BANDS)
                    .alias("ADMIT_BAND_CODE"))


DRG_LEVELS = [1.0, 2.0, 3.0, 4.0]


@query("ordered_category", """
SELECT HADM_ID, CASE DRG_SEVERITY WHEN 1.0 THEN 0 WHEN 2.0 THEN 1 WHEN 3.0 THEN 2 WHEN 4.0 THEN 3 END
       AS SEVERITY_LEVEL FROM drg_codes""", "drg_codes")
def q_ordered_cat(spark, d):
    drg = _b(spark, d, "drg_codes")
    return drg.select("HADM_ID", S.ordinal_levels("DRG_SEVERITY", DRG_LEVELS).alias("SEVERITY_LEVEL"))


@query("to_string", "SELECT CAST(HADM_ID AS VARCHAR) AS HADM_ID FROM admissions", "admissions")
def q_to_string(spark, d):
    return _b(spark, d, "admissions").select(S.to_string("HADM_ID").alias("HADM_ID"))


# ------------------------------------------------------------------ the modelling table

_BANDS = {"EarlyMorning": 0, "Evening": 1, "Morning": 2, "Noon": 3}


def _band_code_sql(c):
    return "CASE " + _BAND_SQL.format(c=c) + " " + " ".join(
        f"WHEN '{k}' THEN {v}" for k, v in _BANDS.items()) + " END"


_FINAL_SQL = f"""
WITH m AS (
  SELECT c, v FROM (
    SELECT c, v, ROW_NUMBER() OVER (PARTITION BY c ORDER BY n DESC, v ASC) AS rk FROM (
      SELECT 'RELIGION' AS c, RELIGION AS v, COUNT(*) AS n FROM enriched WHERE RELIGION IS NOT NULL GROUP BY 2
      UNION ALL SELECT 'MARITAL_STATUS', MARITAL_STATUS, COUNT(*) FROM enriched WHERE MARITAL_STATUS IS NOT NULL GROUP BY 2
      UNION ALL SELECT 'LAST_CAREUNIT', LAST_CAREUNIT, COUNT(*) FROM enriched WHERE LAST_CAREUNIT IS NOT NULL GROUP BY 2))
  WHERE rk = 1),
f AS (
  SELECT e.*,
         COALESCE(e.RELIGION, (SELECT v FROM m WHERE c = 'RELIGION')) AS RELIGION_F,
         COALESCE(e.MARITAL_STATUS, (SELECT v FROM m WHERE c = 'MARITAL_STATUS')) AS MARITAL_STATUS_F,
         COALESCE(e.LAST_CAREUNIT, (SELECT v FROM m WHERE c = 'LAST_CAREUNIT')) AS LAST_CAREUNIT_F,
         COALESCE(e.LOS, 0.0) AS LOS_F,
         CAST(ABS(ROUND_EVEN((epoch_us(e.ADMITTIME) - epoch_us(e.DOB)) / 86400e6 / 365.0, 0)) AS INTEGER) AS AGE
  FROM enriched e),
codes AS ({_code_matrix_sql(ICD_VOCAB)})
SELECT f.SUBJECT_ID, f.HADM_ID, f.CURR_DISCHTIME, f.NXT_ADMITTIME,
       ROUND(f.DAYS_TO_READMISSION, 6) AS DAYS_TO_READMISSION, f.NO_OF_SURGERIES,
       f.ADMISSION_TYPE, f.ADMITTIME, f.ADMISSION_LOCATION, f.DISCHARGE_LOCATION, f.INSURANCE,
       f.RELIGION_F AS RELIGION, f.MARITAL_STATUS_F AS MARITAL_STATUS, f.ETHNICITY, f.GENDER, f.DOB,
       ROUND(f.DRG_SEVERITY, 6) AS DRG_SEVERITY, ROUND(f.DRG_MORTALITY, 6) AS DRG_MORTALITY,
       f.LAST_CAREUNIT_F AS LAST_CAREUNIT, ROUND(f.LOS_F, 6) AS LOS,
       CASE WHEN f.DAYS_TO_READMISSION <= 30 THEN 1 ELSE 0 END AS READMISSION_30dAYS,
       CASE WHEN f.DAYS_TO_READMISSION <= 60 THEN 1 ELSE 0 END AS READMISSION_60dAYS,
       {_BAND_SQL.format(c='f.CURR_DISCHTIME')} AS DISCH_HOUR_BAND,
       {_BAND_SQL.format(c='f.ADMITTIME')} AS ADMIT_HOUR_BAND,
       {_band_code_sql('f.CURR_DISCHTIME')} AS DISCH_HOUR_CODE,
       {_band_code_sql('f.ADMITTIME')} AS ADMIT_HOUR_CODE,
       f.AGE, ROUND(CASE WHEN f.AGE = 0 THEN -'inf'::DOUBLE ELSE LN(f.AGE) END, 6) AS LOG_AGE,
       CASE WHEN f.LOS_F < 0.6 THEN 0 WHEN f.LOS_F > 0.6 AND f.LOS_F <= 1.3 THEN 1
            WHEN f.LOS_F > 1.3 AND f.LOS_F <= 2.3 THEN 2 ELSE 3 END AS LOS_BIN,
       {", ".join(f'COALESCE(codes."{v}", 0) AS "{v}"' for v in ICD_VOCAB)}
FROM f LEFT JOIN codes ON f.HADM_ID = codes.HADM_ID"""


@query("final_dataset", _FINAL_SQL, "enriched", "diagnoses")
def q_final(spark, d):
    out = C.final_dataset(spark, d)
    return out.withColumns({c: r6(c) for c in ("DAYS_TO_READMISSION", "DRG_SEVERITY", "DRG_MORTALITY",
                                                 "LOS", "LOG_AGE")})
