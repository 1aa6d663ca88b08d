"""DuckDB SQL texts: the FIXTURES.md bindings as CTEs and a composer.

The oracle is independent SQL over the same parquet tables; it is what the
Spark operators are checked against (scripts/check_oracle.py, and the driver).
"""

from __future__ import annotations

BINDING_SQL = {
    "admissions": """
SELECT o_custkey AS SUBJECT_ID, o_orderkey AS HADM_ID,
       o_orderdate + INTERVAL '1' HOUR * CAST(o_orderkey * 7 % 24 AS INT) AS ADMITTIME,
       o_orderdate + INTERVAL '1' HOUR * CAST(o_orderkey * 7 % 24 + 12 + o_orderkey * 31 % 500 AS INT) AS DISCHTIME,
       o_orderpriority AS ADMISSION_TYPE,
       CONCAT('LOC', CAST(o_orderkey % 6 AS VARCHAR)) AS ADMISSION_LOCATION,
       CONCAT('DIS', CAST(o_orderkey % 9 AS VARCHAR)) AS DISCHARGE_LOCATION,
       o_orderstatus AS INSURANCE,
       CASE WHEN o_orderkey % 17 = 0 THEN NULL ELSE CONCAT('REL', CAST(o_custkey % 5 AS VARCHAR)) END AS RELIGION,
       CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE CONCAT('MAR', CAST(o_custkey % 4 AS VARCHAR)) END AS MARITAL_STATUS,
       CONCAT('ETH', CAST(o_custkey % 8 AS VARCHAR)) AS ETHNICITY
FROM orders""",
    "services": """
SELECT l_orderkey AS HADM_ID,
       CASE WHEN l_returnflag = 'R' AND l_linestatus = 'F' THEN 'CSURG'
            WHEN l_returnflag = 'A' AND l_linestatus = 'F' THEN 'CMED' ELSE 'MED' END AS CURR_SERVICE
FROM lineitem""",
    "diagnoses": """
SELECT l_orderkey AS HADM_ID, CASE WHEN l_partkey % 41 = 0 THEN NULL ELSE p_brand END AS ICD9_CODE
FROM lineitem JOIN part ON l_partkey = p_partkey""",
    "diagnosis_names": """
SELECT p_brand AS ICD9_CODE, MIN(p_name) AS SHORT_TITLE FROM part GROUP BY p_brand""",
    "icu_stays": """
SELECT l_orderkey AS HADM_ID, o_custkey AS SUBJECT_ID, l_orderkey * 10 + l_linenumber AS ICUSTAY_ID,
       CASE WHEN (l_orderkey + l_linenumber) % 13 = 0 THEN NULL ELSE MAX(CONCAT('U', l_linestatus, l_returnflag)) END AS LAST_CAREUNIT,
       CASE WHEN (l_orderkey + l_linenumber) % 19 = 0 THEN NULL ELSE SUM(l_quantity) / 20 END AS LOS
FROM lineitem JOIN orders ON l_orderkey = o_orderkey
GROUP BY l_orderkey, o_custkey, l_linenumber""",
    "patients": """
SELECT c_custkey AS SUBJECT_ID, CASE WHEN c_custkey % 2 = 0 THEN 'F' ELSE 'M' END AS GENDER,
       CASE WHEN c_custkey % 89 = 0 THEN TIMESTAMP '1680-01-01 00:00:00' ELSE TIMESTAMP '1915-01-01 00:00:00' END
         + INTERVAL '1' DAY * CAST(c_custkey * 37 % 25000 AS INT) AS DOB
FROM customer""",
    "drg_codes": """
SELECT l_orderkey AS HADM_ID,
       CASE WHEN l_quantity % 7 = 0 THEN NULL ELSE l_quantity % 5 END AS DRG_SEVERITY,
       CASE WHEN l_quantity % 7 = 0 THEN NULL ELSE CAST(l_linenumber % 5 AS DOUBLE) END AS DRG_MORTALITY
FROM lineitem""",
    "lab_events": """
SELECT event_type AS FLAG, value AS VALUE FROM events""",
}


def with_bindings(body: str, *names: str) -> str:
    """Prefix ``body`` with the binding CTEs it names (in the order given)."""
    if not names:
        return body.strip()
    ctes = ",\n".join(f"{n} AS ({BINDING_SQL[n].strip()})" for n in names)
    body = body.strip()
    if body.upper().startswith("WITH "):
        return f"WITH {ctes},\n{body[5:]}"
    return f"WITH {ctes}\n{body}"


# Derived relations of the cohort pipeline, written independently in SQL.
# name -> (body, dependencies)
DERIVED_SQL = {
    "gaps": ("""
SELECT SUBJECT_ID, HADM_ID, CURR_DISCHTIME, NXT_ADMITTIME, DAYS_TO_READMISSION FROM (
  SELECT SUBJECT_ID, HADM_ID, DISCHTIME AS CURR_DISCHTIME,
         LEAD(ADMITTIME) OVER w AS NXT_ADMITTIME,
         (epoch_us(LEAD(ADMITTIME) OVER w) - epoch_us(DISCHTIME)) / 86400e6 AS DAYS_TO_READMISSION,
         LEAD(HADM_ID) OVER w AS nxt_id
  FROM admissions
  WINDOW w AS (PARTITION BY SUBJECT_ID ORDER BY ADMITTIME ASC NULLS LAST, HADM_ID ASC NULLS LAST))
WHERE nxt_id IS NOT NULL
  AND HADM_ID IN (SELECT HADM_ID FROM services WHERE CURR_SERVICE IN ('CMED', 'CSURG'))""",
             ("admissions", "services")),
    "surgeries": ("""
SELECT COUNT(1) AS NO_OF_SURGERIES, CURR_SERVICE, HADM_ID FROM services
WHERE CURR_SERVICE IN ('CSURG') GROUP BY CURR_SERVICE, HADM_ID""", ("services",)),
    "drg_means": ("""
SELECT HADM_ID, COALESCE(AVG(DRG_SEVERITY), 0) AS DRG_SEVERITY,
       COALESCE(AVG(DRG_MORTALITY), 0) AS DRG_MORTALITY
FROM drg_codes GROUP BY HADM_ID""", ("drg_codes",)),
    "latest_icu": ("""
SELECT i.HADM_ID, i.SUBJECT_ID, i.LAST_CAREUNIT, i.ICUSTAY_ID, t.LOS
FROM icu_stays i JOIN (
  SELECT HADM_ID, MAX(ICUSTAY_ID) AS ICUSTAY_ID,
         COALESCE(CAST(SUM(CAST(LOS AS DECIMAL(38, 10))) AS DOUBLE), 0.0) AS LOS
  FROM icu_stays GROUP BY HADM_ID) t
ON i.HADM_ID = t.HADM_ID AND i.ICUSTAY_ID = t.ICUSTAY_ID""", ("icu_stays",)),
    "enriched": ("""
SELECT g.SUBJECT_ID, g.HADM_ID, g.CURR_DISCHTIME, g.NXT_ADMITTIME, g.DAYS_TO_READMISSION,
       CAST(COALESCE(s.NO_OF_SURGERIES, 0) AS BIGINT) AS NO_OF_SURGERIES,
       a.ADMISSION_TYPE, a.ADMITTIME, a.ADMISSION_LOCATION, a.DISCHARGE_LOCATION, a.INSURANCE,
       a.RELIGION, a.MARITAL_STATUS, a.ETHNICITY,
       p.GENDER, p.DOB, d.DRG_SEVERITY, d.DRG_MORTALITY, i.LAST_CAREUNIT, i.LOS
FROM gaps g
LEFT JOIN surgeries s ON g.HADM_ID = s.HADM_ID
LEFT JOIN admissions a ON g.HADM_ID = a.HADM_ID
LEFT JOIN patients p ON g.SUBJECT_ID = p.SUBJECT_ID
LEFT JOIN drg_means d ON g.HADM_ID = d.HADM_ID
LEFT JOIN latest_icu i ON g.HADM_ID = i.HADM_ID""",
                 ("gaps", "surgeries", "admissions", "patients", "drg_means", "latest_icu")),
}


def compose(body: str, *names: str) -> str:
    """``WITH`` the named bindings / derived relations (and what they depend
    on, dependencies first), then ``body``."""
    order: list[str] = []

    def visit(n: str) -> None:
        if n in order:
            return
        if n in DERIVED_SQL:
            for dep in DERIVED_SQL[n][1]:
                visit(dep)
        order.append(n)

    for n in names:
        visit(n)
    parts = []
    for n in order:
        text = BINDING_SQL[n] if n in BINDING_SQL else DERIVED_SQL[n][0]
        parts.append(f"{n} AS ({text.strip()})")
    body = body.strip()
    if not parts:
        return body
    if body.upper().startswith("WITH "):
        return "WITH " + ",\n".join(parts) + ",\n" + body[5:]
    return "WITH " + ",\n".join(parts) + "\n" + body
