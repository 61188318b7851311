"""Care reports over patients (from customers) and vitals (from events)."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from cdcflow.operators import history as H
from cdcflow.operators.transforms import apply_transforms
from cdcflow.plans import care
from cdcflow.plans.catalog.base import BUILT_FROM, CTES, Tables, history_sql, query
from cdcflow.plans.catalog.fleet import lifecycle, round_all, round_sql
from cdcflow.spec import Transform

CTES["patient_changes"] = """
    SELECT c_custkey AS id, 'MRN-' || lpad(CAST(c_custkey AS VARCHAR), 6, '0') AS mrn,
           CASE WHEN c_nationkey <> 3 THEN substr(c_name, 1, 2) || '****' END AS name,
           'active' AS status, 'INSERT' AS _operation, TIMESTAMP '2023-12-01' AS change_ts FROM customer
    UNION ALL SELECT c_custkey, 'MRN-' || lpad(CAST(c_custkey AS VARCHAR), 6, '0'),
           CASE WHEN c_nationkey <> 3 THEN substr(c_name, 1, 2) || '****' END,
           'discharged', 'UPDATE', TIMESTAMP '2024-01-10' FROM customer WHERE c_acctbal < 3000
    UNION ALL SELECT c_custkey, 'MRN-' || lpad(CAST(c_custkey AS VARCHAR), 6, '0'),
           CASE WHEN c_nationkey <> 3 THEN substr(c_name, 1, 2) || '****' END,
           'active', 'DELETE', TIMESTAMP '2024-01-20' FROM customer WHERE c_mktsegment = 'MACHINERY'"""
CTES["patients"] = history_sql("patient_changes", "id", "change_ts")
CTES["vital_changes"] = """
    SELECT user_id AS patient_id, CASE event_type WHEN 'click' THEN 'ward' WHEN 'view' THEN 'home' ELSE 'lab' END AS site,
           CASE WHEN event_type <> 'error' THEN value END AS heart_rate,
           80 + value / 2 AS blood_pressure_sys, 50 + value / 4 AS blood_pressure_dia, 35 + value / 50 AS temperature_c,
           100 - value / 10 AS spo2_pct, event_id, 'INSERT' AS _operation, ts AS change_ts
    FROM events"""
CTES["vitals"] = history_sql("vital_changes", "patient_id, site, event_id", "change_ts")
CTES["known_patients"] = "SELECT id AS patient_id, mrn, name FROM patients WHERE _is_current"
CTES["read_vitals"] = "SELECT * FROM known_patients JOIN vitals USING (patient_id)"
BUILT_FROM |= {
    "patients": ("patient_changes",),
    "vitals": ("vital_changes",),
    "known_patients": ("patients",),
    "read_vitals": ("known_patients", "vitals"),
}
READ = ("read_vitals",)


def outside_sql() -> str:
    """Number of limits that a reading breaks."""
    tests = [f"{c} < {low}" for c, (low, _) in care.LIMITS.items() if low is not None]
    tests += [f"{c} > {high}" for c, (_, high) in care.LIMITS.items() if high is not None]
    return " + ".join(f"coalesce(CAST({t} AS INTEGER), 0)" for t in tests)


def patients(t: Tables) -> DataFrame:
    """Patients of one nation arrive without a name."""
    rows = t.customer.select(
        F.col("c_custkey").alias("id"),
        F.concat(F.lit("MRN-"), F.lpad(F.col("c_custkey").cast("string"), 6, "0")).alias("mrn"),
        F.when(F.col("c_nationkey") != 3, F.col("c_name")).alias("name"),
        "c_acctbal",
        "c_mktsegment",
    )
    steps = lifecycle(
        ("INSERT", "2023-12-01", "active", F.lit(True)),
        ("UPDATE", "2024-01-10", "discharged", F.col("c_acctbal") < 3000),
        ("DELETE", "2024-01-20", "active", F.col("c_mktsegment") == "MACHINERY"),
    )
    changes = rows.select("id", "mrn", "name", steps).filter(F.col("_operation").isNotNull())
    masked = apply_transforms(changes, [Transform("mask_pii", "name", {"visible_chars": 2})])
    return H.from_changelog(masked, ["id"], ["change_ts"])


def vitals(t: Tables) -> DataFrame:
    site = F.when(F.col("event_type") == "click", "ward").when(F.col("event_type") == "view", "home").otherwise("lab")
    changes = t.events.select(
        F.col("user_id").alias("patient_id"),
        site.alias("site"),
        F.when(F.col("event_type") != "error", F.col("value")).alias("heart_rate"),
        (80 + F.col("value") / 2).alias("blood_pressure_sys"),
        (50 + F.col("value") / 4).alias("blood_pressure_dia"),
        (35 + F.col("value") / 50).alias("temperature_c"),
        (100 - F.col("value") / 10).alias("spo2_pct"),
        "event_id",
        F.lit("INSERT").alias("_operation"),
        F.col("ts").alias("change_ts"),
    )
    return H.from_changelog(changes, ["patient_id", "site", "event_id"], ["change_ts"])


@query(
    "care_patient_roster",
    "SELECT id, mrn, name, status, _effective_from FROM patients WHERE _is_current",
    ("patients",),
)
def care_patient_roster(t: Tables) -> DataFrame:
    return care.roster(patients(t))


@query(
    "care_latest_vitals",
    f"SELECT mrn, name, {', '.join(care.VITALS)}, _ingested_at FROM read_vitals WHERE _is_current",
    READ,
)
def care_latest_vitals(t: Tables) -> DataFrame:
    return care.latest_vitals(vitals(t), patients(t))


@query(
    "care_critical_vitals",
    f"""SELECT mrn, name, {', '.join(c for c in care.VITALS if c in care.LIMITS)} FROM read_vitals
        WHERE _is_current AND {outside_sql()} > 0""",
    READ,
)
def care_critical_vitals(t: Tables) -> DataFrame:
    return care.critical_vitals(vitals(t), patients(t))


@query(
    "care_patient_trend",
    f"SELECT {', '.join(care.VITALS)}, _ingested_at FROM read_vitals WHERE patient_id = 8",
    READ,
)
def care_patient_trend(t: Tables) -> DataFrame:
    return care.patient_trend(vitals(t), patients(t), "MRN-000008")


@query(
    "care_status_timeline",
    """SELECT id, mrn, name, status, _effective_from, _effective_to, _is_current, _operation FROM patients
       WHERE mrn = 'MRN-000008'""",
    ("patients",),
)
def care_status_timeline(t: Tables) -> DataFrame:
    return care.status_timeline(patients(t), "MRN-000008")


@query(
    "care_missing_counts",
    """SELECT count(*) AS total_patients, count(*) - count(mrn) AS missing_mrn, count(*) - count(name) AS missing_name
       FROM known_patients""",
    ("known_patients",),
)
def care_missing_counts(t: Tables) -> DataFrame:
    return care.missing_counts(patients(t))


@query(
    "care_hourly_vitals",
    f"""SELECT date_trunc('hour', _ingested_at) AS hour, count(*) AS vital_readings,
               {round_sql("avg(heart_rate)", 6)} AS avg_hr, {round_sql("avg(temperature_c)", 6)} AS avg_temp
        FROM vitals WHERE _is_current GROUP BY 1 ORDER BY hour DESC LIMIT 24""",
    ("vitals",),
)
def care_hourly_vitals(t: Tables) -> DataFrame:
    return round_all(care.hourly_vitals(vitals(t)), "avg_hr", "avg_temp")
