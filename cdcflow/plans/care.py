"""Analytics over care histories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from cdcflow.operators.history import current

VITALS = ["heart_rate", "blood_pressure_sys", "blood_pressure_dia", "temperature_c", "spo2_pct"]


# The report's clinical limits, lowest and highest normal reading.
LIMITS: dict[str, tuple[float | None, float | None]] = {
    "spo2_pct": (92, None),
    "heart_rate": (50, 120),
    "temperature_c": (None, 38.5),
    "blood_pressure_sys": (None, 180),
}


def critical() -> Column:
    """Some reading lies outside its limits; a missing one does not."""
    outside = F.lit(False)
    for name, (low, high) in LIMITS.items():
        if low is not None:
            outside = outside | (F.col(name) < low)
        if high is not None:
            outside = outside | (F.col(name) > high)
    return outside


def _current_patients(patients: DataFrame) -> DataFrame:
    return current(patients).select(F.col("id").alias("patient_id"), "mrn", "name")


def roster(patients: DataFrame) -> DataFrame:
    return current(patients).select("id", "mrn", "name", "status", "_effective_from").orderBy("id")


def latest_vitals(vitals: DataFrame, patients: DataFrame) -> DataFrame:
    return (
        current(vitals)
        .join(_current_patients(patients), "patient_id")
        .select("mrn", "name", *VITALS, "_ingested_at")
        .orderBy(F.desc("_ingested_at"))
    )


def critical_vitals(vitals: DataFrame, patients: DataFrame) -> DataFrame:
    return (
        current(vitals)
        .filter(critical())
        .join(_current_patients(patients), "patient_id")
        .select("mrn", "name", "heart_rate", "blood_pressure_sys", "temperature_c", "spo2_pct")
    )


def patient_trend(vitals: DataFrame, patients: DataFrame, mrn: str) -> DataFrame:
    """All readings of one patient in order of arrival."""
    return (
        vitals.join(_current_patients(patients).filter(F.col("mrn") == mrn), "patient_id")
        .select(*VITALS, "_ingested_at")
        .orderBy("_ingested_at")
    )


def status_timeline(patients: DataFrame, mrn: str) -> DataFrame:
    return (
        patients.filter(F.col("mrn") == mrn)
        .select("id", "mrn", "name", "status", "_effective_from", "_effective_to", "_is_current", "_operation")
        .orderBy("_effective_from")
    )


def missing_counts(patients: DataFrame) -> DataFrame:
    return current(patients).agg(
        F.count("*").alias("total_patients"),
        F.count_if(F.col("mrn").isNull()).alias("missing_mrn"),
        F.count_if(F.col("name").isNull()).alias("missing_name"),
    )


def hourly_vitals(vitals: DataFrame, hours: int = 24) -> DataFrame:
    """Volume and averages of the latest hours with readings."""
    return (
        current(vitals)
        .groupBy(F.date_trunc("hour", "_ingested_at").alias("hour"))
        .agg(
            F.count("*").alias("vital_readings"),
            F.avg("heart_rate").alias("avg_hr"),
            F.avg("temperature_c").alias("avg_temp"),
        )
        .orderBy(F.desc("hour"))
        .limit(hours)
    )
