"""Analytics over fleet histories. Inputs are history frames, outputs are report frames."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from cdcflow.operators.history import current, timeline

# Plausible ranges of a telemetry reading.
VALID_RANGES = {
    "latitude": (-90, 90),
    "longitude": (-180, 180),
    "speed_kmh": (0, 350),
    "fuel_level_pct": (0, 120),
}
SPEEDING_KMH = 120


def rounded(c: Column, places: int) -> Column:
    """Half-up rounding of the decimal value, as SQL engines with exact decimals give it."""
    return F.round(c.cast("decimal(28,10)"), places).cast("double")


def record_counts(tables: Mapping[str, DataFrame]) -> DataFrame:
    counts = [
        df.agg(F.count("*").alias("record_count")).select(F.lit(name).alias("table_name"), "record_count")
        for name, df in tables.items()
    ]
    return reduce(DataFrame.unionByName, counts)


def current_vehicles(vehicles: DataFrame) -> DataFrame:
    return current(vehicles).select("id", "vin", "make", "model", "year", "fuel_type", "status", "_effective_from").orderBy("id")


def status_history(deliveries: DataFrame) -> DataFrame:
    return deliveries.select(
        "id", "status", "_operation", "_effective_from", "_effective_to", "_is_current"
    ).orderBy("id", "_effective_from")


def valid_telemetry(telemetry: DataFrame) -> DataFrame:
    """Extent and averages of the readings inside all ranges."""
    inside = reduce(lambda acc, r: acc & F.col(r[0]).between(*r[1]), VALID_RANGES.items(), F.lit(True))
    return telemetry.filter(inside).agg(
        F.count("*").alias("valid_telemetry"),
        F.avg("speed_kmh").alias("avg_speed"),
        F.avg("fuel_level_pct").alias("avg_fuel"),
        F.min("latitude").alias("min_lat"),
        F.max("latitude").alias("max_lat"),
        F.min("longitude").alias("min_lon"),
        F.max("longitude").alias("max_lon"),
    )


def edge_cases(telemetry: DataFrame) -> DataFrame:
    """Readings outside each range; NULL is not outside."""
    names = {"latitude": "invalid_lat", "longitude": "invalid_lon", "speed_kmh": "invalid_speed",
             "fuel_level_pct": "invalid_fuel"}
    outside = [
        F.count_if((F.col(c) < low) | (F.col(c) > high)).alias(names[c]) for c, (low, high) in VALID_RANGES.items()
    ]
    return telemetry.agg(*outside)


def vehicle_timeline(vehicles: DataFrame, vin: str) -> DataFrame:
    """How one vehicle's status changed, by its business key."""
    columns = ["id", "vin", "status", "_effective_from", "_effective_to", "_is_current", "_operation"]
    return timeline(vehicles, F.col("vin") == vin).select(*columns)


def masked_sample(drivers: DataFrame, rows: int = 10) -> DataFrame:
    return drivers.select("id", "name", "phone", "license_number", "status").orderBy("id").limit(rows)


def coordinate_sample(telemetry: DataFrame, rows: int = 10) -> DataFrame:
    return telemetry.select("id", "vehicle_id", "latitude", "longitude").orderBy("id", "latitude", "longitude").limit(rows)


def vehicle_summary(telemetry: DataFrame) -> DataFrame:
    return (
        telemetry.groupBy("vehicle_id")
        .agg(
            F.count("*").alias("readings"),
            rounded(F.avg("speed_kmh"), 2).alias("avg_speed"),
            rounded(F.max("speed_kmh"), 2).alias("max_speed"),
            rounded(F.avg("fuel_level_pct"), 2).alias("avg_fuel"),
        )
        .orderBy("vehicle_id")
    )


def alert_summary(alerts: DataFrame) -> DataFrame:
    return (
        alerts.groupBy("alert_type", "severity")
        .agg(F.count("*").alias("count"))
        .orderBy(F.desc("count"), "alert_type", "severity")
    )


def delivery_status(deliveries: DataFrame) -> DataFrame:
    return (
        current(deliveries).groupBy("status").agg(F.count("*").alias("count")).orderBy(F.desc("count"), "status")
    )


def delivery_share(deliveries: DataFrame) -> DataFrame:
    """Share of each status. The total is a scalar subquery over the counts: no shuffle of
    all groups to one task."""
    counts = current(deliveries).groupBy("status").agg(F.count("*").alias("count"))
    total = counts.agg(F.sum("count")).scalar()
    share = F.col("count").cast("decimal(20,0)") * 100 / total.cast("decimal(20,0)")
    return counts.withColumn("percentage", rounded(share, 2))


def hourly_ingest(telemetry: DataFrame) -> DataFrame:
    return (
        telemetry.groupBy(F.date_trunc("hour", "_ingested_at").alias("hour"))
        .agg(F.count("*").alias("records_ingested"))
        .orderBy("hour")
    )


def latest_telemetry(telemetry: DataFrame, vehicles: DataFrame) -> DataFrame:
    """Current readings with their current vehicle. Spark broadcasts the vehicles when it
    finds them small enough and splits a hot vehicle otherwise."""
    known = current(vehicles).select(F.col("id").alias("vehicle_id"), "vin", "make", "model")
    return (
        current(telemetry)
        .join(known, "vehicle_id")
        .select(
            "vin", "make", "model", "latitude", "longitude", "speed_kmh", "fuel_level_pct", "engine_temp_c", "engine_status", "_ingested_at"
        )
        .orderBy(F.desc("_ingested_at"))
    )


def fastest(telemetry: DataFrame, rows: int = 20) -> DataFrame:
    """Speeding readings, fastest first, ties by vehicle and place."""
    columns = ["vehicle_id", "speed_kmh", "latitude", "longitude", "_ingested_at"]
    return (
        current(telemetry)
        .filter(F.col("speed_kmh") > SPEEDING_KMH)
        .orderBy(F.desc("speed_kmh"), "vehicle_id", "_ingested_at", "latitude", "longitude")
        .limit(rows)
        .select(*columns)
    )
