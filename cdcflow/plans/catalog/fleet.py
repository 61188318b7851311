"""Fleet reports over histories derived from the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from cdcflow.operators import history as H
from cdcflow.operators.transforms import apply_transforms
from cdcflow.plans import fleet
from cdcflow.plans.catalog.base import BUILT_FROM, CTES, Tables, history_sql, moment, query
from cdcflow.plans.catalog.versions import order_history
from cdcflow.plans.fleet import rounded
from cdcflow.spec import Transform

# --- vehicles from suppliers ----------------------------------------------------------

CTES["vehicle_changes"] = """
    WITH v AS (SELECT s_suppkey AS id, s_name AS vin, 'make-' || s_nationkey AS make, 'model-' || s_suppkey % 5 AS model,
                      CAST(2000 + s_suppkey % 25 AS INTEGER) AS year,
                      CASE WHEN s_suppkey % 3 = 0 THEN 'electric' ELSE 'diesel' END AS fuel_type, s_acctbal FROM supplier),
    c (status, _operation, change_ts, above, below) AS (VALUES
        ('active', 'INSERT', TIMESTAMP '2023-01-01', NULL, NULL), ('maintenance', 'UPDATE', TIMESTAMP '2023-06-01', NULL, 2000),
        ('active', 'DELETE', TIMESTAMP '2023-09-01', 9000, NULL))
    SELECT v.* EXCLUDE (s_acctbal), status, _operation, change_ts FROM v JOIN c
    ON coalesce(s_acctbal > above, TRUE) AND coalesce(s_acctbal < below, TRUE)"""
CTES["vehicles"] = history_sql("vehicle_changes", "id", "change_ts")
CTES["driver_changes"] = """
    SELECT c_custkey AS id, c_name AS name, '555-' || lpad(CAST(c_custkey AS VARCHAR), 7, '0') AS phone,
           'LIC' || c_nationkey || '-' || c_custkey AS license_number, c_mktsegment AS status,
           'INSERT' AS _operation, TIMESTAMP '2023-01-01' AS change_ts FROM customer
    UNION ALL
    SELECT c_custkey, c_name, '555-' || lpad(CAST(c_custkey AS VARCHAR), 7, '0'),
           'LIC' || c_nationkey || '-' || c_custkey, 'suspended', 'UPDATE', TIMESTAMP '2023-03-01'
    FROM customer WHERE c_acctbal < 0"""
CTES["drivers"] = f"""
    SELECT * REPLACE (substr(phone, 1, 4) || '****' AS phone, substr(license_number, 1, 4) || '****' AS license_number)
    FROM ({history_sql("driver_changes", "id", "change_ts")})"""
CTES["telemetry_changes"] = """
    SELECT l_orderkey * 10 + l_linenumber AS id, l_suppkey AS vehicle_id, l_extendedprice / 500 - 100 AS latitude,
           l_extendedprice / 250 - 200 AS longitude, l_quantity * 8 AS speed_kmh, l_discount * 1300 AS fuel_level_pct,
           60 + l_tax * 500 AS engine_temp_c, CASE l_returnflag WHEN 'R' THEN 'off' ELSE 'running' END AS engine_status, l_partkey,
           CASE l_linestatus WHEN 'F' THEN 'INSERT' ELSE 'UPDATE' END AS _operation, l_shipdate AS change_ts
    FROM lineitem"""
TELEMETRY_ORDER = ["change_ts", "l_partkey", "vehicle_id", "latitude", "engine_status"]
CTES["vehicle_telemetry"] = history_sql("telemetry_changes", "id", ", ".join(TELEMETRY_ORDER))
CTES["deliveries"] = """
    SELECT o_orderkey AS id, CASE o_orderstatus WHEN 'O' THEN 'ASSIGNED' WHEN 'P' THEN 'IN_TRANSIT'
           ELSE 'DELIVERED' END AS status, _operation, _effective_from, _effective_to, _is_current, _ingested_at
    FROM order_history"""
CTES["alert_changes"] = """
    SELECT user_id AS id, CASE event_type WHEN 'click' THEN 'speeding' WHEN 'view' THEN 'low_fuel'
                          WHEN 'signup' THEN 'harsh_braking' ELSE 'engine_overheat' END AS alert_type,
           CASE WHEN value > 100 THEN 'critical' WHEN value > 30 THEN 'warning' ELSE 'info' END AS severity,
           event_id, 'INSERT' AS _operation, ts AS change_ts
    FROM events"""
CTES["alerts"] = history_sql("alert_changes", "id, alert_type", "change_ts, event_id")
BUILT_FROM |= {
    "vehicles": ("vehicle_changes",),
    "drivers": ("driver_changes",),
    "vehicle_telemetry": ("telemetry_changes",),
    "deliveries": ("order_history",),
    "alerts": ("alert_changes",),
}


def vehicles(t: Tables) -> DataFrame:
    rows = t.supplier.select(
        F.col("s_suppkey").alias("id"),
        F.col("s_name").alias("vin"),
        F.concat(F.lit("make-"), F.col("s_nationkey")).alias("make"),
        F.concat(F.lit("model-"), F.col("s_suppkey") % 5).alias("model"),
        (2000 + F.col("s_suppkey") % 25).cast("int").alias("year"),
        F.when(F.col("s_suppkey") % 3 == 0, "electric").otherwise("diesel").alias("fuel_type"),
        "s_acctbal",
    )
    balance = F.col("s_acctbal")
    steps = lifecycle(
        ("INSERT", "2023-01-01", "active", F.lit(True)),
        ("UPDATE", "2023-06-01", "maintenance", balance < 2000),
        ("DELETE", "2023-09-01", "active", balance > 9000),
    )
    changes = rows.select("id", "vin", "make", "model", "year", "fuel_type", steps).filter(F.col("_operation").isNotNull())
    return H.from_changelog(changes, ["id"], ["change_ts"])


def lifecycle(*steps):
    """One change per step whose condition holds, and an empty one per step where it does not."""
    changes = [
        F.when(
            condition,
            F.struct(
                (F.lit(status) if isinstance(status, str) else status).alias("status"),
                F.lit(operation).alias("_operation"),
                moment(at).alias("change_ts"),
            ),
        )
        for operation, at, status, condition in steps
    ]
    return F.inline(F.array(*changes))


def drivers(t: Tables) -> DataFrame:
    rows = t.customer.select(
        F.col("c_custkey").alias("id"),
        F.col("c_name").alias("name"),
        F.concat(F.lit("555-"), F.lpad(F.col("c_custkey").cast("string"), 7, "0")).alias("phone"),
        F.concat(F.lit("LIC"), "c_nationkey", F.lit("-"), "c_custkey").alias("license_number"),
        "c_mktsegment",
        "c_acctbal",
    )
    steps = lifecycle(
        ("INSERT", "2023-01-01", F.col("c_mktsegment"), F.lit(True)),
        ("UPDATE", "2023-03-01", "suspended", F.col("c_acctbal") < 0),
    )
    changes = rows.select("id", "name", "phone", "license_number", steps).filter(F.col("_operation").isNotNull())
    masked = apply_transforms(changes, [Transform("mask_pii", "phone"), Transform("mask_pii", "license_number")])
    return H.from_changelog(masked, ["id"], ["change_ts"])


def telemetry(t: Tables) -> DataFrame:
    changes = t.lineitem.select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"),
        F.col("l_suppkey").alias("vehicle_id"),
        (F.col("l_extendedprice") / 500 - 100).alias("latitude"),
        (F.col("l_extendedprice") / 250 - 200).alias("longitude"),
        (F.col("l_quantity") * 8).alias("speed_kmh"),
        (F.col("l_discount") * 1300).alias("fuel_level_pct"),
        (60 + F.col("l_tax") * 500).alias("engine_temp_c"),
        F.when(F.col("l_returnflag") == "R", "off").otherwise("running").alias("engine_status"),
        "l_partkey",
        F.when(F.col("l_linestatus") == "F", "INSERT").otherwise("UPDATE").alias("_operation"),
        F.col("l_shipdate").alias("change_ts"),
    )
    return H.from_changelog(changes, ["id"], TELEMETRY_ORDER)


def deliveries(t: Tables) -> DataFrame:
    status = F.when(F.col("o_orderstatus") == "O", "ASSIGNED").when(F.col("o_orderstatus") == "P", "IN_TRANSIT")
    return order_history(t).select(
        F.col("o_orderkey").alias("id"), status.otherwise("DELIVERED").alias("status"), "_operation", *H.VERSION_COLUMNS
    )


def alerts(t: Tables) -> DataFrame:
    """One alert per user and kind, raised again by each event."""
    kind = (
        F.when(F.col("event_type") == "click", "speeding")
        .when(F.col("event_type") == "view", "low_fuel")
        .when(F.col("event_type") == "signup", "harsh_braking")
        .otherwise("engine_overheat")
    )
    severity = F.when(F.col("value") > 100, "critical").when(F.col("value") > 30, "warning").otherwise("info")
    changes = t.events.select(
        F.col("user_id").alias("id"),
        kind.alias("alert_type"),
        severity.alias("severity"),
        "event_id",
        F.lit("INSERT").alias("_operation"),
        F.col("ts").alias("change_ts"),
    )
    return H.from_changelog(changes, ["id", "alert_type"], ["change_ts", "event_id"])


def round_all(df: DataFrame, *columns: str, places: int = 6) -> DataFrame:
    """Averages of doubles differ in their last bits with the order of addition."""
    return df.withColumns({c: rounded(F.col(c), places) for c in columns})


def round_sql(expression: str, places: int = 2) -> str:
    return f"CAST(round(CAST({expression} AS DECIMAL(28, 10)), {places}) AS DOUBLE)"


FLEET = ("vehicles", "drivers", "vehicle_telemetry", "deliveries", "alerts")
ALL_TABLES = lambda t: {
    "vehicles": vehicles(t),
    "drivers": drivers(t),
    "vehicle_telemetry": telemetry(t),
    "deliveries": deliveries(t),
    "alerts": alerts(t),
}


@query(
    "fleet_record_counts",
    " UNION ALL ".join(f"SELECT '{n}' AS table_name, count(*) AS record_count FROM {n}" for n in FLEET),
    FLEET,
)
def fleet_record_counts(t: Tables) -> DataFrame:
    return fleet.record_counts(ALL_TABLES(t))


@query(
    "fleet_current_vs_history",
    " UNION ALL ".join(
        f"""SELECT '{n}' AS table_name, count(*) FILTER (_is_current) AS current_records,
                   count(*) FILTER (NOT _is_current) AS historical_records FROM {n}"""
        for n in ("vehicles", "drivers", "deliveries")
    ),
    ("vehicles", "drivers", "deliveries"),
)
def fleet_current_vs_history(t: Tables) -> DataFrame:
    return H.counts_by_state({"vehicles": vehicles(t), "drivers": drivers(t), "deliveries": deliveries(t)})


@query(
    "fleet_current_vehicles",
    "SELECT id, vin, make, model, year, fuel_type, status, _effective_from FROM vehicles WHERE _is_current ORDER BY id",
    ("vehicles",),
)
def fleet_current_vehicles(t: Tables) -> DataFrame:
    return fleet.current_vehicles(vehicles(t))


@query(
    "fleet_vehicle_timeline",
    """SELECT s_suppkey AS id, s_name AS vin, h.status, h._effective_from, h._effective_to, h._is_current, h._operation
       FROM supplier JOIN vehicles h ON s_suppkey = h.id WHERE s_suppkey = 1""",
    ("vehicles",),
)
def fleet_vehicle_timeline(t: Tables) -> DataFrame:
    """One vehicle's changes of status, found by its business key."""
    return fleet.vehicle_timeline(vehicles(t), "Supplier#000000001")


@query(
    "fleet_delivery_history",
    "SELECT id, status, _operation, _effective_from, _effective_to, _is_current FROM deliveries",
    ("deliveries",),
)
def fleet_delivery_history(t: Tables) -> DataFrame:
    return fleet.status_history(deliveries(t))


@query(
    "fleet_valid_telemetry",
    f"""
    WITH sound AS (
        SELECT latitude, longitude, speed_kmh, fuel_level_pct FROM vehicle_telemetry
        WHERE abs(latitude) <= 90 AND abs(longitude) <= 180
          AND abs(speed_kmh - 175) <= 175 AND abs(fuel_level_pct - 60) <= 60)
    SELECT count(*) AS valid_telemetry, {round_sql("sum(speed_kmh) / count(*)", 6)} AS avg_speed,
           {round_sql("sum(fuel_level_pct) / count(*)", 6)} AS avg_fuel,
           min(latitude) AS min_lat, max(latitude) AS max_lat, min(longitude) AS min_lon, max(longitude) AS max_lon
    FROM sound""",
    ("vehicle_telemetry",),
)
def fleet_valid_telemetry(t: Tables) -> DataFrame:
    return round_all(fleet.valid_telemetry(telemetry(t)), "avg_speed", "avg_fuel")


@query(
    "fleet_dq_edge_cases",
    """
    SELECT count(*) FILTER (latitude < -90 OR latitude > 90) AS invalid_lat,
           count(*) FILTER (longitude < -180 OR longitude > 180) AS invalid_lon,
           count(*) FILTER (speed_kmh < 0 OR speed_kmh > 350) AS invalid_speed,
           count(*) FILTER (fuel_level_pct < 0 OR fuel_level_pct > 120) AS invalid_fuel
    FROM vehicle_telemetry""",
    ("vehicle_telemetry",),
)
def fleet_dq_edge_cases(t: Tables) -> DataFrame:
    return fleet.edge_cases(telemetry(t))


@query(
    "fleet_masked_sample",
    "SELECT id, name, phone, license_number, status FROM drivers WHERE _is_current ORDER BY id LIMIT 10",
    ("drivers",),
)
def fleet_masked_sample(t: Tables) -> DataFrame:
    return fleet.masked_sample(H.current(drivers(t)))


@query(
    "fleet_coordinate_sample",
    f"""SELECT id, vehicle_id, {round_sql("latitude", 5)} AS latitude, {round_sql("longitude", 5)} AS longitude
        FROM vehicle_telemetry ORDER BY id, latitude, longitude LIMIT 10""",
    ("vehicle_telemetry",),
)
def fleet_coordinate_sample(t: Tables) -> DataFrame:
    places = [Transform("round", c, {"decimals": 5}) for c in ("latitude", "longitude")]
    return fleet.coordinate_sample(apply_transforms(telemetry(t), places))


@query(
    "fleet_vehicle_summary",
    f"""
    SELECT vehicle_id, count(*) AS readings, {round_sql("avg(speed_kmh)")} AS avg_speed,
           {round_sql("max(speed_kmh)")} AS max_speed, {round_sql("avg(fuel_level_pct)")} AS avg_fuel
    FROM vehicle_telemetry GROUP BY vehicle_id""",
    ("vehicle_telemetry",),
)
def fleet_vehicle_summary(t: Tables) -> DataFrame:
    return fleet.vehicle_summary(telemetry(t))


@query(
    "fleet_alert_summary",
    "SELECT alert_type, severity, count(*) AS count FROM alerts GROUP BY ALL",
    ("alerts",),
)
def fleet_alert_summary(t: Tables) -> DataFrame:
    return fleet.alert_summary(alerts(t))


@query(
    "fleet_current_alerts",
    "SELECT alert_type, severity, count(*) AS count FROM alerts WHERE _is_current GROUP BY ALL",
    ("alerts",),
)
def fleet_current_alerts(t: Tables) -> DataFrame:
    return fleet.alert_summary(H.current(alerts(t)))


@query(
    "fleet_delivery_status",
    "SELECT status, count(*) AS count FROM deliveries WHERE _is_current GROUP BY status",
    ("deliveries",),
)
def fleet_delivery_status(t: Tables) -> DataFrame:
    return fleet.delivery_status(deliveries(t))


@query(
    "fleet_delivery_share",
    f"""SELECT status, count(*) AS count, {round_sql("count(*) * 100.0 / sum(count(*)) OVER ()")} AS percentage
        FROM deliveries WHERE _is_current GROUP BY status""",
    ("deliveries",),
)
def fleet_delivery_share(t: Tables) -> DataFrame:
    return fleet.delivery_share(deliveries(t))


@query(
    "fleet_hourly_ingest",
    """SELECT date_trunc('hour', _ingested_at) AS hour, count(*) AS records_ingested
       FROM vehicle_telemetry GROUP BY 1""",
    ("vehicle_telemetry",),
)
def fleet_hourly_ingest(t: Tables) -> DataFrame:
    return fleet.hourly_ingest(telemetry(t))


@query(
    "fleet_operation_breakdown",
    "SELECT _operation, count(*) AS count FROM vehicle_telemetry GROUP BY 1",
    ("vehicle_telemetry",),
)
def fleet_operation_breakdown(t: Tables) -> DataFrame:
    return H.operation_counts(telemetry(t))


@query(
    "fleet_latest_telemetry",
    """
    WITH fleet AS (SELECT id AS vehicle_id, vin, make, model FROM vehicles WHERE _is_current),
    newest AS (SELECT * EXCLUDE (id, _operation, _is_current) FROM vehicle_telemetry WHERE _is_current)
    SELECT vin, make, model, latitude, longitude, speed_kmh, fuel_level_pct, engine_temp_c, engine_status, _ingested_at
    FROM newest JOIN fleet USING (vehicle_id)""",
    ("vehicle_telemetry", "vehicles"),
)
def fleet_latest_telemetry(t: Tables) -> DataFrame:
    return fleet.latest_telemetry(telemetry(t), vehicles(t))


@query(
    "fleet_speed_top20",
    """
    SELECT vehicle_id, speed_kmh, latitude, longitude, _ingested_at FROM vehicle_telemetry
    WHERE _is_current AND speed_kmh > 120
    ORDER BY speed_kmh DESC, vehicle_id, _ingested_at, latitude, longitude LIMIT 20""",
    ("vehicle_telemetry",),
)
def fleet_speed_top20(t: Tables) -> DataFrame:
    return fleet.fastest(telemetry(t))
