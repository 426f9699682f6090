"""Explicit schemas of every table the engine reads or writes."""


TELEMETRY_DDL = (
    "component_id STRING, lot_id STRING, parameter_name STRING, elapsed_hours INT, value DOUBLE, "
    "unit STRING, temperature_C DOUBLE, test_condition STRING, instrument_id STRING, channel_id STRING, "
    "measurement_quality STRING, rework_count INT, absolute_limit_low DOUBLE, absolute_limit_high DOUBLE, "
    "source_type STRING"
)
TELEMETRY_COLUMNS = [c.strip().split(" ")[0] for c in TELEMETRY_DDL.split(",")]
KEY = ["component_id", "parameter_name", "elapsed_hours"]
REQUIRED = ["component_id", "lot_id", "parameter_name", "elapsed_hours", "value", "unit"]

# Enumerations of the telemetry contract.
QUALITIES = ["VALID", "DEGRADED", "SUSPECT", "MISSING"]
SOURCES = ["synthetic", "real", "assumption"]
