"""The daily table: one row per (hospital, day)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import types as T

_INT, _DOUBLE, _STRING = T.IntegerType(), T.DoubleType(), T.StringType()

DAILY_TYPES: dict[str, T.DataType] = {
    "hospital_id": _STRING, "date": T.DateType(), "dow": _INT, "month": _INT,
    "day_of_week": _STRING, "season": _STRING, "temperature_c": _DOUBLE,
    "heatwave_event": _INT, "epidemic_level": _INT, "strike_level": _INT, "accident_event": _INT,
    "total_admissions": _INT, "emergency_admissions": _INT, "pediatric_admissions": _INT,
    "icu_admissions": _INT, "available_beds": _INT, "available_staff": _INT,
    "medical_stock_level_pct": _DOUBLE, "waiting_time_avg_min": _INT,
    "naive_pred_total_admissions": _INT, "scheduled_surgeries": _INT,
    "avg_patient_severity": _DOUBLE, "staff_absence_rate": _DOUBLE, "bed_occupancy_rate": _DOUBLE,
    "ambulance_arrivals": _INT, "external_alert_level": _INT, "supply_delivery_day": _INT,
    "it_system_outage": _INT, "estimated_cost_per_day": _INT, "patient_satisfaction_score": _DOUBLE,
}

DAILY_SCHEMA = T.StructType([T.StructField(n, t) for n, t in DAILY_TYPES.items()])

CATEGORY_COLUMNS = ["day_of_week", "season"]
EVENT_FLAG_COLUMNS = ["heatwave_event", "accident_event", "supply_delivery_day", "it_system_outage"]

# Columns a daily table must have, and those that may not be negative.
REQUIRED_COLUMNS = [c for c in DAILY_TYPES if c not in ("hospital_id", "naive_pred_total_admissions")]
COUNT_COLUMNS = [
    "total_admissions", "emergency_admissions", "pediatric_admissions", "icu_admissions",
    "available_beds", "available_staff", "waiting_time_avg_min", "scheduled_surgeries",
    "ambulance_arrivals", "estimated_cost_per_day",
]


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]


def string_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
