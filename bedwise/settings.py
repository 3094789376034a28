"""Settings that travel into plans as literals."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class CsvFormat:
    separator: str = ";"
    encoding: str = "UTF-8"
    date_column: str = "date"
    date_pattern: str = "dd/MM/yyyy"


@dataclass(frozen=True)
class ModelSettings:
    target: str = "total_admissions"
    test_size: float = 0.2
    seed: int = 42
    trees: int = 300
    depth: int = 20
    min_leaf: int = 2


@dataclass(frozen=True)
class Capacity:
    """Site capacity. Every threshold of the scenario and action rules is here."""

    total_beds: int = 1450
    total_staff: int = 425
    normal_admissions: int = 450
    critical_occupancy: float = 0.85
    warning_occupancy: float = 0.75
    min_stock_pct: float = 50.0
    base_stock_pct: float = 75.0
    patients_per_staff: int = 3


CSV = CsvFormat()
MODEL = ModelSettings()
CAPACITY = Capacity()

# --- fixed values ---------------------------------------------------------
# They must equal the published ones for results to agree.

FEATURE_COLUMNS = [
    "hospital_id", "epidemic_level", "temperature_c", "heatwave_event", "strike_level",
    "staff_absence_rate", "available_staff", "available_beds", "scheduled_surgeries",
    "medical_stock_level_pct", "accident_event", "external_alert_level",
    "month", "dow", "is_weekend", "season", "day_of_week",
]

# Feature sets of the model comparison; the first set is "every column".
STRONG_FEATURES = [
    "emergency_admissions", "estimated_cost_per_day", "pediatric_admissions", "icu_admissions",
    "ambulance_arrivals", "staff_absence_rate", "naive_pred_total_admissions",
    "avg_patient_severity", "epidemic_level", "waiting_time_avg_min", "external_alert_level",
    "available_beds", "patient_satisfaction_score",
]
REALISTIC_FEATURES = [c for c in FEATURE_COLUMNS if c != "hospital_id"]

DAY_NAMES = ["Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday"]

# Month (January first) -> expected temperature and scheduled surgeries.
MONTH_TEMPERATURE = [4, 5, 9, 13, 17, 21, 24, 23, 19, 13, 8, 5]
MONTH_SURGERIES = [42, 44, 45, 43, 40, 35, 30, 28, 38, 42, 44, 40]
WEEKEND_SURGERIES = 20

# Drivers of a forecast day unless overridden.
FORECAST_DRIVERS = {
    "epidemic_level": 0, "heatwave_event": 0, "strike_level": 0,
    "staff_absence_rate": 0.06, "available_staff": 420, "available_beds": 1420,
    "medical_stock_level_pct": 72.0, "accident_event": 0, "external_alert_level": 0,
}
DEFAULT_SITE = "PITIE"

# Demand factors: weekday (Monday first) and month (January first).
WEEKDAY_FACTORS = [1.12, 1.08, 1.04, 1.00, 0.96, 0.88, 0.92]
MONTH_FACTORS = [1.12, 1.08, 1.04, 0.96, 0.92, 0.88, 0.88, 0.92, 1.00, 1.04, 1.08, 1.12]
ANNUAL_GROWTH = 0.008

# Calibration means used where a calibration table lacks the column.
CALIBRATION_MEANS = {
    "total_admissions": 400.0, "emergency_admissions": 155.0, "pediatric_admissions": 32.0,
    "icu_admissions": 20.0, "scheduled_surgeries": 42.0, "available_beds": 1450.0,
    "available_staff": 425.0, "waiting_time_avg_min": 47.0, "estimated_cost_per_day": 60000.0,
}

HOSPITALS = [
    ("PITIE", "Pitié-Salpêtrière", "donnees_hopital_reference.csv"),
    ("HEGP", "Hôpital Européen Georges Pompidou", "donnees_hopital_reference_01_HEGP.csv"),
    ("STLOUIS", "Hôpital Saint-Louis", "donnees_hopital_reference_02_STLOUIS.csv"),
    ("BICHAT", "Hôpital Bichat", "donnees_hopital_reference_03_BICHAT.csv"),
    ("COCHIN", "Hôpital Cochin", "donnees_hopital_reference_04_COCHIN.csv"),
    ("NECKER", "Hôpital Necker", "donnees_hopital_reference_05_NECKER.csv"),
    ("LARIBO", "Hôpital Lariboisière", "donnees_hopital_reference_06_LARIBO.csv"),
    ("BEAUJON", "Hôpital Beaujon", "donnees_hopital_reference_07_BEAUJON.csv"),
    ("CHUBDX", "CHU de Bordeaux", "donnees_hopital_reference_08_CHUBDX.csv"),
    ("CHULYON", "CHU de Lyon", "donnees_hopital_reference_09_CHULYON.csv"),
    ("CHULILLE", "CHU de Lille", "donnees_hopital_reference_10_CHULILLE.csv"),
]
