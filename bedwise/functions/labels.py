"""Display labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from bedwise.functions.columns import lookup, pick

# --- fixed values ---------------------------------------------------------
WEEKDAY_LABELS = ["Lun", "Mar", "Mer", "Jeu", "Ven", "Sam", "Dim"]
MONTH_LABELS = ["Jan", "Fév", "Mar", "Avr", "Mai", "Juin", "Juil", "Août", "Sep", "Oct", "Nov", "Déc"]
SEASON_LABELS = {"winter": "Hiver", "spring": "Printemps", "summer": "Été", "autumn": "Automne"}
VARIABLE_LABELS = {
    "total_admissions": "Admissions", "emergency_admissions": "Urgences",
    "pediatric_admissions": "Pédiatrie", "icu_admissions": "Réanimation",
    "available_beds": "Lits", "available_staff": "Personnel",
    "bed_occupancy_rate": "Occupation", "waiting_time_avg_min": "Attente",
    "epidemic_level": "Épidémie", "temperature_c": "Température",
    "staff_absence_rate": "Absence", "medical_stock_level_pct": "Stock",
}
PRIORITY_LABELS = {"CRITICAL": "CRITIQUE", "HIGH": "HAUTE", "MEDIUM": "MOYENNE", "LOW": "BASSE"}


def weekday_label(dow: Column) -> Column:
    return pick(WEEKDAY_LABELS, dow + 1)


def month_label(month: Column) -> Column:
    return pick(MONTH_LABELS, month)


def season_label(season: Column) -> Column:
    return lookup(season, SEASON_LABELS)


def variable_label(name: Column) -> Column:
    return F.coalesce(lookup(name, VARIABLE_LABELS), name)


def priority_label(level: Column) -> Column:
    return F.coalesce(lookup(level, PRIORITY_LABELS), level)
