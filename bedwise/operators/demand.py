"""Deterministic demand and operations relations on a daily table.

Each function adds columns by expression. Calibration means come from a reference table as
one scalar row, or from the published defaults.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bedwise.functions.columns import calendar_fields, clip, day_name_of, pick, rounded, season_of, whole
from bedwise.operators.series import centred, years_elapsed
from bedwise.settings import ANNUAL_GROWTH, CALIBRATION_MEANS, MONTH_FACTORS, MONTH_TEMPERATURE, WEEKDAY_FACTORS


class Calibration:
    """Mean per column of a reference table, or the published default."""

    def __init__(self, reference: DataFrame | None = None):
        have = [] if reference is None else [c for c in CALIBRATION_MEANS if c in reference.columns]
        self._means = reference.agg(F.struct(*[F.avg(c).alias(c) for c in have]).alias("m")).scalar() if have else None
        self._have = set(have)

    def mean(self, column: str) -> Column:
        default = F.lit(CALIBRATION_MEANS[column])
        return F.coalesce(self._means[column], default) if column in self._have else default


def calendar_spine(sites: DataFrame, start: date, end: date) -> DataFrame:
    """Every day from ``start`` to ``end`` for every row of ``sites``."""
    return sites.withColumn("date", F.explode(F.sequence(F.lit(start), F.lit(end))))


def with_calendar(df: DataFrame) -> DataFrame:
    """Weekday, month, day name and season of the date."""
    fields = calendar_fields(F.col("date"))
    return df.withColumns({
        "dow": fields["dow"], "month": fields["month"], "day_of_week": day_name_of(fields["dow"]),
        "season": season_of(fields["month"]),
    })


def expected_demand(
    df: DataFrame, calibration: Calibration | None = None, growth: float = ANNUAL_GROWTH, low: float = 250, high: float = 620,
    name: str = "expected_demand",
) -> DataFrame:
    """Base demand times trend, weekday, month and event factors, clipped and truncated."""
    base = (calibration or Calibration()).mean("total_admissions")
    fields = calendar_fields(F.col("date"))
    factor = (
        (1 + F.col("__years") * F.lit(growth))
        * pick(WEEKDAY_FACTORS, fields["dow"] + 1) * pick(MONTH_FACTORS, fields["month"])
        * (1 + F.col("epidemic_level") * F.lit(0.10))
        * (1 + F.col("heatwave_event") * F.lit(0.06))
        * (1 + F.col("accident_event") * F.lit(0.40))
    )
    return years_elapsed(df, name="__years").withColumn(
        name, whole(clip(base * factor, float(low), float(high)))
    ).drop("__years")


def department_split(df: DataFrame, calibration: Calibration | None = None) -> DataFrame:
    """Department counts and surgeries from the total and the calibration means."""
    cal = calibration or Calibration()
    base, total = cal.mean("total_admissions"), F.col("total_admissions")
    df = df.withColumns({
        "emergency_admissions": whole(total * (cal.mean("emergency_admissions") / base)),
        "pediatric_admissions": whole(total * (cal.mean("pediatric_admissions") / base)),
        "icu_admissions": whole(
            total * (cal.mean("icu_admissions") / base) * (1 + F.col("epidemic_level") * F.lit(0.12))),
        "scheduled_surgeries": whole(clip(
            cal.mean("scheduled_surgeries") * (1 - F.col("strike_level") * F.lit(0.25))
            - (F.weekday("date") >= 5).cast("int") * 18, 15.0, 55.0)),
    })
    return df.withColumn("ambulance_arrivals", whole(F.col("emergency_admissions") * F.lit(0.6)))


def external_alert(df: DataFrame, name: str = "external_alert_level") -> DataFrame:
    raw = F.col("epidemic_level") + F.col("accident_event") + F.col("heatwave_event") * 2 - 1
    return df.withColumn(name, clip(raw, 0, 2).cast("int"))


def available_resources(df: DataFrame, calibration: Calibration | None = None) -> DataFrame:
    """Beds and staff left by strikes and epidemics."""
    cal = calibration or Calibration()
    beds, staff = cal.mean("available_beds"), cal.mean("available_staff")
    strike = F.col("strike_level")
    return df.withColumns({
        "available_beds": whole(clip(beds - strike * F.lit(0.10) * beds, 1200.0, 1600.0)),
        "available_staff": whole(clip(
            staff - strike * staff * F.lit(0.15) - F.col("epidemic_level") * 3, 370.0, 460.0)),
    })


def operational_measures(df: DataFrame, calibration: Calibration | None = None) -> DataFrame:
    """Occupancy, absence, waiting time, severity, temperature, cost and satisfaction."""
    cal = calibration or Calibration()
    total, epidemic = F.col("total_admissions"), F.col("epidemic_level")
    df = centred(df, total / F.col("available_staff"), "__load")
    df = df.withColumns({
        "bed_occupancy_rate": rounded(clip(total / F.col("available_beds") * F.lit(0.85), 0.30, 0.72), 3),
        "staff_absence_rate": rounded(clip(
            F.lit(0.07) + epidemic * F.lit(0.012) + F.col("strike_level") * F.lit(0.025), 0.04, 0.14), 2),
        "waiting_time_avg_min": whole(clip(
            cal.mean("waiting_time_avg_min") + F.col("__load") * 25 + epidemic * 8, 15.0, 115.0)),
        "avg_patient_severity": rounded(clip(F.lit(2.3) + epidemic * F.lit(0.20), 2.0, 3.8), 1),
        "temperature_c": rounded(clip(
            pick(MONTH_TEMPERATURE, F.month("date")).cast("double") + F.col("heatwave_event") * 7, -6.0, 38.0), 1),
        "estimated_cost_per_day": whole(
            cal.mean("estimated_cost_per_day") * F.lit(0.7) + total * 35 + F.col("icu_admissions") * 180),
    }).drop("__load")
    return df.withColumn("patient_satisfaction_score", rounded(clip(
        F.lit(7.5) + F.lit(-0.015) * (F.col("waiting_time_avg_min") - 47) + F.lit(-0.08) * epidemic, 5.5, 8.5), 2))
