"""What-if projection of a forecast against capacity."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import asdict, dataclass, fields
from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bedwise.functions.columns import rounded, rounded_int
from bedwise.operators.series import day_index
from bedwise.settings import CAPACITY, CSV, Capacity


@dataclass(frozen=True)
class ScenarioParams:
    epidemic_intensity: float = 0.0
    staffing_reduction: float = 0.0
    seasonal_multiplier: float = 1.0
    shock_day_spike: float = 0.0
    shock_day_index: int | None = None
    beds_reduction: float = 0.0
    stock_reduction: float = 0.0

    @classmethod
    def from_dict(cls, params: Mapping[str, object]) -> ScenarioParams:
        known = {f.name for f in fields(cls)}
        return cls(**{k: v for k, v in params.items() if k in known})

    def to_dict(self) -> dict[str, object]:
        return asdict(self)


# The preset scenarios.
REFERENCE_SCENARIO = "Référence"
PRESETS = {
    REFERENCE_SCENARIO: ScenarioParams(),
    "Épidémie Légère": ScenarioParams(epidemic_intensity=15, staffing_reduction=5),
    "Épidémie Sévère": ScenarioParams(epidemic_intensity=40, staffing_reduction=15),
    "Grève du Personnel": ScenarioParams(staffing_reduction=30, stock_reduction=10),
    "Pic Hivernal": ScenarioParams(epidemic_intensity=25, seasonal_multiplier=1.2),
    "Canicule Estivale": ScenarioParams(epidemic_intensity=10, seasonal_multiplier=0.9, staffing_reduction=10),
    "Accident Majeur": ScenarioParams(shock_day_spike=80, shock_day_index=0),
}

# Occupancy against which the scenario page shows its difference.
REFERENCE_OCCUPANCY = 0.45
LOW_STOCK_PCT = 50


def create_preset_scenarios() -> dict[str, ScenarioParams]:
    return dict(PRESETS)


def shock_index(shock_date: date, start: date) -> int:
    """Position in a contiguous forecast of an exact shock date."""
    return (shock_date - start).days


def _literals(p: ScenarioParams) -> dict[str, Column]:
    return {
        f.name: F.lit(getattr(p, f.name)).cast("int" if f.name == "shock_day_index" else "double")
        for f in fields(ScenarioParams)
    }


def scenario_table(spark, scenarios: Mapping[str, ScenarioParams]) -> DataFrame:
    """One row per scenario, defaults filled in."""
    rows = [F.struct(F.lit(n).alias("scenario"), *[c.alias(k) for k, c in _literals(p).items()]) for n, p in scenarios.items()]
    return spark.range(1).select(F.inline(F.array(*rows)))


def _project(df: DataFrame, p: Mapping[str, Column], prediction_col: str, capacity: Capacity, shocked: bool) -> DataFrame:
    base = F.col(prediction_col).cast("double")
    demand = base * (1 + p["epidemic_intensity"] / 100) * p["seasonal_multiplier"]
    if shocked:
        on_shock_day = (p["shock_day_spike"] > 0) & (F.col("__day") == p["shock_day_index"])
        demand = F.when(on_shock_day, demand * (1 + p["shock_day_spike"] / 100)).otherwise(demand)
    staffing = 1 - p["staffing_reduction"] / 100
    df = df.withColumns({
        "scenario_admissions": demand,
        "effective_staff": F.lit(capacity.total_staff) * staffing,
        "effective_beds": F.lit(capacity.total_beds) * (1 - p["beds_reduction"] / 100),
        "effective_stock_pct": F.lit(capacity.base_stock_pct) * (1 - p["stock_reduction"] / 100),
        "baseline_admissions": base,
        "__normal": F.lit(capacity.normal_admissions) * staffing,
    }).withColumn("effective_capacity", F.least(
        F.col("__normal"), F.col("effective_staff") * capacity.patients_per_staff,
        F.col("effective_beds") * F.lit(capacity.critical_occupancy),
    )).withColumns({
        "capacity_gap": F.col("scenario_admissions") - F.col("effective_capacity"),
        "occupancy_rate": F.try_divide("scenario_admissions", "effective_beds"),
    })
    return df.withColumns({
        "is_overcapacity": F.col("capacity_gap") > 0,
        "is_critical": F.col("occupancy_rate") > F.lit(capacity.critical_occupancy),
        "demand_change_pct": F.try_divide(
            F.col("scenario_admissions") - F.col("baseline_admissions"), F.col("baseline_admissions")) * 100,
    }).drop("__normal", "__day")


def _with_day(df: DataFrame, shocked: bool, by: Sequence[str]) -> DataFrame:
    return day_index(df, [c for c in by if c in df.columns], "__day") if shocked else df


def apply_scenario(
    forecast_df: DataFrame, scenario: ScenarioParams, prediction_col: str = "predicted_admissions",
    capacity: Capacity = CAPACITY, by: Sequence[str] = ("hospital_id",),
) -> DataFrame:
    """Demand, capacity, gap and occupancy of each forecast day under one scenario."""
    shocked = scenario.shock_day_index is not None and scenario.shock_day_spike > 0
    days = _with_day(forecast_df, shocked, by)
    return _project(days, _literals(scenario), prediction_col, capacity, shocked)


def apply_scenarios(
    forecast_df: DataFrame, scenarios: Mapping[str, ScenarioParams] = PRESETS,
    prediction_col: str = "predicted_admissions", capacity: Capacity = CAPACITY, by: Sequence[str] = ("hospital_id",),
) -> DataFrame:
    """Every scenario on every forecast day, in one plan, with a ``scenario`` column.

    The scenarios are a literal array in the plan, so no join and no rescan is needed.
    """
    shocked = any(p.shock_day_index is not None and p.shock_day_spike > 0 for p in scenarios.values())
    params = F.array(*[
        F.struct(F.lit(n).alias("scenario"), *[c.alias(k) for k, c in _literals(p).items()])
        for n, p in scenarios.items()
    ])
    days = _with_day(forecast_df, shocked, by).withColumn("__p", F.explode(params))
    columns = {f.name: F.col("__p")[f.name] for f in fields(ScenarioParams)}
    days = days.withColumn("scenario", F.col("__p.scenario"))
    return _project(days, columns, prediction_col, capacity, shocked).drop("__p")


def summarize_scenario_impact(scenario_df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    group = scenario_df.groupBy(*by) if by else scenario_df
    return group.agg(
        F.avg("scenario_admissions").alias("avg_daily_admissions"),
        F.max("scenario_admissions").alias("max_daily_admissions"),
        F.count_if("is_overcapacity").alias("days_overcapacity"),
        F.count_if("is_critical").alias("days_critical"),
        F.avg("capacity_gap").alias("avg_capacity_gap"),
        F.max("capacity_gap").alias("max_capacity_gap"),
        F.avg("occupancy_rate").alias("avg_occupancy_rate"),
    )


def scenario_deltas(scenario_df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Scenario against its own baseline: percent, units, and percentage points of occupancy."""
    group = scenario_df.groupBy(*by) if by else scenario_df
    s, b = F.col("scenario_admissions"), F.col("baseline_admissions")
    return group.agg(
        (F.try_divide(F.avg(s) - F.avg(b), F.avg(b)) * 100).alias("avg_change_pct"),
        (F.max(s) - F.max(b)).alias("peak_change"),
        F.sum(b).alias("baseline_total"),
        ((F.avg("occupancy_rate") - F.lit(REFERENCE_OCCUPANCY)) * 100).alias("occupancy_points"),
    )


def compare_scenarios(
    forecast_df: DataFrame, scenarios: Mapping[str, ScenarioParams] = PRESETS, by: Sequence[str] = (),
    capacity: Capacity = CAPACITY, prediction_col: str = "predicted_admissions",
) -> DataFrame:
    """Impact of every scenario except the reference one, side by side."""
    chosen = {n: p for n, p in scenarios.items() if n != REFERENCE_SCENARIO}
    projected = apply_scenarios(forecast_df, chosen, prediction_col, capacity)
    return summarize_scenario_impact(projected, ["scenario", *by])


def resource_impact(scenario_df: DataFrame, by: Sequence[str] = (), capacity: Capacity = CAPACITY) -> DataFrame:
    group = scenario_df.groupBy(*by) if by else scenario_df
    staff, beds, stock = F.avg("effective_staff"), F.avg("effective_beds"), F.avg("effective_stock_pct")
    return group.agg(
        staff.alias("effective_staff"), (F.lit(capacity.total_staff) - staff).alias("staff_reduction"),
        beds.alias("effective_beds"), (F.lit(capacity.total_beds) - beds).alias("beds_reduction"),
        stock.alias("effective_stock_pct"), (stock < LOW_STOCK_PCT).alias("stock_low"),
    )


def detail_table(scenario_df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """The daily detail of the scenario page, with its row flag."""
    tenths = rounded(F.col("occupancy_rate") * 100, 1)
    return scenario_df.select(
        *by,
        F.date_format("date", CSV.date_pattern).alias("Date"),
        rounded_int(F.col("baseline_admissions")).alias("Référence"),
        rounded_int(F.col("scenario_admissions")).alias("Scénario"),
        rounded_int(F.col("effective_capacity")).alias("Capacité"),
        rounded_int(F.col("capacity_gap")).alias("Écart"),
        F.concat(tenths.cast("string"), F.lit("%")).alias("Occupation"),
        F.col("is_overcapacity").alias("Surcapacité"),
        F.col("is_critical").alias("Critique"),
        F.when(F.col("is_overcapacity"), "overcapacity").when(F.col("is_critical"), "critical")
        .otherwise("none").alias("row_flag"),
    )
