"""Forecast calendar, driver columns and forecast summaries."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from datetime import date

from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bedwise.functions.columns import calendar_fields, day_name_of, pick, rounded_int, season_of
from bedwise.settings import (
    CSV, DEFAULT_SITE, FORECAST_DRIVERS, MODEL, MONTH_SURGERIES, MONTH_TEMPERATURE, WEEKEND_SURGERIES,
)


def future_days(starts: DataFrame, n_days: int, start: Column | str = "start") -> DataFrame:
    """``n_days`` calendar rows from the start date of every row of ``starts``."""
    first = F.col(start) if isinstance(start, str) else start
    days = starts.withColumn("date", F.explode(F.sequence(first, F.date_add(first, n_days - 1))))
    fields = calendar_fields(F.col("date"))
    return days.withColumns(
        fields | {"season": season_of(fields["month"]), "day_of_week": day_name_of(fields["dow"])}
    )


def generate_future_dates(spark: SparkSession, start_date: date, n_days: int = 30) -> DataFrame:
    return future_days(spark.range(1).select(F.lit(start_date).alias("start")), n_days).drop("start")


def days_after(history: DataFrame, n_days: int = 30, by: Sequence[str] = ("hospital_id",)) -> DataFrame:
    """The ``n_days`` after each site's last day."""
    last = history.groupBy(*by).agg(F.date_add(F.max("date"), 1).alias("start"))
    return future_days(last, n_days).drop("start")


def with_drivers(days: DataFrame, overrides: Mapping[str, object] | None = None) -> DataFrame:
    """Monthly temperature and surgeries and the default drivers; overrides replace any column."""
    month, weekend = F.col("month"), F.col("is_weekend") == 1
    columns: dict[str, Column] = {
        "temperature_c": pick(MONTH_TEMPERATURE, month).cast("double"),
        "scheduled_surgeries": F.when(weekend, WEEKEND_SURGERIES).otherwise(pick(MONTH_SURGERIES, month)),
    }
    columns |= {c: F.lit(v) for c, v in FORECAST_DRIVERS.items() if c not in days.columns}
    columns |= {c: F.lit(v) for c, v in (overrides or {}).items()}
    return days.withColumns(columns)


def forecast(
    spark: SparkSession, model: PipelineModel, start_date: date, n_days: int = 30,
    scenario_features: Mapping[str, object] | None = None, hospital_id: str = DEFAULT_SITE,
) -> DataFrame:
    from bedwise.plans.learning import predict

    days = generate_future_dates(spark, start_date, n_days).withColumn("hospital_id", F.lit(hospital_id))
    return predict(model, with_drivers(days, scenario_features))


def forecast_sites(
    model: PipelineModel, history: DataFrame, n_days: int = 30, scenario_features: Mapping[str, object] | None = None,
) -> DataFrame:
    """Forecast of every site of ``history`` from its own last day on."""
    from bedwise.plans.learning import predict

    return predict(model, with_drivers(days_after(history, n_days), scenario_features))


def with_band(df: DataFrame, prediction_col: str = "predicted_admissions", share: float = 0.15) -> DataFrame:
    p = F.col(prediction_col)
    return df.withColumns({"lower": p * F.lit(1 - share), "upper": p * F.lit(1 + share)})


def forecast_kpis(df: DataFrame, prediction_col: str = "predicted_admissions", by: Sequence[str] = ()) -> DataFrame:
    group = df.groupBy(*by) if by else df
    return group.agg(
        F.avg(prediction_col).alias("avg_daily"), F.max(prediction_col).alias("peak_day"),
        F.sum(prediction_col).alias("total"),
    )


def forecast_table(df: DataFrame, prediction_col: str = "predicted_admissions", by: Sequence[str] = ()) -> DataFrame:
    """Date as text and the prediction as a whole number."""
    return df.select(
        *by, F.date_format("date", CSV.date_pattern).alias("date"), rounded_int(F.col(prediction_col)).alias("predicted"))


def actual_and_predicted(predictions: DataFrame, target: str = MODEL.target, by: Sequence[str] = ("hospital_id",)) -> DataFrame:
    return predictions.select(
        *[c for c in by if c in predictions.columns], "date", F.col(target).cast("double").alias("actual"),
        F.col("predicted_admissions").alias("predicted"),
    )
