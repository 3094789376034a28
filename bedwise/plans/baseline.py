"""Seasonal baseline: mean per weekday and per month.

A fitted baseline is a DataFrame with one row per site (one row in all without ``by``):
``(by..., overall_mean, overall_std, dow_means array[7], month_means array[12], last_date)``.
One conditional aggregation fits it. A forecast unfolds that row over the coming days, so fit
and forecast of a whole network read the history once and need no join.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bedwise.functions.labels import month_label, weekday_label
from bedwise.plans.forecast import future_days
from bedwise.settings import MODEL

_PARTS = ["overall_mean", "overall_std", "dow_means", "month_means"]


def train_baseline(df: DataFrame, target_col: str = MODEL.target, by: Sequence[str] = ()) -> DataFrame:
    y = F.col(target_col)
    dow = F.col("dow") if "dow" in df.columns else F.weekday("date")
    month = F.col("month") if "month" in df.columns else F.month("date")
    group = df.groupBy(*by) if by else df
    return group.agg(
        F.avg(y).alias("overall_mean"),
        F.stddev_samp(y).alias("overall_std"),
        F.array(*[F.avg(F.when(dow == i, y)) for i in range(7)]).alias("dow_means"),
        F.array(*[F.avg(F.when(month == i, y)) for i in range(1, 13)]).alias("month_means"),
        *([F.max("date").alias("last_date")] if "date" in df.columns else []),
    )


def _seasonal(dow_means: Column, month_means: Column, overall: Column) -> Column:
    dow = F.coalesce(F.try_element_at(dow_means, F.col("dow") + 1), overall)
    month = F.coalesce(F.try_element_at(month_means, F.col("month")), overall)
    return (dow + month) / 2


def predict_baseline(
    baseline: DataFrame, df: DataFrame, by: Sequence[str] = (), name: str = "predicted_admissions",
    normal_level: float | None = None,
) -> DataFrame:
    """Mean of the weekday and the month mean; a missing one is the overall mean.

    With ``normal_level`` predictions are scaled so that the overall mean becomes that level,
    which puts sites of any size on the scale of one capacity setting.
    """
    if by:
        joined = df.join(baseline.select(*by, *_PARTS), list(by), "left")
        parts = {c: F.col(c) for c in _PARTS}
    else:
        joined = df
        row = baseline.select(F.struct(*_PARTS).alias("b")).scalar()
        parts = {c: row[c] for c in _PARTS}
    return joined.select(*df.columns, _prediction(parts, normal_level).alias(name))


def predict_in_sample(
    df: DataFrame, by: Sequence[str], target_col: str = MODEL.target, name: str = "predicted_admissions",
) -> DataFrame:
    """As ``predict_baseline`` for the very rows that the baseline is fitted on, reading them once.

    One shuffle by site serves all three means. A site holds one row per day, so its windows are bounded by the calendar.
    Where weekday and month come from the date, one sort by site does too: their few means are taken in the site's own window.
    """
    site, y = Window.partitionBy(*by), F.col(target_col)
    overall = F.avg(y).over(site)

    def mean(key: str, field: Column, values: range) -> Column:
        if key in df.columns:
            return F.coalesce(F.when(F.col(key).isNotNull(), F.avg(y).over(Window.partitionBy(*by, key))), overall)
        return F.coalesce(*[F.when(field == v, F.avg(F.when(field == v, y)).over(site)) for v in values], overall)

    prediction = (mean("dow", F.weekday("date"), range(7)) + mean("month", F.month("date"), range(1, 13))) / 2
    return df.withColumn(name, prediction).select(*df.columns, name)


def _prediction(parts: dict[str, Column], normal_level: float | None) -> Column:
    value = _seasonal(parts["dow_means"], parts["month_means"], parts["overall_mean"])
    if normal_level is None:
        return value
    return value * F.try_divide(F.lit(float(normal_level)), parts["overall_mean"])


def forecast_baseline(
    baseline: DataFrame, n_days: int = 30, by: Sequence[str] = ("hospital_id",), name: str = "predicted_admissions",
    normal_level: float | None = None,
) -> DataFrame:
    """Predictions for the ``n_days`` after each site's last day, with the calendar columns."""
    days = future_days(baseline.withColumn("start", F.date_add("last_date", 1)), n_days)
    calendar = [c for c in days.columns if c not in (*baseline.columns, "start")]
    prediction = _prediction({c: F.col(c) for c in _PARTS}, normal_level)
    return days.select(*by, *calendar, prediction.alias(name))


def baseline_rows(baseline: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """The baseline in long format: ``(by..., part, position, mean, std, last_date)``.

    ``part`` is ``overall`` (one row per site), ``dow`` (position 0 to 6) or ``month`` (1 to 12).
    """
    last = F.col("last_date") if "last_date" in baseline.columns else F.lit(None).cast("date")

    def row(part: str, position: Column, mean: Column, std: Column, date: Column) -> Column:
        return F.struct(
            F.lit(part).alias("part"), position.cast("int").alias("position"), mean.alias("mean"), std.cast("double").alias("std"),
            date.cast("date").alias("last_date"))

    null = F.lit(None)
    rows = F.concat(
        F.array(row("overall", null, F.col("overall_mean"), F.col("overall_std"), last)),
        F.transform("dow_means", lambda m, i: row("dow", i, m, null, null)),
        F.transform("month_means", lambda m, i: row("month", i + 1, m, null, null)),
    )
    return baseline.select(*by, F.inline(rows))


def baseline_from_rows(rows: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Inverse of ``baseline_rows``, by one aggregation. ``last_date`` is null where the baseline had none."""
    def mean(part: str, position: int) -> Column:
        return F.max(F.when((F.col("part") == part) & (F.col("position") == position), F.col("mean")))

    overall = F.col("part") == "overall"
    group = rows.groupBy(*by) if by else rows
    return group.agg(
        F.max(F.when(overall, F.col("mean"))).alias("overall_mean"), F.max(F.when(overall, F.col("std"))).alias("overall_std"),
        F.array(*[mean("dow", i) for i in range(7)]).alias("dow_means"),
        F.array(*[mean("month", i) for i in range(1, 13)]).alias("month_means"),
        F.max("last_date").alias("last_date"),
    )


def weekday_profile(baseline: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Seven labelled weekday means, 0 where there is none."""
    return baseline.select(*by, F.posexplode("dow_means").alias("dow", "mean")).select(
        *by, "dow", weekday_label(F.col("dow")).alias("label"), F.coalesce("mean", F.lit(0.0)).alias("mean"))


def month_profile(baseline: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Twelve labelled month means, 0 where there is none."""
    months = baseline.select(*by, F.posexplode("month_means").alias("position", "mean"))
    month = F.col("position") + 1
    return months.select(*by, month.alias("month"), month_label(month).alias("label"), F.coalesce("mean", F.lit(0.0)).alias("mean"))
