"""Order-dependent operators on daily tables.

They expect one row per (site, day), which ``groupBy(site, day)`` gives. A site then holds at
most one row per calendar day, so a window over one site is bounded by the calendar however
large the network or the raw data is; it cannot become a hot partition.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bedwise.functions.columns import rounded
from bedwise.settings import MODEL


def _ordered(by: Sequence[str], order: str):
    return Window.partitionBy(*by).orderBy(order)


def rolling_mean(
    df: DataFrame, value: str = MODEL.target, window: int = 7, by: Sequence[str] = ("hospital_id",),
    order: str = "date", name: str = "rolling_mean",
) -> DataFrame:
    """Mean of the last ``window`` rows, null until that many values exist."""
    frame = _ordered(by, order).rowsBetween(1 - window, 0)
    full = F.count(value).over(frame) >= window
    return df.withColumn(name, F.when(full, F.avg(value).over(frame)))


def naive_forecast(
    df: DataFrame, value: str = MODEL.target, window: int = 7, start: float = 400.0,
    by: Sequence[str] = ("hospital_id",), order: str = "date", name: str = "naive_pred_total_admissions",
) -> DataFrame:
    """Mean of the up to ``window`` rows before the current one, truncated; ``start`` on the first row."""
    frame = _ordered(by, order).rowsBetween(-window, -1)
    return df.withColumn(name, F.coalesce(F.avg(value).over(frame), F.lit(start)).cast("int"))


def years_elapsed(df: DataFrame, by: Sequence[str] = ("hospital_id",), name: str = "years_elapsed") -> DataFrame:
    year = F.year("date")
    return df.withColumn(name, year - F.min(year).over(Window.partitionBy(*by)))


def centred(df: DataFrame, value: Column, name: str, by: Sequence[str] = ("hospital_id",)) -> DataFrame:
    """``value`` less its mean over the site's series."""
    return df.withColumn(name, value - F.avg(value).over(Window.partitionBy(*by)))


def day_index(df: DataFrame, by: Sequence[str] = ("hospital_id",), name: str = "day_index") -> DataFrame:
    """Position of a day in its series, from 0."""
    return df.withColumn(name, F.row_number().over(_ordered(by, "date")) - 1)


def last_rows(df: DataFrame, n: int = 90, by: Sequence[str] = ("hospital_id",)) -> DataFrame:
    """The latest ``n`` rows, per site or overall."""
    if not by:
        return df.orderBy(F.desc("date")).limit(n)
    latest = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("date")))
    return df.withColumn("__rank", latest).where(F.col("__rank") <= n).drop("__rank")


def labelled_series(
    history: DataFrame, forecast: DataFrame, value: str = MODEL.target, predicted: str = "predicted_admissions",
    by: Sequence[str] = ("hospital_id",),
) -> DataFrame:
    """History and forecast as one table with a ``series`` label."""
    past = history.select(*by, "date", F.lit("history").alias("series"), F.col(value).cast("double").alias("admissions"))
    future = forecast.select(*by, "date", F.lit("forecast").alias("series"), F.col(predicted).cast("double").alias("admissions"))
    return past.unionByName(future)


def event_spells(df: DataFrame, level: str, by: Sequence[str] = ("hospital_id",)) -> DataFrame:
    """Maximal runs of consecutive days at one non-zero level: first and last day, length, level."""
    run = F.date_sub("date", F.row_number().over(_ordered([*by, level], "date")))
    return (
        df.where(F.col(level) != 0).select(*by, "date", level)
        .withColumn("__run", run)
        .groupBy(*by, level, "__run")
        .agg(F.min("date").alias("start_date"), F.max("date").alias("end_date"), F.count(F.lit(1)).alias("days"))
        .drop("__run").withColumnRenamed(level, "level")
    )


def stock_ledger(
    df: DataFrame, start: float = 72.0, usage: float = 1.8, delivery: float = 7.0, low: float = 40.0,
    high: float = 95.0, by: Sequence[str] = ("hospital_id",), name: str = "medical_stock_level_pct",
) -> DataFrame:
    """Daily stock level ``clip(previous - usage + delivery * delivered, low, high)``, from ``start``.

    A site moves once a day: rows of one day share a level, and a delivery in any of them is that day's delivery. A run of steps
    is itself one shift with two bounds, and such shifts compose in any grouping: days to months, months to years. The level
    on which a year opens comes from the years before it, that of a month from the months before it in the year. Arrays
    hold the steps of one month, the months of one year and the years of one site; the rows are joined to their day's level.
    """
    day, days = F.col("date").cast("date"), Window.partitionBy(*by)
    step = F.when(F.col("__day") == F.min("__day").over(days), F.lit(0.0)).otherwise(F.col("__delivered") * F.lit(delivery) - F.lit(usage))
    steps = (
        df.where(F.col("date").isNotNull()).groupBy(*by, day.alias("__day")).agg(F.coalesce(F.max("supply_delivery_day"), F.lit(0)).alias("__delivered"))
        .select(*by, "__day", step.alias("__step"))
    )

    def composed(maps, opening=None):
        """The maps one after another, as one map; with ``opening``, the level they lead to."""
        if opening is not None:
            return F.aggregate(maps, opening, lambda level, m: F.least(F.greatest(level + m["shift"], m["low"]), m["high"]))
        untouched = F.struct(F.lit(0.0).alias("shift"), F.lit(float("-inf")).alias("low"), F.lit(float("inf")).alias("high"))

        def then(acc, m):
            return F.struct(
                (acc["shift"] + m["shift"]).alias("shift"), F.least(F.greatest(acc["low"] + m["shift"], m["low"]), m["high"]).alias("low"),
                F.least(F.greatest(acc["high"] + m["shift"], m["low"]), m["high"]).alias("high"))

        return F.aggregate(maps, untouched, then)

    one_day = F.struct(F.col("__day").alias("day"), F.col("__step").alias("shift"), F.lit(float(low)).alias("low"), F.lit(float(high)).alias("high"))
    months = steps.groupBy(*by, F.year("__day").alias("__year"), F.month("__day").alias("__month")).agg(F.array_sort(F.collect_list(one_day)).alias("__days"))
    month = F.struct("__month", composed(F.col("__days")).alias("map"), "__days")
    years = months.groupBy(*by, "__year").agg(F.array_sort(F.collect_list(month)).alias("__months"))
    years = years.withColumn("__map", composed(F.transform("__months", lambda m: m["map"])))
    before = Window.partitionBy(*by).orderBy("__year").rowsBetween(Window.unboundedPreceding, -1)
    years = years.withColumn("__opening", composed(F.collect_list("__map").over(before), F.lit(float(start))))
    opened = years.select(*by, "__opening", "__months", F.posexplode("__months").alias("__i", "__m")).select(
        *by, composed(F.slice(F.transform("__months", lambda m: m["map"]), 1, F.col("__i")), F.col("__opening")).alias("__opening"), F.col("__m.__days").alias("__days"))
    levels = opened.select(*by, "__opening", "__days", F.posexplode("__days").alias("__i", "__d")).select(
        *[F.col(c).alias(f"__{c}") for c in by], F.col("__d.day").alias("__day"),
        composed(F.slice("__days", 1, F.col("__i") + 1), F.col("__opening")).alias("__level"))
    same = reduce(and_, [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in by], day == F.col("__day"))
    columns = [c for c in df.columns if c != name]
    return df.select(*columns).join(levels, same, "left").select(*columns, rounded(F.col("__level"), 1).alias(name))
