"""Row filters of the dashboard and the action pages."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bedwise.functions.columns import as_column, day_name_of

# When a day counts as an event day.
EVENT_CONDITIONS = {
    "epidemic": ("epidemic_level", lambda c: c > 0),
    "heatwave": ("heatwave_event", lambda c: c == 1),
    "strike": ("strike_level", lambda c: c > 0),
    "accident": ("accident_event", lambda c: c == 1),
}


def between_dates(df: DataFrame, start: date, end: date, column: str = "date") -> DataFrame:
    """Rows from ``start`` to ``end``, both included."""
    return df.where(F.col(column).between(F.lit(start), F.lit(end)))


def event_condition(df: DataFrame, events: Sequence[str]) -> Column | None:
    """Any of the selected events; none selected, or none of their columns present: no condition."""
    chosen = [EVENT_CONDITIONS[e] for e in events]
    conditions = [test(F.col(c)) for c, test in chosen if c in df.columns]
    return F.coalesce(reduce(or_, conditions), F.lit(False)) if conditions else None


def on_event_days(df: DataFrame, events: Sequence[str]) -> DataFrame:
    condition = event_condition(df, events)
    return df if condition is None else df.where(condition)


def is_empty(df: DataFrame) -> bool:
    return df.isEmpty()


def with_priority(df: DataFrame, priorities: Sequence[str], column: str = "priority") -> DataFrame:
    """Rows whose priority is selected; an empty selection keeps all."""
    return df.where(F.col(column).isin(*priorities)) if priorities else df


def contains_any(text: Column | str, pattern: str) -> Column:
    """Case-insensitive regular expression search; null text is no match."""
    return F.coalesce(as_column(text).rlike(f"(?i){pattern}"), F.lit(False))


def drifted(comparison: DataFrame) -> DataFrame:
    return comparison.where(F.col("status") == "DRIFT")


def wrong_day_names(df: DataFrame) -> DataFrame:
    """Rows whose stored day name is not that of their date."""
    expected = day_name_of(F.weekday("date"))
    return df.withColumn("expected_day", expected).where(~F.col("day_of_week").eqNullSafe(F.col("expected_day")))
