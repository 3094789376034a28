"""Row views of the dashboard."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bedwise.settings import CSV

# The columns of the raw preview.
PREVIEW_COLUMNS = [
    "date", "total_admissions", "emergency_admissions", "available_beds", "available_staff", "bed_occupancy_rate",
]


def raw_preview(df: DataFrame, n: int = 100) -> DataFrame:
    """The first ``n`` days, site by site within a day, with the date as text."""
    order = [c for c in ("date", "hospital_id") if c in df.columns]
    columns = [*[c for c in order if c not in PREVIEW_COLUMNS], *[c for c in PREVIEW_COLUMNS if c in df.columns]]
    return df.select(columns).orderBy(*order).limit(n).withColumn("date", F.date_format("date", CSV.date_pattern))


def relation_points(df: DataFrame, x: str, y: str, color: str | None = None) -> DataFrame:
    """Two variables and an optional group of every row; sample the result before drawing it."""
    columns = [F.col(x).alias("x"), F.col(y).alias("y")]
    return df.select(*columns, *([F.col(color).alias("color")] if color else []))
