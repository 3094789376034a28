"""Dashboard and profiling aggregations.

Every function is one aggregation with map-side combine. Where several numbers are wanted
from one table they share a single wide ``agg`` and are turned into rows afterwards.
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bedwise.functions.columns import as_column, rounded
from bedwise.functions.labels import weekday_label
from bedwise.functions.quantiles import exact_quantiles
from bedwise.schema import numeric_columns
from bedwise.settings import MODEL

# The columns averaged by the KPI block and shown in the correlation matrix.
KPI_COLUMNS = {
    "total_admissions": ("avg_admissions", 1.0), "emergency_admissions": ("avg_emergency", 1.0),
    "pediatric_admissions": ("avg_pediatric", 1.0), "icu_admissions": ("avg_icu", 1.0),
    "available_beds": ("avg_beds", 1.0), "available_staff": ("avg_staff", 1.0),
    "bed_occupancy_rate": ("avg_occupancy_pct", 100.0), "waiting_time_avg_min": ("avg_wait_min", 1.0),
    "medical_stock_level_pct": ("avg_stock_pct", 1.0), "estimated_cost_per_day": ("avg_cost_thousands", 0.001),
    "patient_satisfaction_score": ("avg_satisfaction", 1.0),
}
CORRELATION_COLUMNS = [
    "total_admissions", "emergency_admissions", "pediatric_admissions", "icu_admissions",
    "available_beds", "available_staff", "bed_occupancy_rate", "waiting_time_avg_min",
    "epidemic_level", "temperature_c", "staff_absence_rate", "medical_stock_level_pct",
]


def rows_of(one_row: DataFrame, *structs: Column) -> DataFrame:
    """Turn a one-row aggregate into one row per struct."""
    return one_row.select(F.inline(F.array(*structs)))


def kpi_block(df: DataFrame, condition: Column | None = None) -> DataFrame:
    """Means over the rows that meet ``condition`` and the admissions delta to all rows, in one pass."""
    keep = F.lit(True) if condition is None else condition
    means = {
        name: F.avg(F.when(keep, F.col(c))) * factor
        for c, (name, factor) in KPI_COLUMNS.items() if c in df.columns
    }
    total = KPI_COLUMNS[MODEL.target][0]
    return df.agg(
        F.count_if(keep).alias("days"),
        *[m.alias(name) for name, m in means.items()],
        (means[total] - F.avg(MODEL.target)).alias("admissions_delta"),
    )


def resample(df: DataFrame, every: str, by: Sequence[str] = (), columns: Sequence[str] | None = None) -> DataFrame:
    """Mean of the numeric columns per ``week`` (labelled by its Sunday) or ``month`` (by its first day).

    Periods between the first and the last that hold no row are kept, with null means.
    """
    if every == "week":
        label, step = F.date_add(F.trunc("date", "WEEK"), 6), "7 days"
    elif every == "month":
        label, step = F.trunc("date", "MONTH"), "1 month"
    else:
        raise ValueError(f"unknown period {every!r}")
    columns = [c for c in (columns or numeric_columns(df)) if c not in by]
    means = (
        df.where(F.col("date").isNotNull())
        .groupBy(*by, label.alias("period")).agg(*[F.avg(c).alias(c) for c in columns])
    )
    # Each period is unfolded up to the one before the next; a site has few periods.
    following = F.lead("period").over(Window.partitionBy(*by).orderBy("period"))
    last = F.coalesce(F.expr(f"cast(__next - interval {step} as date)"), F.col("period"))
    unfolded = means.withColumn("__next", following).select(
        "*", F.posexplode(F.sequence("period", last, F.expr(f"interval {step}"))).alias("__gap", "date"))
    return unfolded.select(*by, "date", *[F.when(F.col("__gap") == 0, F.col(c)).alias(c) for c in columns])


def mean_by(df: DataFrame, key: str, value: str = MODEL.target) -> DataFrame:
    return df.groupBy(key).agg(F.avg(value).alias(value))


def _correlation(a: str, b: str) -> Column:
    # A constant side gives null; ``corr`` would divide by zero.
    x, y = f"if(`{b}` is null, null, `{a}`)", f"if(`{a}` is null, null, `{b}`)"
    return F.expr(f"covar_pop(`{a}`, `{b}`) / nullif(stddev_pop({x}) * stddev_pop({y}), 0D)")


def correlations(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Pairwise-complete Pearson matrix as ``(x, y, r)``, all pairs from one pass."""
    columns = [c for c in columns if c in df.columns]
    pairs = list(combinations(range(len(columns)), 2))
    row = df.agg(
        *[F.expr(f"if(stddev_pop(`{c}`) > 0, 1D, null)").alias(f"r{i}_{i}") for i, c in enumerate(columns)],
        *[_correlation(columns[i], columns[j]).alias(f"r{i}_{j}") for i, j in pairs],
    )
    span = range(len(columns))
    cells = [f"struct('{columns[i]}' as x, '{columns[j]}' as y, r{min(i, j)}_{max(i, j)} as r)" for i in span for j in span]
    return row.select(F.expr(f"inline(array({', '.join(cells)}))"))


def target_correlations(df: DataFrame, columns: Sequence[str], target: str = MODEL.target) -> DataFrame:
    """Correlation of each column with the target: ``(variable, r)``."""
    columns = [c for c in columns if c in df.columns and c != target]
    row = df.agg(*[_correlation(target, c).alias(c) for c in columns])
    return rows_of(row, *[F.struct(F.lit(c).alias("variable"), F.col(c).alias("r")) for c in columns])


def top_correlations(correlated: DataFrame, n: int = 5) -> DataFrame:
    """The ``n`` strongest positive and the ``n`` strongest negative variables, strongest first."""
    sign = F.when(F.col("r") > 0, "positive").when(F.col("r") < 0, "negative")
    strongest = Window.partitionBy("sign").orderBy(F.abs("r").desc(), "variable")
    return (
        correlated.withColumn("sign", sign).where(F.col("sign").isNotNull())
        .withColumn("__rank", F.row_number().over(strongest)).where(F.col("__rank") <= n).drop("__rank")
        .orderBy(F.desc("sign"), F.abs("r").desc(), "variable")
    )


def sorted_correlations(correlated: DataFrame) -> DataFrame:
    """Variables by falling correlation, undefined ones last, with their ``place``. One row per column."""
    order = Window.orderBy(F.desc_nulls_last("r"), "variable")
    return correlated.withColumn("place", F.row_number().over(order)).orderBy("place")


def histogram(df: DataFrame, column: str, bins: int = 30) -> DataFrame:
    """Equal-width bins, the last one closed, empty ones kept: ``(bin, lower, upper, rows)``."""
    x = F.col(column).cast("double")
    ends = df.agg(F.struct(F.min(x).alias("lo"), F.max(x).alias("hi")).alias("ends")).scalar()
    same = ends["lo"] == ends["hi"]
    lo = F.when(same, ends["lo"] - 0.5).otherwise(ends["lo"])
    width = F.when(same, F.lit(1.0)).otherwise(ends["hi"] - ends["lo"]) / F.lit(float(bins))
    counts = (
        df.where(x.isNotNull())
        .groupBy(F.least(F.floor((x - lo) / width), F.lit(bins - 1)).cast("int").alias("bin"))
        .agg(F.count(F.lit(1)).alias("rows"))
    )
    spine = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    return spine.join(counts, "bin", "left").select(
        "bin", (lo + F.col("bin") * width).alias("lower"), (lo + (F.col("bin") + 1) * width).alias("upper"),
        F.coalesce("rows", F.lit(0)).alias("rows"),
    )


def box_plot(df: DataFrame, key: str = "dow", value: str = MODEL.target) -> DataFrame:
    """Minimum, quartiles and maximum of ``value`` per ``key``."""
    names = {0.0: "low", 0.25: "q1", 0.5: "median", 0.75: "q3", 1.0: "high"}
    quantiles = exact_quantiles(df.where(F.col(key).isNotNull()), [value], list(names), by=[key])
    return quantiles.groupBy(key).agg(*[F.max(F.when(F.col("p") == p, F.col("value"))).alias(n) for p, n in names.items()])


def weekday_box_plot(df: DataFrame, value: str = MODEL.target) -> DataFrame:
    return box_plot(df, "dow", value).withColumn("label", weekday_label(F.col("dow")))


def _stats(c: str) -> list[Column]:
    return [
        F.min(c).cast("double").alias(f"{c}__min"), F.max(c).cast("double").alias(f"{c}__max"),
        F.avg(c).alias(f"{c}__mean"), F.stddev_samp(c).alias(f"{c}__std"),
    ]


def column_stats(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """``(column, min, max, mean, std)`` per numeric column."""
    columns = columns or numeric_columns(df)
    row = df.agg(*[s for c in columns for s in _stats(c)])
    return rows_of(row, *[
        F.struct(F.lit(c).alias("column"), *[F.col(f"{c}__{s}").alias(s) for s in ("min", "max", "mean", "std")])
        for c in columns
    ])


def describe(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """``column_stats`` with the value count and the exact quartiles."""
    columns = columns or numeric_columns(df)
    row = df.agg(*[s for c in columns for s in [F.count(c).alias(f"{c}__count"), *_stats(c)]])
    stats = rows_of(row, *[
        F.struct(
            F.lit(c).alias("column"),
            *[F.col(f"{c}__{s}").alias(s) for s in ("count", "mean", "std", "min", "max")],
        )
        for c in columns
    ])
    quartiles = exact_quantiles(df, columns, [0.25, 0.5, 0.75]).groupBy("column").agg(*[
        F.max(F.when(F.col("p") == p, F.col("value"))).alias(name)
        for p, name in ((0.25, "q1"), (0.5, "median"), (0.75, "q3"))
    ])
    return stats.join(quartiles, "column", "left")


def null_counts(df: DataFrame) -> DataFrame:
    """``(column, nulls)`` for columns with nulls, most first."""
    row = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in df.columns])
    return (
        rows_of(row, *[F.struct(F.lit(c).alias("column"), F.col(c).alias("nulls")) for c in df.columns])
        .where(F.col("nulls") > 0).orderBy(F.desc("nulls"), "column")
    )


def duplicate_count(df: DataFrame) -> DataFrame:
    """Rows beyond the first of each set of equal rows."""
    copies = df.groupBy(*df.columns).agg(F.count(F.lit(1)).alias("__copies"))
    return copies.agg(F.coalesce(F.sum(F.col("__copies") - 1), F.lit(0)).alias("duplicates"))


def unparseable_dates(df: DataFrame, column: str = "date", pattern: str | None = None) -> DataFrame:
    """Values that are null or no date of the pattern."""
    c = F.col(column)
    if isinstance(df.schema[column].dataType, T.StringType):
        c = F.try_to_date(c, pattern) if pattern else F.try_to_date(c)
    return df.agg(F.count_if(c.isNull()).alias("invalid_dates"))


def coverage(df: DataFrame) -> DataFrame:
    """Row count, date range and number of sites."""
    sites = F.count_distinct("hospital_id") if "hospital_id" in df.columns else F.lit(1).cast("bigint")
    return df.agg(
        F.count(F.lit(1)).alias("n_rows"), F.min("date").alias("first_date"), F.max("date").alias("last_date"),
        sites.alias("hospitals"),
    )


def site_summary(df: DataFrame) -> DataFrame:
    return df.groupBy("hospital_id").agg(
        rounded(F.avg("total_admissions"), 1).alias("admissions_mean"),
        rounded(F.stddev_samp("total_admissions"), 1).alias("admissions_std"),
        rounded(F.avg("emergency_admissions"), 1).alias("emergency_mean"),
        rounded(F.avg("available_beds"), 1).alias("beds_mean"),
    )


def seasonality_contrasts(df: DataFrame, value: str = MODEL.target) -> DataFrame:
    """Weekend against weekday and winter against summer means."""

    def mean(condition: Column) -> Column:
        return F.avg(F.when(condition, F.col(value)))

    row = df.agg(
        mean(F.weekday("date") >= 5).alias("weekend_mean"), mean(F.weekday("date") < 5).alias("weekday_mean"),
        mean(F.month("date").isin(12, 1, 2)).alias("winter_mean"),
        mean(F.month("date").isin(6, 7, 8)).alias("summer_mean"),
    )
    return row.select(
        "*", (F.col("weekend_mean") < F.col("weekday_mean")).alias("weekend_lower"),
        (F.col("winter_mean") > F.col("summer_mean")).alias("winter_higher"),
    )


def regression_metrics(df: DataFrame, actual: Column | str, predicted: Column | str, by: Sequence[str] = ()) -> DataFrame:
    """MAE, RMSE and R² from one pass over actual and predicted values."""
    y, f = as_column(actual), as_column(predicted)
    group = df.groupBy(*by) if by else df
    squares = F.sum((y - f) * (y - f))
    return group.agg(
        F.count(F.lit(1)).alias("rows"),
        F.avg(F.abs(y - f)).alias("mae"),
        F.sqrt(F.avg((y - f) * (y - f))).alias("rmse"),
        (1 - squares / F.when(F.var_pop(y) > 0, F.var_pop(y) * F.count(F.lit(1)))).alias("r2"),
    )


def error_ratio_pct(metrics: DataFrame, history: DataFrame, target: str = MODEL.target) -> DataFrame:
    """The page's "MAPE": MAE as a share of the mean target of ``history``, in percent."""
    mean = history.agg(F.avg(target)).scalar()
    return metrics.withColumn("mape", F.try_divide(F.col("mae"), mean) * 100)


def residual_stats(df: DataFrame, actual: str = "actual", predicted: str = "predicted") -> DataFrame:
    residual = F.col(actual) - F.col(predicted)
    near = F.abs(residual) < F.col(actual) * F.lit(0.1)
    return df.agg(
        F.avg(residual).alias("residual_mean"), F.stddev_samp(residual).alias("residual_std"),
        F.avg(near.cast("double")).alias("within_10pct"),
    )
