"""Validation, drift and semantic profiling.

All counts of a report come from one wide aggregation over the table, whatever the number
of columns and checks; the one-row result is then turned into issue and statistics rows.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bedwise.functions.columns import day_name_of, rounded
from bedwise.operators.aggregates import column_stats, correlations, rows_of
from bedwise.schema import COUNT_COLUMNS, REQUIRED_COLUMNS, numeric_columns
from bedwise.settings import CSV

ISSUE_COLUMNS = ["ord", "column", "issue_type", "message", "severity"]
END_YEAR = 2025


@dataclass(frozen=True)
class ValidationReport:
    """``summary`` has one row; ``comparison`` is None without a reference table."""

    summary: DataFrame
    issues: DataFrame
    column_stats: DataFrame
    comparison: DataFrame | None = None


@dataclass(frozen=True)
class _Check:
    """One possible issue: a number measured on the table and when it is an issue."""

    column: str
    issue_type: str
    severity: str
    measure: Column
    message: str
    fails: str = "positive"
    bound: int = 0


def _day(df: DataFrame) -> Column:
    c = F.col("date")
    return F.try_to_date(c, CSV.date_pattern) if isinstance(df.schema["date"].dataType, T.StringType) else c


def negative_count_checks(df: DataFrame, columns: Sequence[str] = COUNT_COLUMNS) -> list[_Check]:
    return [
        _Check(c, "negative_values", "error", F.count_if(F.col(c) < 0), "{} negative values found")
        for c in columns if c in df.columns
    ]


def capacity_checks(df: DataFrame) -> list[_Check]:
    checks = []
    if "bed_occupancy_rate" in df.columns:
        over = F.count_if(F.col("bed_occupancy_rate") > 1.0)
        checks.append(_Check("bed_occupancy_rate", "constraint_violation", "warning", over, "{} days with occupancy > 100%"))
    if "staff_absence_rate" in df.columns:
        rate = F.col("staff_absence_rate")
        outside = F.count_if((rate < 0) | (rate > 1))
        checks.append(_Check("staff_absence_rate", "out_of_range", "error", outside, "{} values outside [0, 1]"))
    return checks


def missing_value_checks(df: DataFrame) -> list[_Check]:
    return [
        _Check(c, "missing_values", "warning", F.count_if(F.col(c).isNull()), "{} missing values") for c in df.columns
    ]


def date_range_checks(df: DataFrame, expected_end_year: int = END_YEAR) -> list[_Check]:
    if "date" not in df.columns:
        return []
    last = F.max(F.year(_day(df))).cast("bigint")
    text = f"Data ends at {{}}, expected {expected_end_year}"
    return [_Check("date", "incomplete_range", "error", last, text, "below", expected_end_year)]


def missing_columns(df: DataFrame, expected: Sequence[str] = REQUIRED_COLUMNS) -> list[str]:
    """Expected columns the table lacks. Needs no job."""
    return [c for c in expected if c not in df.columns]


def _issue(ord_: int, check: _Check, measured: Column) -> Column:
    before, after = check.message.split("{}")
    text = F.concat(F.lit(before), measured.cast("string"), F.lit(after))
    fails = measured > 0 if check.fails == "positive" else measured < check.bound
    return F.when(fails, F.struct(
        F.lit(ord_).alias("ord"), F.lit(check.column).alias("column"), F.lit(check.issue_type).alias("issue_type"),
        text.alias("message"), F.lit(check.severity).alias("severity"),
    ))


def run_checks(df: DataFrame, checks: Sequence[_Check], expected: Sequence[str] = ()) -> DataFrame:
    """Issues found by ``checks`` and by missing columns, in check order."""
    measured = df.agg(F.lit(1).alias("__one"), *[c.measure.alias(f"m{i}") for i, c in enumerate(checks)])
    return _issues_of(measured, checks, missing_columns(df, expected))


def _issues_of(measured: DataFrame, checks: Sequence[_Check], absent: Sequence[str]) -> DataFrame:
    found = [_issue(i + 1, c, F.col(f"m{i}")) for i, c in enumerate(checks)]
    if absent:
        found.insert(0, F.struct(
            F.lit(0).alias("ord"), F.lit("schema").alias("column"), F.lit("missing_columns").alias("issue_type"),
            F.lit("Missing columns: " + ", ".join(absent)).alias("message"), F.lit("error").alias("severity"),
        ))
    if not found:
        return measured.sparkSession.createDataFrame(
            [], "ord int, column string, issue_type string, message string, severity string")
    return (
        measured.select(F.explode(F.filter(F.array(*found), lambda x: x.isNotNull())).alias("issue"))
        .select("issue.*").select(*ISSUE_COLUMNS)
    )


def validate_no_negative_counts(df: DataFrame, columns: Sequence[str] = COUNT_COLUMNS) -> DataFrame:
    return run_checks(df, negative_count_checks(df, columns))


def validate_capacity_constraints(df: DataFrame) -> DataFrame:
    return run_checks(df, capacity_checks(df))


def validate_missing_values(df: DataFrame) -> DataFrame:
    return run_checks(df, missing_value_checks(df))


def validate_date_range(df: DataFrame, expected_end_year: int = END_YEAR) -> DataFrame:
    return run_checks(df, date_range_checks(df, expected_end_year))


def validate_column_presence(df: DataFrame, expected: Sequence[str] = REQUIRED_COLUMNS) -> DataFrame:
    return run_checks(df.sparkSession.range(1).select(*[F.lit(None).alias(c) for c in df.columns]), [], expected)


def compare_with_reference(generated: DataFrame, reference: DataFrame, tolerance: float = 0.25) -> DataFrame:
    """Drift of mean and standard deviation for the numeric columns both tables have."""
    shared = [c for c in numeric_columns(generated) if c in reference.columns]
    return compare_stats(column_stats(generated, shared), column_stats(reference, shared), tolerance)


def compare_parts(df: DataFrame, new: Column, tolerance: float = 0.25, columns: Sequence[str] | None = None) -> DataFrame:
    """As ``compare_with_reference`` for two parts of one table, in one pass: the rows that meet ``new`` against those that do not.

    Rows for which ``new`` is null belong to neither part.
    """
    columns = columns or numeric_columns(df)
    sides = {"g": new, "r": ~new}
    row = df.agg(*[
        measure(F.when(side, F.col(c))).alias(f"{c}__{s}_{name}")
        for c in columns for s, side in sides.items() for name, measure in (("mean", F.avg), ("std", F.stddev_samp))
    ])
    return _drift(rows_of(row, *[
        F.struct(F.lit(c).alias("column"), *[F.col(f"{c}__{m}").alias(m) for m in ("g_mean", "g_std", "r_mean", "r_std")])
        for c in columns
    ]), tolerance)


def compare_stats(generated: DataFrame, reference: DataFrame, tolerance: float = 0.25) -> DataFrame:
    """Drift between two ``column_stats`` tables, for the columns in both."""
    new = generated.select("column", F.col("mean").alias("g_mean"), F.col("std").alias("g_std"))
    old = reference.select("column", F.col("mean").alias("r_mean"), F.col("std").alias("r_std"))
    return _drift(new.join(old, "column"), tolerance)


def _drift(stats: DataFrame, tolerance: float) -> DataFrame:
    def apart(g: str, r: str) -> Column:
        return F.try_divide(F.abs(F.col(g) - F.col(r)), F.col(r) + F.lit(1e-9)) * 100

    close = apart("g_mean", "r_mean") < F.lit(tolerance * 100)
    return stats.select(
        "column",
        rounded(F.col("g_mean"), 2).alias("gen_mean"), rounded(F.col("r_mean"), 2).alias("ref_mean"),
        rounded(apart("g_mean", "r_mean"), 1).alias("mean_diff_pct"),
        rounded(F.col("g_std"), 2).alias("gen_std"), rounded(F.col("r_std"), 2).alias("ref_std"),
        rounded(apart("g_std", "r_std"), 1).alias("std_diff_pct"),
        F.when(close, "OK").otherwise("DRIFT").alias("status"),
    )


def validate_dataset(
    df: DataFrame, reference: DataFrame | None = None, expected_end_year: int = END_YEAR,
    expected: Sequence[str] = REQUIRED_COLUMNS,
) -> ValidationReport:
    """All checks and the column statistics from one pass over the table."""
    checks = [
        *negative_count_checks(df), *capacity_checks(df), *missing_value_checks(df),
        *date_range_checks(df, expected_end_year),
    ]
    numeric = numeric_columns(df)
    day = _day(df) if "date" in df.columns else F.lit(None).cast("date")
    measured = df.agg(
        F.count(F.lit(1)).alias("n_rows"), F.min(day).alias("first_date"), F.max(day).alias("last_date"),
        *[c.measure.alias(f"m{i}") for i, c in enumerate(checks)],
        *[s for c in numeric for s in (
            F.min(c).cast("double").alias(f"{c}__min"), F.max(c).cast("double").alias(f"{c}__max"),
            F.avg(c).alias(f"{c}__mean"), F.stddev_samp(c).alias(f"{c}__std"),
        )],
    )
    # The three tables of the report share this row; the table is scanned once.
    measured = df.sparkSession.createDataFrame(measured.collect(), measured.schema)
    issues = _issues_of(measured, checks, missing_columns(df, expected))
    summary = (
        measured.select("n_rows", F.lit(len(df.columns)).alias("n_cols"), "first_date", "last_date")
        .withColumn("is_valid", F.lit(issues.where(F.col("severity") == "error").isEmpty()))
    )
    stats = rows_of(measured, *[
        F.struct(F.lit(c).alias("column"), *[F.col(f"{c}__{s}").alias(s) for s in ("min", "max", "mean", "std")])
        for c in numeric
    ])
    comparison = None
    if reference is not None:
        comparison = compare_stats(stats, column_stats(reference, [c for c in numeric if c in reference.columns]))
    return ValidationReport(summary, issues, stats, comparison)


def calendar_consistency(df: DataFrame) -> DataFrame:
    """Rows whose stored calendar columns differ from those of their date, and weekend counts."""
    dow = F.weekday("date")

    def wrong(stored: str, computed: Column) -> Column:
        return F.count_if(~F.col(stored).eqNullSafe(computed))

    return df.agg(
        wrong("dow", dow).alias("dow_mismatches"),
        wrong("month", F.month("date")).alias("month_mismatches"),
        wrong("day_of_week", day_name_of(dow)).alias("day_name_mismatches"),
        F.count_if(F.col("day_of_week").isin("Saturday", "Sunday")).alias("named_weekend_days"),
        F.count_if(dow >= 5).alias("computed_weekend_days"),
    )


RATIO_WORDS = ("rate", "pct", "ratio", "score")  # fixed values: name parts of ratio columns


def column_profile(df: DataFrame) -> DataFrame:
    """Semantic type, null rate, moments and distribution per column, from one pass.

    A numeric column is binary when its values are exactly 0 and 1, which its minimum, its
    maximum and the absence of other values show without a distinct count. The values of
    categorical columns are in ``categorical_values``, one row each.
    """
    fields = df.schema.fields

    measured = ["count(1) as n"]
    for f in fields:
        c = f"`{f.name}`"
        measured.append(f"count_if({c} is null) as `{f.name}__nulls`")
        if _is_number(f):
            x = f"cast({c} as int)" if isinstance(f.dataType, T.BooleanType) else c
            measured += [
                f"double(min({x})) as `{f.name}__min`", f"double(max({x})) as `{f.name}__max`",
                f"avg({x}) as `{f.name}__mean`", f"stddev_samp({x}) as `{f.name}__std`",
                f"count_if({x} not in (0, 1)) as `{f.name}__other`",
            ]
    row = df.agg(*[F.expr(m) for m in measured])
    return row.select(F.expr(f"inline(array({', '.join(_profile_row(i, f) for i, f in enumerate(fields))}))"))


def _is_number(f: T.StructField) -> bool:
    return f.name != "date" and isinstance(f.dataType, (T.NumericType, T.BooleanType))


def _profile_row(position: int, f: T.StructField) -> str:
    got = {s: f"`{f.name}__{s}`" for s in ("nulls", "min", "max", "mean", "std", "other")}
    if _is_number(f):
        if any(w in f.name for w in RATIO_WORDS):
            rest = "'ratio'"
        elif isinstance(f.dataType, T.IntegralType):
            rest = f"if({got['min']} >= 0, 'count', 'continuous')"
        else:
            rest = "'continuous'"
        kind = f"if({got['min']} = 0 and {got['max']} = 1 and {got['other']} = 0, 'binary', {rest})"
        poisson = f"{kind} = 'count' and {got['std']} * {got['std']} < {got['mean']} * 2"
        spread = f"if({poisson}, 'poisson', 'normal')"
        moments = [got[s] for s in ("min", "max", "mean", "std")]
    else:
        text = f.name != "date" and isinstance(f.dataType, T.StringType)
        kind, spread = ("'categorical'" if text else "'date'"), "string(null)"
        moments = ["double(null)"] * 4
    stats = ", ".join(f"{m} as {s}" for m, s in zip(moments, ("min", "max", "mean", "std")))
    return (
        f"struct({position} as position, '{f.name}' as column, {kind} as type, '{f.dataType.simpleString()}' as dtype, "
        f"try_divide({got['nulls']}, n) as na_rate, {stats}, {spread} as distribution)"
    )


def categorical_values(df: DataFrame) -> DataFrame:
    """The distinct values of the categorical columns: ``(column, value, rows)``."""
    columns = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType) and f.name != "date"]
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("value")) for c in columns])
    return (
        df.select(F.inline(pairs)).where(F.col("value").isNotNull())
        .groupBy("column", "value").agg(F.count(F.lit(1)).alias("rows"))
    )


MAIN_COLUMNS = ["total_admissions", "available_beds", "available_staff"]


@dataclass(frozen=True)
class DatasetAnalysis:
    """``columns_by_type`` maps a semantic type to its columns in table order."""

    profile: DataFrame
    values: DataFrame
    columns_by_type: dict[str, list[str]]
    correlations: DataFrame


def analyze_dataset(df: DataFrame, main: Sequence[str] = MAIN_COLUMNS) -> DatasetAnalysis:
    """Profile, values, columns by type and the correlations of the main columns."""
    profile = column_profile(df)
    rows = profile.orderBy("position").collect()  # one row per column
    profile = df.sparkSession.createDataFrame(rows, profile.schema)
    by_type: dict[str, list[str]] = {}
    for r in rows:
        by_type.setdefault(r["type"], []).append(r["column"])
    wanted = list(dict.fromkeys([*main, *by_type.get("count", [])[:5]]))
    numeric = set(numeric_columns(df))
    return DatasetAnalysis(
        profile, categorical_values(df), by_type, correlations(df, [c for c in wanted if c in numeric]),
    )
