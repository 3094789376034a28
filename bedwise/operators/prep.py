"""Cleaning, calendar columns, load features and the chronological split."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bedwise.functions.columns import calendar_fields
from bedwise.functions.quantiles import exact_quantiles
from bedwise.schema import CATEGORY_COLUMNS, EVENT_FLAG_COLUMNS, numeric_columns, string_columns
from bedwise.settings import CSV, FEATURE_COLUMNS, MODEL
from bedwise.sources.work import written


def clean_data(df: DataFrame) -> DataFrame:
    """Drop rows equal in all columns; give categories and event flags their types."""
    casts = {c: F.col(c).cast("string") for c in CATEGORY_COLUMNS if c in df.columns}
    casts |= {c: F.col(c).cast("int") for c in EVENT_FLAG_COLUMNS if c in df.columns}
    return df.dropDuplicates().withColumns(casts)


def add_temporal_features(df: DataFrame) -> DataFrame:
    if "date" not in df.columns:
        return df
    if isinstance(df.schema["date"].dataType, T.StringType):
        # The tables' own format first, then ISO.
        df = df.withColumn("date", F.coalesce(F.try_to_date("date", CSV.date_pattern), F.try_to_date("date")))
    return df.withColumns(calendar_fields(F.col("date")))


def column_modes(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Most frequent value per string column; ties go to the smallest. ``(column, value)``."""
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("value")) for c in columns])
    return (
        df.select(F.inline(pairs)).where(F.col("value").isNotNull())
        .groupBy("column", "value").count()
        .groupBy("column")
        .agg(F.min(F.struct((-F.col("count")).alias("rank"), "value")).alias("top"))
        .select("column", F.col("top.value").alias("value"))
    )


def column_medians(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Exact median per numeric column: ``(column, value)``."""
    return exact_quantiles(df, columns, [0.5]).select("column", "value")


def fill_missing_values(df: DataFrame) -> DataFrame:
    """Nulls become the column median (numeric) or mode (string) over all rows.

    The fill values are fitted first, one row per column: one job finds the columns with nulls, one their
    medians and modes. An integer column whose median has a fraction becomes double. All-null columns stay as they are.
    """
    numeric, text = numeric_columns(df), string_columns(df)
    if not numeric and not text:
        return df
    nulls = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in numeric + text]).first()
    numeric = [c for c in numeric if nulls[c]]
    text = [c for c in text if nulls[c]]
    medians = [column_medians(df, numeric).select("column", F.col("value").alias("number"), F.lit(None).cast("string").alias("word"))] if numeric else []
    modes = [column_modes(df, text).select("column", F.lit(None).cast("double").alias("number"), F.col("value").alias("word"))] if text else []
    if not medians + modes:
        return df
    fills: dict[str, Column] = {}
    for column, number, word in reduce(DataFrame.unionAll, medians + modes).collect():
        if column in text:
            fills[column] = F.coalesce(F.col(column), F.lit(word))
            continue
        keep = not isinstance(df.schema[column].dataType, T.IntegralType) or number == int(number)
        type_ = df.schema[column].dataType if keep else T.DoubleType()
        fills[column] = F.coalesce(F.col(column).cast(type_), F.lit(number).cast(type_))
    return df.withColumns(fills)


def preprocess_data(df: DataFrame, add_time_features: bool = True, fill_missing: bool = True) -> DataFrame:
    df = clean_data(df)
    if add_time_features:
        df = add_temporal_features(df)
    # The fill values and the result read the rows without repeating the shuffle that drops equal ones, from a table
    # that outlives an executor and holds no storage of one.
    return fill_missing_values(written(df, "cleaned")) if fill_missing else df


def get_feature_columns(df: DataFrame | None = None, extra: Sequence[str] = ()) -> list[str]:
    """The model's feature columns, those of ``df`` only when it is given."""
    wanted = [*FEATURE_COLUMNS, *extra]
    return wanted if df is None else [c for c in wanted if c in df.columns]


def build_features(df: DataFrame) -> DataFrame:
    """Add the missing calendar columns and the three load features."""
    have = set(df.columns)
    new: dict[str, Column] = {}
    if "date" in have:
        fields = calendar_fields(F.col("date"))
        new |= {c: fields[c] for c in ("dow", "month") if c not in have}
        if "is_weekend" not in have:
            dow = F.col("dow") if "dow" in have else fields["dow"]
            new["is_weekend"] = (dow >= 5).cast("int")
    if {"available_staff", "staff_absence_rate"} <= have:
        new["effective_staff"] = F.col("available_staff") * (1 - F.col("staff_absence_rate"))
    if {"epidemic_level", "staff_absence_rate"} <= have:
        new["stress_indicator"] = F.col("epidemic_level") * F.col("staff_absence_rate")
    if "available_beds" in have:
        new["bed_utilization_proxy"] = F.try_divide(F.lit(1500.0), F.col("available_beds") + 1)
    return df.withColumns(new) if new else df


def prepare_model_data(df: DataFrame, target_col: str = MODEL.target) -> DataFrame:
    """Feature columns followed by the target where the table has one."""
    columns = get_feature_columns(df)
    return df.select(*columns, *([target_col] if target_col in df.columns else []))


def running_cut(counts: DataFrame, left: int) -> tuple[object, int, int] | None:
    """The key of ``counts (key, rows)`` that holds the row after the first ``left`` rows in key order, nulls last.

    Returns the key, how many rows of it are still among the first, and its rows. Keys are dealt out by ranges; the totals of
    the ranges (one row for each) name one range, and only that one is summed up key by key.
    """
    ranged = written(counts.repartitionByRange(F.asc_nulls_last("key")).withColumn("part", F.spark_partition_id()), "counts")
    for part, rows in sorted(ranged.groupBy("part").agg(F.sum("rows")).collect()):
        if left < rows:
            order = Window.partitionBy("part").orderBy(F.asc_nulls_last("key")).rowsBetween(Window.unboundedPreceding, 0)
            reached = ranged.where(F.col("part") == part).withColumn("reached", F.sum("rows").over(order))
            at = reached.where(F.col("reached") > left).orderBy("reached").first()
            return at["key"], left - (at["reached"] - at["rows"]), at["rows"]
        left -= rows
    return None


def split_rows(
    df: DataFrame, n_train: Callable[[int], int], date_column: str = "date", site_column: str = "hospital_id",
) -> tuple[DataFrame, DataFrame]:
    """The first ``n_train(n)`` of the ``n`` rows by (date, site), and the rest.

    Rows equal in date and site stand in the order of a hash of all columns; rows equal in all columns are
    interchangeable. The rows are computed once, into a table of the shared folder, which both parts filter. The cut is
    found in one count per (date, site); only where it falls between rows of one date and site are these read again.
    """
    rows = written(df, "rows")
    day, site = F.col(date_column).cast("date"), F.col(site_column) if site_column in df.columns else F.lit(None)
    days = written(rows.groupBy(day.alias("day"), site.alias("site")).agg(F.count(F.lit(1)).alias("rows")), "days")
    n = days.agg(F.sum("rows")).first()[0] or 0
    left, first, at = n_train(n), F.lit(False), F.lit(True)
    if left >= n:
        return rows, rows.limit(0)
    steps = [(day, lambda: days.groupBy(F.col("day").alias("key")))]
    if site_column in df.columns:
        steps.append((site, lambda: days.where(F.col("day").eqNullSafe(F.lit(key))).groupBy(F.col("site").alias("key"))))
    row_hash = F.xxhash64(*[F.col(f"`{c}`") for c in df.columns])
    bucket = F.shiftrightunsigned(row_hash, 48)
    steps.append((bucket, None))
    key = None
    for step, counts in steps:
        found = counts().agg(F.sum("rows").alias("rows")) if counts else rows.where(at).groupBy(step.alias("key")).agg(F.count(F.lit(1)).alias("rows"))
        key, left, _ = running_cut(found, left)
        before = step.isNotNull() if key is None else F.coalesce(step < F.lit(key), F.lit(False))
        first, at = first | (at & before), at & step.eqNullSafe(F.lit(key))
        if left == 0:
            return rows.where(first), rows.where(~first)
    later = ~(first | at)
    # Equal rows are one row with a count, so none has to be told from another.
    columns = [F.col(f"`{c}`") for c in df.columns]
    tied = rows.where(at).groupBy(*columns).agg(F.count(F.lit(1)).alias("_rows"))
    upto = F.sum("_rows").over(Window.partitionBy(bucket).orderBy(row_hash, *columns).rowsBetween(Window.unboundedPreceding, 0))
    tied = tied.withColumn("_train", F.greatest(F.lit(0), F.least("_rows", F.col("_rows") - upto + left)))
    times = lambda n: tied.withColumn("_again", F.explode(F.array_repeat(F.lit(0), n.cast("int")))).select(*columns)
    return rows.where(first).unionAll(times(F.col("_train"))), rows.where(later).unionAll(times(F.col("_rows") - F.col("_train")))


def rounded_down(test_size: float) -> Callable[[int], int]:
    """Training rows when their number is rounded down."""
    return lambda n: math.floor(n * (1 - test_size))


def rest_rounded_up(test_size: float) -> Callable[[int], int]:
    """Training rows when the number of test rows is rounded up."""
    return lambda n: n - math.ceil(n * test_size)


def get_train_test_split(
    df: DataFrame, test_size: float = MODEL.test_size, date_column: str = "date", site_column: str = "hospital_id",
) -> tuple[DataFrame, DataFrame]:
    """The first ``int(n * (1 - test_size))`` rows by (date, site) train, the rest test."""
    return split_rows(df, rounded_down(test_size), date_column, site_column)


def unshuffled_split(
    df: DataFrame, test_size: float = MODEL.test_size, date_column: str = "date", site_column: str = "hospital_id",
) -> tuple[DataFrame, DataFrame]:
    """As ``get_train_test_split``, with the size of the test part rounded up."""
    return split_rows(df, rest_rounded_up(test_size), date_column, site_column)


def union_all(tables: Sequence[DataFrame]) -> DataFrame:
    """Stack tables by column name; a column missing from one is null there."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)
