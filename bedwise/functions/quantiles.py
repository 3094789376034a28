"""Exact quantiles by one plan for every size, without collecting anything.

One aggregation takes a mergeable sketch per (group, column), which brackets each wanted rank. A second
pass counts the rows below a bracket and groups the values inside it: a few ten-thousandths of the
rows of a group, spread over all tasks. A bracket is cut into BINS bins; running counts over the bins, which
are few, name the one or two that hold the rank, and only their values are put in order. Groups, brackets
and counts stay in DataFrames, however many keys there are.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The sketch's rank error is at most rows / ACCURACY.
ACCURACY = 10_000
# A bracket's bins: the rows that one window orders to find the bin of a rank.
BINS = 4096
# Parts that the values of a column are dealt over to meet their ranks, where no group spreads them.
PARTS = 64
_LARGEST = 1.7976931348623157e308


def _is_value(c: str):
    return F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double"))


def long_values(df: DataFrame, columns: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """``(by..., column, value)`` for the non-null values of numeric columns."""
    pairs = F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("value")) for c in columns
    ])
    return df.select(*by, F.inline(pairs)).where(_is_value("value"))


def brackets(
    df: DataFrame, columns: Sequence[str], probabilities: Sequence[float], by: Sequence[str], accuracy: int,
) -> DataFrame:
    """``(by..., column, n, p, lo, hi)``: values between which the rank p * (n - 1) lies for certain."""
    margin = 2 / accuracy
    marks = [max(0.0, p - margin) for p in probabilities] + [min(1.0, p + margin) for p in probabilities]
    sketches = df.groupBy(*by).agg(*[
        F.struct(
            F.count_if(_is_value(c)).alias("n"),
            F.percentile_approx(F.when(_is_value(c), F.col(c).cast("double")), marks, accuracy).alias("marks"),
            F.min(F.when(_is_value(c), F.col(c).cast("double"))).alias("low"),
            F.max(F.when(_is_value(c), F.col(c).cast("double"))).alias("high"),
        ).alias(f"_{i}")
        for i, c in enumerate(columns)
    ])
    per = sketches.select(*by, F.inline(F.array(*[
        F.struct(F.lit(c).alias("column"), *[F.col(f"_{i}.{x}").alias(x) for x in ("n", "marks", "low", "high")])
        for i, c in enumerate(columns)
    ]))).where("n > 0")
    # The margin covers the sketch's error once it is more than a row or two; below, all values are inside.
    sure = F.col("n") >= 2 * accuracy
    k = len(probabilities)
    return per.select(*by, "column", "n", F.inline(F.array(*[
        F.struct(
            F.lit(float(p)).alias("p"),
            F.when(sure & F.lit(p > margin), F.col("marks")[i]).otherwise(F.col("low")).alias("lo"),
            F.when(sure & F.lit(p < 1 - margin), F.col("marks")[k + i]).otherwise(F.col("high")).alias("hi"),
        )
        for i, p in enumerate(probabilities)
    ])))


def _bin() -> Column:
    """The bin of ``value`` between ``lo`` and ``hi``, never falling with the value; -1 for what lies below.

    Halves of finite values keep the differences finite.
    """
    x, lo, hi = (F.greatest(F.least(F.col(c), F.lit(_LARGEST)), F.lit(-_LARGEST)) / 2 for c in ("value", "lo", "hi"))
    place = F.floor(F.try_divide(x - lo, hi - lo) * BINS)
    return F.when(F.col("value").isNull(), -1).otherwise(F.least(F.coalesce(place, F.lit(0)), F.lit(BINS - 1))).cast("int")


def bracket_counts(df: DataFrame, columns: Sequence[str], ranks: DataFrame, by: Sequence[str]) -> DataFrame:
    """``(by..., column, p, n, value, bin, c)``: rows per value inside a bracket. What lies below is one row without a value."""
    keys, values, on = [*by, "column"], long_values(df, columns, by), [*by, "column"]
    if not by:  # else one task per column would read all its values
        values = values.withColumn("part", F.pmod(F.xxhash64("value"), F.lit(PARTS)).cast("int"))
        ranks, on = ranks.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1)))), [*on, "part"]
    return (
        values.join(ranks, on).where(F.col("value") <= F.col("hi"))
        .groupBy(*keys, "p", "n", "lo", "hi", F.when(F.col("value") >= F.col("lo"), F.col("value")).alias("value"))
        .agg(F.count(F.lit(1)).alias("c"))
        .select(*keys, "p", "n", "value", _bin().alias("bin"), "c")
    )


def near_rank(counts: DataFrame, by: Sequence[str]) -> DataFrame:
    """The rows of ``counts`` in the bins that hold the two ranks, with the number of rows ``before`` these bins."""
    keys = [*by, "column", "p"]
    position = F.col("p") * (F.col("n") - 1)
    order = Window.partitionBy(*keys).orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    bins = counts.groupBy(*keys, "n", "bin").agg(F.sum("c").alias("c")).withColumn("reached", F.sum("c").over(order))
    # No row lies between the two ranks, so the bins between theirs are empty.
    found = bins.groupBy(*keys).agg(
        F.min(F.when(F.col("reached") > F.floor(position), F.struct("bin", (F.col("reached") - F.col("c")).alias("before")))).alias("a"),
        F.min(F.when(F.col("reached") > F.ceil(position), F.col("bin"))).alias("b"),
    ).select(*[F.col(k).alias(f"_{k}") for k in keys], F.col("a.bin").alias("a"), "b", F.col("a.before").alias("before"))
    same = reduce(and_, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys])
    return counts.join(found, same).where(F.col("bin").between(F.col("a"), F.col("b"))).select(*counts.columns, "before")


def exact_quantiles(
    df: DataFrame,
    columns: Sequence[str],
    probabilities: Sequence[float],
    by: Sequence[str] = (),
    accuracy: int = ACCURACY,
) -> DataFrame:
    """Linearly interpolated quantiles: ``(by..., column, p, value)``. Columns without values give no row."""
    keys = [*by, "column"]
    ranks = brackets(df, columns, probabilities, by, accuracy)
    near = near_rank(bracket_counts(df, columns, ranks, by), by)
    order = Window.partitionBy(*keys, "p").orderBy("value").rowsBetween(Window.unboundedPreceding, 0)
    position = F.col("p") * (F.col("n") - 1)
    return (
        near.withColumn("reached", F.col("before") + F.sum("c").over(order))
        .groupBy(*keys, "p")
        .agg(
            F.min(F.when(F.col("reached") > F.floor(position), F.col("value"))).alias("a"),
            F.min(F.when(F.col("reached") > F.ceil(position), F.col("value"))).alias("b"),
            F.first(position - F.floor(position)).alias("part"),
        )
        .select(*keys, "p", F.when(F.col("a") == F.col("b"), F.col("a")).otherwise(F.col("a") + (F.col("b") - F.col("a")) * F.col("part")).alias("value"))
    )
