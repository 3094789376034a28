import numpy as np
import pytest
from pyspark.sql import functions as F

from bedwise.functions.quantiles import BINS, PARTS, bracket_counts, brackets, exact_quantiles, near_rank

PROBS = [0.0, 0.25, 0.5, 0.9, 1.0]


def expected(values):
    return {p: float(np.quantile(np.array(values, dtype=float), p)) for p in PROBS}


def got(df):
    return {r["p"]: r["value"] for r in df.collect()}


@pytest.mark.parametrize("values", [[3.0], [1.0, 2.0], [5.0, 1.0, 4.0, 2.0], [7.0] * 9 + [1.0]])
def test_small(spark, values):
    df = spark.createDataFrame([(v,) for v in values], "x double")
    assert got(exact_quantiles(df, ["x"], PROBS)) == pytest.approx(expected(values))


@pytest.mark.parametrize("accuracy", [100, 2000, 10_000])
def test_brackets_match_numpy(spark, accuracy):
    rng = np.random.default_rng(7)
    # A third of all rows hold one value; the rest is heavy-tailed.
    values = np.concatenate([np.full(20_000, 2.5), rng.lognormal(1.0, 2.0, 40_000)])
    df = spark.createDataFrame([(float(v),) for v in values], "x double").repartition(5)
    result = exact_quantiles(df, ["x"], PROBS, accuracy=accuracy)
    assert got(result) == pytest.approx(expected(values), rel=1e-12)


def test_many_groups_and_no_job_before_the_action(spark):
    df = spark.range(40_000).selectExpr("id % 5000 AS k", "cast(id * 7919 % 40009 AS double) AS x")
    before = spark.sparkContext.statusTracker().getJobIdsForGroup(None)
    result = exact_quantiles(df, ["x"], [0.25, 0.5], by=["k"])
    assert spark.sparkContext.statusTracker().getJobIdsForGroup(None) == before
    found = {(r["k"], r["p"]): r["value"] for r in result.collect()}
    assert len(found) == 10_000
    for k in (0, 17, 4999):
        values = [i * 7919 % 40009 for i in range(k, 40_000, 5000)]
        assert found[(k, 0.25)] == np.quantile(values, 0.25) and found[(k, 0.5)] == np.quantile(values, 0.5)


def test_groups_nulls_and_nan(spark):
    df = spark.createDataFrame(
        [(0, 1.0), (0, None), (0, 3.0), (1, float("nan")), (1, 10.0)], "k int, x double")
    rows = exact_quantiles(df, ["x"], [0.5], by=["k"]).collect()
    assert {(r["k"], r["column"]): r["value"] for r in rows} == {(0, "x"): 2.0, (1, "x"): 10.0}


def test_column_without_values_gives_no_row(spark):
    df = spark.createDataFrame([(1.0, None)], "a double, b double")
    assert [r["column"] for r in exact_quantiles(df, ["a", "b"], [0.5]).collect()] == ["a"]


@pytest.mark.parametrize("values", [
    [-1.7e308, 1.7e308, 0.0, 1.0, 2.0], [float("-inf"), 1.0, 2.0, 3.0, float("inf")], [5e-324, 0.0, 1e-323], [1.0, 1.0 + 2**-52, 1.0 + 2**-51],
])
def test_extreme_ranges(spark, values):
    df = spark.createDataFrame([(v,) for v in values], "x double")
    found = got(exact_quantiles(df, ["x"], [0.0, 0.5, 1.0]))
    ordered = sorted(values)
    assert found[0.5] == np.quantile(ordered, 0.5, method="inverted_cdf") and (found[0.0], found[1.0]) == (ordered[0], ordered[-1])


def test_windows_order_bins_and_a_few_values_not_a_bracket(spark):
    # A sketch this coarse brackets a large part of 60,000 distinct values.
    df = spark.range(60_000).selectExpr("cast(id * 7919 % 60013 AS double) AS x")
    ranks = brackets(df, ["x"], [0.25, 0.5], [], 20)
    counts = bracket_counts(df, ["x"], ranks, [])
    inside = counts.where("value IS NOT NULL").groupBy("p").count().collect()
    assert len(inside) == 2 and min(r["count"] for r in inside) > 5_000
    ordered = near_rank(counts, []).groupBy("p").count().collect()
    assert len(ordered) == 2 and max(r["count"] for r in ordered) <= 2 * (60_000 // BINS + 2)
    values = [i * 7919 % 60013 for i in range(60_000)]
    assert got(exact_quantiles(df, ["x"], [0.25, 0.5], accuracy=20)) == {p: np.quantile(values, p) for p in (0.25, 0.5)}


def test_values_of_one_column_are_dealt_over_many_tasks(spark):
    """The join of values and ranks, each sent to tasks by its keys: a column is not one key."""
    df = spark.range(20_000).select((F.col("id") * 7919 % 20_011).cast("double").alias("x"))
    off = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    old = {k: spark.conf.get(k) for k in off}
    try:
        for k, v in off.items():
            spark.conf.set(k, v)
        counts = bracket_counts(df, ["x"], brackets(df, ["x"], [0.5], [], 100), [])
        joins = [line for line in counts._jdf.queryExecution().executedPlan().toString().splitlines() if "Join [" in line]
        assert len(joins) == 1 and "part#" in joins[0] and PARTS > 1
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    got = exact_quantiles(df, ["x"], [0.25, 0.5]).orderBy("p").collect()
    assert [r["value"] for r in got] == df.selectExpr("percentile(x, array(0.25, 0.5)) AS q").first()["q"]
