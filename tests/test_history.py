from datetime import date, timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from bedwise.operators import aggregates as A
from bedwise.operators import demand as G
from bedwise.operators import quality as V
from bedwise.operators import series as W
from bedwise.schema import DAILY_TYPES


def daily(spark, values, start=date(2024, 1, 1), site="A"):
    return spark.createDataFrame(
        [(site, start + timedelta(days=i), float(v)) for i, v in enumerate(values)], "hospital_id string, date date, total_admissions double")


def column(df, name):
    return [r[name] for r in df.orderBy("date").collect()]


def test_rolling_mean_and_naive_forecast_match_pandas(spark):
    values = [float(v) for v in np.random.default_rng(1).integers(300, 500, 40)]
    s = pd.Series(values)
    got = column(W.rolling_mean(daily(spark, values)), "rolling_mean")
    assert got[:6] == [None] * 6 and got[6:] == pytest.approx(list(s.rolling(7).mean()[6:]))
    naive = column(W.naive_forecast(daily(spark, values)), "naive_pred_total_admissions")
    assert naive == list(s.rolling(7, min_periods=1).mean().shift(1).fillna(400).astype(int))


def ledger(delivered):
    level, out = 72.0, [72.0]
    for d in delivered[1:]:
        level = min(max(level - 1.8 + (7.0 if d else 0), 40.0), 95.0)
        out.append(round(level, 1))
    return out


@pytest.mark.parametrize("share", [0.0, 0.1, 0.28, 0.9])
def test_stock_ledger_matches_the_recurrence_over_years(spark, share):
    rng = np.random.default_rng(3)
    delivered = [int(x) for x in rng.random(1200) < share]
    df = daily(spark, delivered).withColumn("supply_delivery_day", F.col("total_admissions").cast("int"))
    both = df.unionByName(df.withColumn("hospital_id", F.lit("B")))
    result = W.stock_ledger(both)
    assert set(result.columns) == {*df.columns, "medical_stock_level_pct"}
    for site in "AB":
        got = column(result.where(F.col("hospital_id") == site), "medical_stock_level_pct")
        assert got == pytest.approx(ledger(delivered))


def test_stock_ledger_of_several_rows_a_day_and_missing_days(spark):
    """Rows of one day share its level; a delivery in any of them is the day's."""
    rows = [("A", date(2023, 12, 29) + timedelta(days=k), d, v) for k in (0, 1, 2, 5, 6, 40) for v, d in enumerate([0, 1] if k in (2, 40) else [None, 0, 0])]
    rows += [("A", None, 1, 9), (None, date(2024, 1, 1), 1, 1), (None, date(2024, 1, 2), 1, 1)]
    found = W.stock_ledger(spark.createDataFrame(rows, "hospital_id string, date date, supply_delivery_day int, v int")).collect()
    assert len(found) == len(rows)
    levels = dict(zip((0, 1, 2, 5, 6, 40), ledger([0, 0, 1, 0, 0, 1])))
    for r in found:
        if r["date"] is None:
            assert r["medical_stock_level_pct"] is None
        elif r["hospital_id"] == "A":
            assert r["medical_stock_level_pct"] == levels[(r["date"] - date(2023, 12, 29)).days]
        else:
            assert r["medical_stock_level_pct"] == (72.0 if r["date"].day == 1 else 77.2)


def test_event_spells_cover_all_event_days(spark):
    levels = [0, 1, 1, 2, 0, 2, 2, 2, 0, 0, 1]
    df = daily(spark, levels).withColumn("epidemic_level", F.col("total_admissions").cast("int"))
    spells = [(r["start_date"].day, r["days"], r["level"]) for r in W.event_spells(df, "epidemic_level").orderBy("start_date").collect()]
    assert spells == [(2, 2, 1), (4, 1, 2), (6, 3, 2), (11, 1, 1)]


def test_series_helpers(spark):
    df = daily(spark, [1.0] * 400, date(2023, 6, 1))
    assert set(column(W.years_elapsed(df), "years_elapsed")) == {0, 1}
    assert column(W.day_index(df), "day_index") == list(range(400))
    assert W.last_rows(df, 90).agg(F.min("date")).first()[0] == date(2023, 6, 1) + timedelta(days=310)
    assert W.last_rows(df, 90, by=()).count() == 90
    assert set(column(W.centred(df, F.col("total_admissions"), "c"), "c")) == {0.0}


def test_weekly_resample_matches_pandas(spark):
    days = [date(2024, 1, 3), date(2024, 1, 7), date(2024, 1, 8), date(2024, 1, 30)]
    df = spark.createDataFrame([(d, float(i)) for i, d in enumerate(days)], "date date, v double")
    pdf = df.toPandas()
    pdf["date"] = pd.to_datetime(pdf["date"])
    for every, rule in (("week", "W"), ("month", "MS")):
        want = pdf.set_index("date").resample(rule).mean().reset_index()
        got = A.resample(df, every).orderBy("date").collect()
        assert [r["date"] for r in got] == [d.date() for d in want["date"]]
        assert [r["v"] for r in got] == [None if np.isnan(v) else pytest.approx(v) for v in want["v"]]


def test_correlations_are_pairwise_complete(spark):
    pdf = pd.DataFrame({"a": [1.0, 2, 3, 4, None], "b": [2.0, 1, None, 5, 6], "c": [7.0] * 5})
    df = spark.createDataFrame([tuple(None if v != v else v for v in r) for r in pdf.values.tolist()], "a double, b double, c double")
    got = {(r["x"], r["y"]): r["r"] for r in A.correlations(df, ["a", "b", "c"]).collect()}
    want = pdf.corr()
    assert got["a", "b"] == pytest.approx(want.loc["a", "b"]) and got["b", "a"] == got["a", "b"]
    assert got["a", "a"] == 1.0 and got["a", "c"] is None and got["c", "c"] is None


def test_top_correlations(spark):
    df = spark.createDataFrame([(f"v{i}", r) for i, r in enumerate([0.9, -0.8, 0.1, 0.2, 0.3, 0.4, 0.5, 0.0])], "variable string, r double")
    got = {(r["variable"], r["sign"]) for r in A.top_correlations(df).collect()}
    assert got == {("v0", "positive"), ("v3", "positive"), ("v4", "positive"), ("v5", "positive"), ("v6", "positive"), ("v1", "negative")}


def test_histogram_matches_numpy(spark):
    values = np.random.default_rng(5).normal(0, 1, 500)
    df = spark.createDataFrame([(float(v),) for v in values], "x double")
    counts, edges = np.histogram(values, 30)
    rows = A.histogram(df, "x").orderBy("bin").collect()
    assert [r["rows"] for r in rows] == list(counts)
    assert [r["lower"] for r in rows] == pytest.approx(list(edges[:-1]))
    same = A.histogram(spark.createDataFrame([(4.0,), (4.0,)], "x double"), "x").orderBy("bin").collect()
    assert [r["rows"] for r in same] == list(np.histogram([4.0, 4.0], 30)[0])


def test_kpi_block_and_metrics(spark):
    df = spark.createDataFrame([(100, 0.5), (300, 0.7)], "total_admissions int, bed_occupancy_rate double")
    row = A.kpi_block(df, F.col("total_admissions") > 200).first()
    assert (row["days"], row["avg_admissions"], row["admissions_delta"]) == (1, 300.0, 100.0)
    assert row["avg_occupancy_pct"] == pytest.approx(70.0)
    pairs = spark.createDataFrame([(10.0, 12.0), (20.0, 19.0), (30.0, 33.0)], "actual double, predicted double")
    m = A.regression_metrics(pairs, "actual", "predicted").first()
    assert (m["mae"], m["rmse"]) == (2.0, pytest.approx((14 / 3) ** 0.5)) and m["r2"] == pytest.approx(1 - 14 / 200)
    r = A.residual_stats(pairs).first()
    assert r["residual_mean"] == pytest.approx(-4 / 3) and r["within_10pct"] == pytest.approx(1 / 3)
    ratio = A.error_ratio_pct(A.regression_metrics(pairs, "actual", "predicted"), df).first()
    assert ratio["mape"] == pytest.approx(1.0)


def test_small_counts(spark):
    df = spark.createDataFrame([("01/02/2024", 1), ("31/02/2024", None), ("01/02/2024", 1)], "date string, x int")
    assert A.duplicate_count(df).first()[0] == 1
    assert A.unparseable_dates(df, pattern="dd/MM/yyyy").first()[0] == 1
    assert [tuple(r) for r in A.null_counts(df).collect()] == [("x", 1)]
    assert A.coverage(df).first()["hospitals"] == 1


# --- quality -------------------------------------------------------------------------------

def full_days(spark, n=31, end_year=2025):
    start = date(end_year, 12, 31) - timedelta(days=n - 1)
    df = daily(spark, [400.0] * n, start).drop("total_admissions")
    text = {"day_of_week", "season", "hospital_id", "date"}
    df = df.withColumns({c: F.lit(0.5).cast(t) for c, t in DAILY_TYPES.items() if c not in text})
    return G.with_calendar(df.withColumn("total_admissions", F.lit(400))).select(*DAILY_TYPES)


def test_valid_table_passes(spark):
    report = V.validate_dataset(full_days(spark))
    row = report.summary.first()
    assert row["is_valid"] and (row["n_rows"], row["n_cols"]) == (31, 30)
    assert report.issues.isEmpty()
    assert report.column_stats.count() == 26


def test_report_lists_issues_in_order(spark):
    df = full_days(spark, end_year=2023).drop("season").withColumns({
        "total_admissions": F.lit(-1), "bed_occupancy_rate": F.lit(1.2), "staff_absence_rate": F.lit(-0.1),
        "month": F.lit(None).cast("int"),
    })
    report = V.validate_dataset(df, df)
    assert not report.summary.first()["is_valid"]
    got = [(r["column"], r["issue_type"], r["severity"]) for r in report.issues.orderBy("ord").collect()]
    assert got == [
        ("schema", "missing_columns", "error"), ("total_admissions", "negative_values", "error"),
        ("bed_occupancy_rate", "constraint_violation", "warning"), ("staff_absence_rate", "out_of_range", "error"),
        ("month", "missing_values", "warning"), ("date", "incomplete_range", "error"),
    ]
    assert report.issues.where("ord = 0").first()["message"] == "Missing columns: season"
    statuses = {r["column"]: r["status"] for r in report.comparison.collect()}
    assert statuses["available_beds"] == "OK"


def test_presence_check_and_text_dates(spark):
    df = spark.createDataFrame([("31/12/2024",)], "date string")
    assert V.validate_column_presence(df, ["date"]).isEmpty()
    assert V.validate_column_presence(df, ["date", "x"]).first()["message"] == "Missing columns: x"
    assert V.validate_date_range(df).first()["message"] == "Data ends at 2024, expected 2025"
    assert V.validate_date_range(df, 2024).isEmpty()


def test_drift(spark):
    new = spark.createDataFrame([(10.0, 1.0), (20.0, 2.0)], "a double, b double")
    old = spark.createDataFrame([(12.0, 5.0), (18.0, 7.0)], "a double, b double")
    rows = {r["column"]: r for r in V.compare_with_reference(new, old).collect()}
    assert rows["a"]["status"] == "OK" and rows["a"]["mean_diff_pct"] == 0.0 and rows["a"]["gen_std"] == 7.07
    assert rows["b"]["status"] == "DRIFT" and rows["b"]["mean_diff_pct"] == 75.0


def test_drift_between_parts_of_one_table_reads_it_once(spark, tmp_path):
    rows = [(1, 10.0, 1.0), (1, 20.0, 2.0), (0, 12.0, 5.0), (0, 18.0, 7.0), (0, None, None), (None, 1e9, 1e9)]
    spark.createDataFrame(rows, "side int, a double, b double").write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    new = F.col("side") == 1
    parts = V.compare_parts(df, new, columns=["a", "b"])
    assert parts._jdf.queryExecution().executedPlan().toString().count("FileScan") == 1
    whole = V.compare_with_reference(df.where(new).select("a", "b"), df.where(~new).select("a", "b"))
    assert sorted(parts.collect()) == sorted(whole.select(parts.columns).collect())
    empty = V.compare_parts(df.limit(0), new, columns=["a"]).first()
    assert empty["gen_mean"] is None and empty["status"] == "DRIFT"


def test_profile_types(spark):
    df = spark.createDataFrame(
        [(date(2024, 1, 1), "a", 0, 0.5, 3, -1, 1.5, 0), (date(2024, 1, 2), "b", 1, 0.7, 5, 2, None, 0)],
        "date date, s string, flag int, some_rate double, n int, signed int, x double, zero int")
    got = {r["column"]: (r["type"], r["na_rate"], r["distribution"]) for r in V.column_profile(df).collect()}
    assert got == {
        "date": ("date", 0.0, None), "s": ("categorical", 0.0, None), "flag": ("binary", 0.0, "normal"),
        "some_rate": ("ratio", 0.0, "normal"), "n": ("count", 0.0, "poisson"), "signed": ("continuous", 0.0, "normal"),
        "x": ("continuous", 0.5, "normal"), "zero": ("count", 0.0, "normal"),
    }
    analysis = V.analyze_dataset(df, main=["n"])
    assert analysis.columns_by_type["count"] == ["n", "zero"]
    assert analysis.correlations.count() == 4 and analysis.values.count() == 2


# --- demand --------------------------------------------------------------------------------

EVENTS = "hospital_id string, date date, epidemic_level int, heatwave_event int, accident_event int, strike_level int"


def test_demand_relations(spark):
    df = spark.createDataFrame([("A", date(2024, 1, 1), 0, 0, 0, 0), ("A", date(2025, 7, 5), 2, 1, 1, 1)], EVENTS)
    demand = column(G.expected_demand(df), "expected_demand")
    assert demand[0] == int(400 * (1.12 * 1.12)) == 501
    assert demand[1] == int(min(400 * 1.008 * 0.88 * 0.88 * 1.2 * 1.06 * 1.4, 620))
    assert column(G.external_alert(df), "external_alert_level") == [0, 2]
    resources = G.available_resources(df).orderBy("date").collect()
    assert [(r["available_beds"], r["available_staff"]) for r in resources] == [(1450, 425), (1305, 370)]
    split = G.department_split(df.withColumn("total_admissions", F.lit(400))).orderBy("date").collect()
    assert (split[0]["emergency_admissions"], split[0]["pediatric_admissions"], split[0]["icu_admissions"]) == (155, 32, 20)
    assert (split[0]["scheduled_surgeries"], split[0]["ambulance_arrivals"]) == (42, 93)
    assert split[1]["icu_admissions"] == int(400 * (20 / 400) * 1.24) and split[1]["scheduled_surgeries"] == 15


def test_calibration_comes_from_the_reference(spark):
    df = spark.createDataFrame([("A", date(2024, 1, 1), 0, 0, 0, 0)], EVENTS)
    reference = spark.createDataFrame([(1300,), (1310,)], "available_beds int")
    row = G.available_resources(df, G.Calibration(reference)).first()
    assert (row["available_beds"], row["available_staff"]) == (1305, 425)


def test_calendar_spine_has_the_leap_day(spark):
    spine = G.calendar_spine(spark.createDataFrame([("A",), ("B",)], "hospital_id string"), date(2024, 2, 1), date(2024, 3, 1))
    assert spine.count() == 60 and spine.where(F.col("date") == date(2024, 2, 29)).count() == 2
