from datetime import date

import pytest
from pyspark.sql import functions as F

from bedwise.operators.filters import contains_any, event_condition, on_event_days, with_priority
from bedwise.operators.prep import (
    add_temporal_features, build_features, clean_data, column_modes, fill_missing_values, get_feature_columns,
    get_train_test_split, prepare_model_data, preprocess_data, union_all, unshuffled_split,
)
from bedwise.settings import FEATURE_COLUMNS

RAW = "date date, total_admissions int, temperature_c double, day_of_week string, season string, heatwave_event bigint"


@pytest.fixture
def raw(spark):
    d = date
    return spark.createDataFrame([
        (d(2023, 1, 1), 100, 5.0, "Sunday", None, 0), (d(2023, 1, 2), 120, None, "Monday", "Winter", 0),
        (d(2023, 1, 3), 110, 5.5, "Tuesday", "Winter", 1), (d(2023, 1, 3), 110, 5.5, "Tuesday", "Winter", 1),
    ], RAW)


def test_clean_data(raw):
    cleaned = clean_data(raw)
    assert cleaned.count() == 3
    assert dict(cleaned.dtypes)["heatwave_event"] == "int"
    assert dict(cleaned.dtypes)["season"] == "string"


def test_temporal_features(raw):
    row = add_temporal_features(clean_data(raw)).orderBy("date").first()
    assert (row["dow"], row["is_weekend"], row["year"], row["month"], row["day"]) == (6, 1, 2023, 1, 1)
    assert (row["week"], row["day_of_year"]) == (52, 1)


def test_temporal_features_need_a_date(spark):
    df = spark.createDataFrame([(1,)], "x int")
    assert add_temporal_features(df).columns == ["x"]


def test_null_date_gives_null_calendar(spark):
    row = add_temporal_features(spark.createDataFrame([("nonsense",)], "date string")).first()
    assert row["date"] is None and row["week"] is None and row["dow"] is None


def test_fill_missing_values(raw):
    rows = fill_missing_values(clean_data(raw)).orderBy("date").collect()
    assert rows[1]["temperature_c"] == 5.25
    assert rows[0]["season"] == "Winter"


def test_fill_keeps_all_null_columns_and_widens_integers(spark):
    df = spark.createDataFrame([(1, None, None), (2, None, None), (None, None, None)], "a int, b double, c string")
    filled = fill_missing_values(df)
    assert dict(filled.dtypes)["a"] == "double"
    assert sorted(r["a"] for r in filled.collect()) == [1.0, 1.5, 2.0]
    assert {r["b"] for r in filled.collect()} == {None} == {r["c"] for r in filled.collect()}


def test_mode_ties_go_to_the_smallest(spark):
    df = spark.createDataFrame([("b",), ("a",), ("b",), ("a",), ("c",), (None,)], "s string")
    assert column_modes(df, ["s"]).collect()[0]["value"] == "a"


def test_preprocess(raw):
    df = preprocess_data(raw)
    assert df.count() == 3
    assert {"year", "is_weekend"} <= set(df.columns)
    assert df.where(F.col("temperature_c").isNull() | F.col("season").isNull()).isEmpty()
    assert "year" not in preprocess_data(raw, add_time_features=False).columns


def test_load_features(spark):
    df = spark.createDataFrame([(date(2023, 1, 7), 400, 0.1, 2, 1499)],
                               "date date, available_staff int, staff_absence_rate double, epidemic_level int, available_beds int")
    row = build_features(df).first()
    assert row["effective_staff"] == pytest.approx(360.0)
    assert row["stress_indicator"] == pytest.approx(0.2)
    assert row["bed_utilization_proxy"] == 1.0
    assert (row["dow"], row["month"], row["is_weekend"]) == (5, 1, 1)


def test_feature_columns(spark):
    df = spark.createDataFrame([(1, 2, 3)], "dow int, other int, total_admissions int")
    assert get_feature_columns() == FEATURE_COLUMNS and len(FEATURE_COLUMNS) == 17
    assert get_feature_columns(df) == ["dow"]
    assert prepare_model_data(df).columns == ["dow", "total_admissions"]
    assert prepare_model_data(df.drop("total_admissions")).columns == ["dow"]


def test_split_of_three_rows(raw):
    train, test = get_train_test_split(preprocess_data(raw), test_size=0.33)
    assert (train.count(), test.count()) == (2, 1)
    assert test.first()["date"] == date(2023, 1, 3)


@pytest.fixture
def network(spark):
    """Ten days of 37 sites, one of them with extra letters, and one undated row."""
    days = spark.range(10).select(F.date_add(F.lit(date(2024, 1, 1)), F.col("id").cast("int")).alias("date"))
    sites = spark.createDataFrame([(f"S{i}",) for i in range(36)] + [("S1x",)], "hospital_id string")
    return days.join(sites, F.lit(True)).unionByName(spark.createDataFrame([(None, "S1")], "date date, hospital_id string"))


@pytest.mark.parametrize("size", [0.2, 0.1, 0.37, 0.999])
def test_split_is_exact_and_ordered(network, size):
    rows = sorted(network.collect(), key=lambda r: (r["date"] is None, r["date"] or date.max, r["hospital_id"]))
    for split, cut in ((get_train_test_split, int(len(rows) * (1 - size))), (unshuffled_split, len(rows) - -int(-len(rows) * size // 1))):
        train, test = split(network, size)
        assert sorted(train.collect()) == sorted(rows[:cut])
        assert train.count() + test.count() == len(rows)


def test_split_of_nothing_and_everything(network):
    train, test = get_train_test_split(network, 0.0)
    assert (train.count(), test.count()) == (371, 0)
    train, test = get_train_test_split(network, 1.0)
    assert (train.count(), test.count()) == (0, 371)


@pytest.mark.parametrize("with_site", [True, False])
def test_split_cuts_tied_and_equal_rows(spark, with_site):
    rows = [(date(2024, 1, 1 + d), "S1", v) for d in range(10) for v in (1, 1, 1, 1, 2)]
    df = spark.createDataFrame(rows, "date date, hospital_id string, v int")
    df = df if with_site else df.drop("hospital_id")
    train, test = get_train_test_split(df, 0.25)
    assert (train.count(), test.count()) == (37, 13)
    assert sorted(map(str, train.unionAll(test).collect())) == sorted(map(str, df.collect()))
    assert train.agg({"date": "max"}).first()[0] <= test.agg({"date": "min"}).first()[0]


def test_split_computes_its_input_once_and_plans_cheaply(spark):
    """The parts filter a written table: no lineage, and no window over all rows."""
    seen = spark.sparkContext.accumulator(0)

    def count(rows):
        for batch in rows:
            seen.add(batch.num_rows)
            yield batch

    days = spark.range(2000).selectExpr("date_add(date'2020-01-01', cast(id % 300 as int)) AS date", "concat('S', id % 5) AS hospital_id", "id AS v")
    train, test = get_train_test_split(days.mapInArrow(count, days.schema), 0.2)
    assert (train.count(), test.count()) == (1600, 400)
    assert seen.value == 2000
    plan = train.where("v IS NOT NULL").select("v")._jdf.queryExecution().executedPlan().toString()
    assert "InArrow" not in plan and "SinglePartition" not in plan


def test_split_of_null_dates_and_sites(spark):
    rows = [(d and date(2024, 1, d), s, v) for d in (None, 1, 2) for s in (None, "A", "B") for v in range(4)]
    df = spark.createDataFrame(rows, "date date, hospital_id string, v int")
    for size in (0.1, 0.4, 0.5, 0.9):
        train, test = get_train_test_split(df, size)
        order = sorted(rows, key=lambda r: (r[0] is None, r[0] or date.min, r[1] is None, r[1] or ""))
        cut = int(len(rows) * (1 - size))
        assert sorted((str(r[:2]) for r in map(tuple, train.collect()))) == sorted(str(r[:2]) for r in order[:cut])
        assert sorted(map(str, train.unionAll(test).collect())) == sorted(map(str, df.collect()))


def test_split_takes_days_of_timestamps(spark):
    df = spark.sql("SELECT timestamp'2024-01-01 00:00:00' + make_interval(0, 0, 0, 0, cast(id as int)) AS date, 'S' AS hospital_id FROM range(100)")
    train, test = get_train_test_split(df, 0.3)
    assert (train.count(), test.count()) == (70, 30)


def test_string_dates_in_the_tables_own_format(spark):
    df = add_temporal_features(spark.createDataFrame([("31/12/2023",), ("2024-01-02",), ("x",)], "date string"))
    assert [r["date"] for r in df.collect()] == [date(2023, 12, 31), date(2024, 1, 2), None]


def test_union_keeps_missing_columns(spark):
    df = union_all([spark.createDataFrame([(1,)], "a int"), spark.createDataFrame([(2, 3)], "b int, a int")])
    assert sorted((r["a"], r["b"]) for r in df.collect() if r["b"]) == [(3, 2)]
    assert df.count() == 2


def test_event_filter_is_any_of(spark):
    df = spark.createDataFrame([(1, 0), (0, 1), (0, 0), (None, None)], "epidemic_level int, heatwave_event int")
    assert on_event_days(df, ["epidemic", "heatwave"]).count() == 2
    assert on_event_days(df, []).count() == 4
    assert event_condition(df, ["strike"]) is None


def test_text_and_priority_filters(spark):
    df = spark.createDataFrame([("Ajouter des LITS",), (None,), ("autre",)], "action string")
    assert [r[0] for r in df.select(contains_any("action", "lits")).collect()] == [True, False, False]
    p = spark.createDataFrame([("HAUTE",), ("BASSE",)], "priority string")
    assert with_priority(p, ["HAUTE"]).count() == 1 and with_priority(p, []).count() == 2
