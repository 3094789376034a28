from datetime import date, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from bedwise.plans import actions as R
from bedwise.plans import baseline as B
from bedwise.plans import forecast as M
from bedwise.plans import learning as L
from bedwise.plans import scenarios as X
from bedwise.settings import FEATURE_COLUMNS


def forecast_frame(spark, values=(400, 410, 420, 415, 405, 380, 370)):
    start = date(2024, 1, 1)
    return spark.createDataFrame(
        [(start + timedelta(days=i), v) for i, v in enumerate(values)], "date date, predicted_admissions int")


def admissions(df):
    return [r["scenario_admissions"] for r in df.orderBy("date").collect()]


def test_reference_scenario_is_the_identity(spark):
    df = X.apply_scenario(forecast_frame(spark), X.ScenarioParams())
    assert admissions(df) == [400, 410, 420, 415, 405, 380, 370]
    row = df.orderBy("date").first()
    assert (row["effective_capacity"], row["capacity_gap"], row["effective_stock_pct"]) == (450, -50, 75)
    assert not row["is_overcapacity"] and row["demand_change_pct"] == 0


def test_epidemic_raises_demand(spark):
    assert admissions(X.apply_scenario(forecast_frame(spark), X.ScenarioParams(epidemic_intensity=50)))[0] == 600


def test_shock_hits_one_day(spark):
    got = admissions(X.apply_scenario(forecast_frame(spark), X.ScenarioParams(shock_day_spike=50, shock_day_index=2)))
    assert got == [400, 410, 630, 415, 405, 380, 370]
    outside = X.apply_scenario(forecast_frame(spark), X.ScenarioParams(shock_day_spike=50, shock_day_index=9))
    assert admissions(outside)[0] == 400
    assert X.shock_index(date(2024, 1, 4), date(2024, 1, 1)) == 3


def test_bed_term_limits_capacity(spark):
    row = X.apply_scenario(forecast_frame(spark), X.ScenarioParams(beds_reduction=70)).first()
    assert row["effective_capacity"] == pytest.approx(1450 * 0.3 * 0.85)


def test_all_presets_in_one_plan_equal_single_runs(spark):
    df = forecast_frame(spark)
    together = X.apply_scenarios(df)
    assert together.count() == 7 * 7
    for name, params in X.create_preset_scenarios().items():
        one = X.apply_scenario(df, params)
        part = together.where(F.col("scenario") == name).select(*one.columns)
        assert sorted(part.collect()) == sorted(one.collect()), name


def test_params_from_and_to_dict(spark):
    p = X.ScenarioParams.from_dict({"epidemic_intensity": 5, "unknown": 1})
    assert p == X.ScenarioParams(epidemic_intensity=5)
    assert X.ScenarioParams.from_dict(p.to_dict()) == p
    assert X.scenario_table(spark, X.PRESETS).count() == 7


def test_scenario_summary(spark):
    df = spark.createDataFrame(
        [(400, False, False, -50, 0.7), (500, True, False, 50, 0.9), (600, True, True, 150, 1.1)],
        "scenario_admissions int, is_overcapacity boolean, is_critical boolean, capacity_gap int, occupancy_rate double")
    row = X.summarize_scenario_impact(df).first()
    assert (row["avg_daily_admissions"], row["max_daily_admissions"]) == (500, 600)
    assert (row["days_overcapacity"], row["days_critical"], row["max_capacity_gap"]) == (2, 1, 150)


def test_detail_table(spark):
    row = X.detail_table(X.apply_scenario(forecast_frame(spark), X.PRESETS["Épidémie Sévère"])).orderBy("Date").first()
    assert (row["Date"], row["Référence"], row["Scénario"], row["Capacité"], row["Écart"]) == ("01/01/2024", 400, 560, 382, 178)
    assert (row["Occupation"], row["row_flag"]) == ("38.6%", "overcapacity")


# --- actions ---------------------------------------------------------------------------------

COLUMNS = ("date date, capacity_gap double, occupancy_rate double, effective_staff double, effective_stock_pct double, "
           "is_overcapacity boolean, is_critical boolean")


def days(spark, *rows):
    return spark.createDataFrame([(date(2024, 1, 1) + timedelta(days=i), *map(float, r[:4]), *r[4:]) for i, r in enumerate(rows)], COLUMNS)


def rules(df):
    rows = R.generate_recommendations(df).orderBy("date", "ord").collect()
    return [(r["date"].day, r["ord"], r["priority"], r["quantity"], r["unit"]) for r in rows]


def test_calm_days_are_monitored(spark):
    df = days(spark, (-100, 0.6, 430, 75, False, False), (-90, 0.65, 430, 75, False, False))
    assert rules(df) == [(1, 10, "BASSE", None, None), (2, 10, "BASSE", None, None)]


def test_crisis_days(spark):
    df = days(spark, (100, 0.95, 300, 40, True, True), (150, 1.0, 280, 35, True, True))
    assert rules(df) == [
        (1, 1, "CRITIQUE", 111.0, "lits"), (1, 2, "CRITIQUE", 30.0, "transferts"), (1, 5, "HAUTE", 400.0, "heures"),
        (1, 8, "MOYENNE", 30.0, "% stock"), (1, 9, "HAUTE", None, None),
        (2, 1, "CRITIQUE", 165.0, "lits"), (2, 2, "CRITIQUE", 45.0, "transferts"), (2, 4, "CRITIQUE", 116.0, "personnel"),
        (2, 8, "HAUTE", 35.0, "% stock"), (2, 9, "HAUTE", None, None),
    ]
    text = [r["description"] for r in R.generate_recommendations(df).orderBy("date", "ord").collect()]
    assert text[0] == "Activer le protocole de surcharge - 100 au-dessus de la capacité" and text[3] == "Fournitures à 40%"


def test_mixed_days_and_boundaries(spark):
    df = days(spark, (-50, 0.7, 430, 75, False, False), (50, 0.9, 350, 45, True, True), (0, 0.8, 400, 60, False, False))
    assert rules(df) == [
        (1, 10, "BASSE", None, None),
        (2, 3, "HAUTE", 56.0, "lits"), (2, 5, "HAUTE", 240.0, "heures"), (2, 8, "MOYENNE", 25.0, "% stock"), (2, 9, "HAUTE", None, None),
        (3, 6, "MOYENNE", 80.0, "% occupation"),
    ]


def test_staff_ratio_boundaries_in_doubles(spark):
    cut = lambda pct: 425 * (1 - pct / 100)
    df = days(spark, (-1, 0.1, cut(30), 75, False, False), (-1, 0.1, cut(15), 75, False, False))
    assert rules(df) == [(1, 5, "HAUTE", 408.0, "heures"), (2, 10, "BASSE", None, None)]


def test_absent_columns_mean_an_uneventful_day(spark):
    df = spark.createDataFrame([(date(2024, 1, 1),)], "date date")
    assert rules(df) == [(1, 10, "BASSE", None, None)]
    assert R.generate_recommendations(df.limit(0)).columns == R.RECOMMENDATION_COLUMNS


def recs(spark):
    return spark.createDataFrame(
        [("2024-01-03", "A", "BASSE"), ("2024-01-02", "B", "HAUTE"), ("2024-01-01", "C", "CRITIQUE"), ("2024-01-02", "D", "CRITIQUE"), ("2024-01-02", "E", "?")],
        "date string, action string, priority string")


def test_priority_actions_and_summary(spark):
    assert [r["action"] for r in R.get_priority_actions(recs(spark)).collect()] == ["C", "D", "B"]
    assert R.get_priority_actions(recs(spark), "BASSE").count() == 5
    row = R.summarize_recommendations(recs(spark)).first()
    assert tuple(row) == (5, 2, 1, 2)
    assert R.alert_level(R.summarize_recommendations(recs(spark))).first()["alert"] == "alert"
    assert {r["priority"]: r["actions"] for r in R.count_by_priority(recs(spark)).collect()}["CRITIQUE"] == 2
    assert {r["action"]: r["priority_value"] for r in R.action_timeline(recs(spark)).collect()} == {"A": 1, "B": 3, "C": 4, "D": 4, "E": None}


def test_resource_needs(spark):
    df = days(spark, (100, 0.95, 300, 40, True, True), (20, 0.5, 350, 75, True, False))
    row = R.resource_needs(R.generate_recommendations(df)).first()
    assert (row["extra_beds"], row["bed_actions"]) == (22.0, 1)  # surge beds carry another wording
    assert (row["overtime_hours"], row["staff_actions"], row["stock_alerts"]) == (640.0, 2, 1)
    units = {r["unit"]: r["quantity"] for r in R.needs_by_unit(R.generate_recommendations(df)).collect()}
    assert units["lits"] == 111 + 22


def test_report_reads_top_to_bottom(spark):
    df = R.generate_recommendations(days(spark, (100, 0.95, 300, 75, True, False)))
    lines = R.action_report(df, "Test", X.ScenarioParams(epidemic_intensity=15).to_dict(), date(2024, 1, 1), 14, "01/01/2024 08:00")
    text = [r["line"] for r in lines.orderBy("section", "date", "ord", "part").collect()]
    assert text[0] == "RAPPORT D'ACTIONS" and "Période : 01/01/2024 au 14/01/2024" in text
    assert "- Actions Critiques : 2" in text and "- Jours avec Problèmes : 1/14" in text and "- Intensité Épidémique : +15%" in text
    assert text.index("ACTIONS CRITIQUES") < text.index("[01/01/2024] Activer le protocole de surcharge") < text.index("ACTIONS PRIORITÉ HAUTE")


# --- baseline, forecast, forest ----------------------------------------------------------------

def history(spark, sites=("A", "B"), n=400):
    start = date(2023, 1, 1)
    rows = [(s, start + timedelta(days=i), 100.0 * (k + 1) + (start + timedelta(days=i)).weekday() * 5) for k, s in enumerate(sites) for i in range(n)]
    return spark.createDataFrame(rows, "hospital_id string, date date, total_admissions double")


def test_baseline_uses_weekday_and_month(spark):
    df = history(spark)
    baseline = B.train_baseline(df, by=["hospital_id"])
    future = M.days_after(df, 7)
    rows = B.predict_baseline(baseline, future, ["hospital_id"]).orderBy("hospital_id", "date").collect()
    assert len(rows) == 14 and rows[0]["date"] == date(2023, 1, 1) + timedelta(days=400)
    pdf = df.where("hospital_id = 'A'").toPandas()
    pdf["d"], pdf["m"] = [d.weekday() for d in pdf["date"]], [d.month for d in pdf["date"]]
    day = rows[0]["date"]
    want = (pdf[pdf.d == day.weekday()].total_admissions.mean() + pdf[pdf.m == day.month].total_admissions.mean()) / 2
    assert rows[0]["predicted_admissions"] == pytest.approx(want)


def test_in_sample_predictions_equal_the_fitted_baseline(spark):
    df = history(spark).unionAll(spark.createDataFrame([("A", None, 5.0), ("B", date(2023, 1, 5), None), ("C", date(2023, 1, 5), None)], "hospital_id string, date date, total_admissions double"))
    df = df.withColumns({"dow": F.weekday("date"), "month": F.month("date")})
    want = B.predict_baseline(B.train_baseline(df, by=["hospital_id"]), df, ["hospital_id"])
    got = B.predict_in_sample(df, ["hospital_id"])
    as_rows = lambda t: sorted((str(r[:-1]), r[-1] if r[-1] is None else round(r[-1], 9)) for r in map(tuple, t.collect()))
    assert as_rows(got) == as_rows(want)
    assert B.predict_in_sample(df.drop("dow", "month"), ["hospital_id"]).count() == df.count()


def test_in_sample_predictions_sort_a_site_once(spark):
    """Weekday and month of the date: the same predictions as with both as columns, and the rows are held by one sort, not three."""
    df = history(spark).unionAll(spark.createDataFrame([("A", None, 5.0), ("B", date(2023, 1, 5), None), ("C", date(2023, 1, 5), None)], "hospital_id string, date date, total_admissions double"))
    got = B.predict_in_sample(df, ["hospital_id"])
    want = B.predict_in_sample(df.withColumns({"dow": F.weekday("date"), "month": F.month("date")}), ["hospital_id"]).drop("dow", "month")
    as_rows = lambda t: sorted((str(r[:-1]), r[-1] if r[-1] is None else round(r[-1], 9)) for r in map(tuple, t.collect()))
    assert as_rows(got) == as_rows(want)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        again = B.predict_in_sample(df.select("*"), ["hospital_id"])
        assert again._jdf.queryExecution().executedPlan().toString().count(" Sort [") == 1
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_missing_season_falls_back_to_the_overall_mean(spark):
    df = history(spark, ["A"], 20)
    row = B.predict_baseline(B.train_baseline(df), M.generate_future_dates(spark, date(2023, 8, 7), 1)).first()
    assert row["predicted_admissions"] == pytest.approx((100.0 + df.agg(F.avg("total_admissions")).first()[0]) / 2)


def test_baseline_profiles(spark):
    baseline = B.train_baseline(history(spark, ["A"], 3))
    assert [r["mean"] for r in B.weekday_profile(baseline).orderBy("dow").collect()] == [100, 105, 0, 0, 0, 0, 130]
    months = B.month_profile(baseline).orderBy("month").collect()
    assert (months[0]["label"], months[11]["label"], months[5]["mean"]) == ("Jan", "Déc", 0)


def test_forecast_columns(spark):
    rows = M.with_drivers(M.generate_future_dates(spark, date(2024, 1, 5), 3), {"epidemic_level": 2, "season": "x"}).orderBy("date").collect()
    assert [r["scheduled_surgeries"] for r in rows] == [42, 20, 20] and rows[0]["temperature_c"] == 4.0
    assert {r["epidemic_level"] for r in rows} == {2} and {r["season"] for r in rows} == {"x"}
    assert [r["day_of_week"] for r in rows] == ["Friday", "Saturday", "Sunday"] and rows[0]["week"] == 1
    band = M.with_band(forecast_frame(spark)).orderBy("date").first()
    assert (band["lower"], band["upper"]) == (pytest.approx(340), pytest.approx(460))
    k = M.forecast_kpis(forecast_frame(spark)).first()
    assert (k["avg_daily"], k["peak_day"], k["total"]) == (400, 420, 2800)


@pytest.fixture(scope="module")
def learned(spark):
    df = history(spark).withColumns({
        "dow": F.weekday("date"), "month": F.month("date"), "season": F.when(F.month("date") < 4, "winter").otherwise("other"),
        "temperature_c": F.when(F.dayofmonth("date") > 3, F.dayofmonth("date").cast("double")),
        "all_null": F.lit(None).cast("double"),
    })
    return df, L.train_model(df, ["hospital_id", "dow", "month", "season", "temperature_c", "all_null"], trees=10, depth=6)


def test_forest_learns_and_explains(spark, learned):
    df, model = learned
    assert L.evaluate_model(model, df).first()["r2"] > 0.95
    assert L.feature_names(model) == ["dow", "month", "temperature_c", "hospital_id_A", "hospital_id_B", "season_other", "season_winter"]
    top = L.feature_importance(model, spark, 2).collect()
    assert top[0]["feature"].startswith("hospital_id") and len(top) == 2


def test_preprocessor_imputes_and_ignores_unseen_categories(spark, learned):
    df, model = learned
    row = df.limit(1).select(
        F.lit("new").alias("hospital_id"), F.lit(None).cast("string").alias("season"), F.lit(None).cast("double").alias("temperature_c"),
        F.lit(3).alias("dow"), F.lit(2).alias("month"), F.lit(None).cast("double").alias("all_null"))
    vector = list(L.preprocessed_features(model, row).first()["features"])
    assert vector == [3.0, 2.0, df.selectExpr("median(temperature_c)").first()[0], 0.0, 0.0, 1.0, 0.0]


def test_forecast_of_one_and_of_all_sites(spark, learned):
    df, model = learned
    extra = {"all_null": None}
    rows = M.forecast(spark, model, date(2024, 2, 5), 7, extra, "A").collect()
    assert len(rows) == 7 and all(90 < r["predicted_admissions"] < 150 for r in rows)
    assert M.forecast_sites(model, df, 5, extra).count() == 10


def test_feature_sets_are_compared_on_one_split(spark):
    df = history(spark).withColumns({"dow": F.weekday("date"), "month": F.month("date"), "epidemic_level": F.weekday("date")})
    rows = L.compare_feature_sets(df, trees=3, depth=4).collect()
    assert [r["model"] for r in rows] == ["Full", "Strong Corr", "Realistic"]
    assert {r["rows"] for r in rows} == {160} and set(FEATURE_COLUMNS) >= {"dow", "month"}


def test_forest_is_grown_a_few_trees_at_a_time(spark, tmp_path, monkeypatch):
    """No run, and so no driver, holds all trees; predictions and importances are those of all of them."""
    from bedwise.sources.models import load_model, save_model

    monkeypatch.setattr(L, "TREES_PER_RUN", 3)
    df = history(spark).withColumns({"dow": F.weekday("date"), "month": F.month("date")})
    model = L.train_model(df, ["dow", "month", "hospital_id"], trees=7, depth=5)
    forest = model.stages[-1]
    assert forest.getNumTrees == 7 and forest.sizes == [3, 3, 1]
    trees = [t for part in forest.parts for t in L.RandomForestRegressionModel.load(part).trees]
    vectors = [r["features"] for r in L.preprocessed_features(model, df).orderBy("date", "hospital_id").limit(5).collect()]
    got = [r["predicted_admissions"] for r in L.predict(model, df).orderBy("date", "hospital_id").limit(5).collect()]
    assert got == pytest.approx([sum(t.predict(v) for t in trees) / 7 for v in vectors])
    weights = [sum(t.featureImportances.toArray()[i] for t in trees) / 7 for i in range(len(vectors[0]))]
    assert forest.featureImportances.toArray().tolist() == pytest.approx(weights)
    again = load_model(spark, save_model(model, str(tmp_path / "m")))
    assert sorted(L.predict(again, df).collect()) == sorted(L.predict(model, df).collect())
    assert len({tuple(L.RandomForestRegressionModel.load(p).trees[0].featureImportances.toArray()) for p in forest.parts}) == 3


def test_runs_have_fewer_trees_the_more_rows_there_are(spark, monkeypatch):
    """The driver holds a bounded number of nodes while it grows, and of trees while it predicts."""
    options = L._forest("y", 300, 20, 2, 1, 64)
    assert [L.trees_per_run(n, options) for n in (0, 1_000, 9_620, 50_000, 10**8)] == [25, 25, 10, 2, 1]
    assert L.lots([2, 2, 2, 1, 9, 1], 4) == [[0, 1], [2, 3], [4], [5]]
    df = history(spark).withColumns({"dow": F.weekday("date"), "month": F.month("date")})
    rows = df.count()
    monkeypatch.setattr(L, "NODES_PER_RUN", 2 * 2 * 8)
    monkeypatch.setattr(L, "TREES_PER_RUN", 4)
    model = L.train_model(df, ["dow", "month"], trees=7, depth=3, min_leaf=2)
    assert rows >= 16 and model.stages[-1].sizes == [2, 2, 2, 1]
    seen, load, write = [], L.RandomForestRegressionModel.load, L.written
    monkeypatch.setattr(L.RandomForestRegressionModel, "load", staticmethod(lambda path: seen.append("load") or load(path)))
    monkeypatch.setattr(L, "written", lambda *a: seen.append("write") or write(*a))
    L.predict(model, df).count()
    assert seen == ["load", "load", "write"] * 2


def test_dealt_trees_are_the_same_however_rows_are_dealt(spark, tmp_path, monkeypatch):
    """Nodes finished in a task, split by histograms of all tasks, in many blocks, or saved: one forest, and as good as MLlib's."""
    from bedwise.plans import trees as T
    from bedwise.sources.models import load_model, save_model

    df = history(spark).withColumns({"dow": F.weekday("date"), "month": F.month("date"), "day": F.dayofmonth("date")})
    columns, found = ["dow", "month", "day", "hospital_id"], []
    mllib = L.train_model(df, columns, trees=12, depth=8)
    monkeypatch.setattr(L, "MLLIB_ROWS", 0)
    ran = []
    monkeypatch.setattr(L.RandomForestRegressor, "fit", lambda self, rows: ran.append(1))
    for rows in (10**6, 25):
        monkeypatch.setattr(T, "NODE_ROWS", rows)
        model = L.train_model(df, columns, trees=12, depth=8, rows_per_part=70)
        forest = model.stages[-1]
        assert isinstance(forest, L.DealtForest) and (forest.getNumTrees, forest.getOrDefault("maxDepth")) == (12, 8)
        nodes = spark.read.parquet(f"{forest.parts[0]}/nodes")
        assert nodes.select("tree").distinct().count() == 12 and (nodes.count() > 12) == (rows == 25)
        again = load_model(spark, save_model(model, str(tmp_path / f"m{rows}")))
        got = sorted((r["date"], r["hospital_id"], r["predicted_admissions"]) for r in L.predict(again, df).collect())
        assert got == sorted((r["date"], r["hospital_id"], r["predicted_admissions"]) for r in L.predict(model, df).collect())
        found.append((got, forest.importances))
        assert sum(forest.importances) == pytest.approx(1) and min(forest.importances) >= 0
    assert not ran and len(found[0][0]) == df.count()
    assert [r[2] for r in found[0][0]] == pytest.approx([r[2] for r in found[1][0]])
    # Where two features split the rows of a small node alike, either may be named.
    a, b = ([*i[:3], i[3] + i[4]] for _, i in found)
    assert a == pytest.approx(b, abs=5e-3)
    r2, other = (L.evaluate_model(m, df).first()["r2"] for m in (model, mllib))
    assert r2 > 0.95 and abs(r2 - other) < 0.03


def test_nodes_finished_in_a_task_have_the_best_splits():
    from bedwise.plans.trees import route, subtree

    rng = np.random.default_rng(3)
    x = rng.integers(0, [3, 9, 30], (120, 3)).astype(np.uint8)
    w = rng.integers(1, 4, 120).astype(np.uint8)
    y = rng.normal(size=120) + 1000 + x[:, 1]

    def grown(rows, depth):
        """The value of each row, by trying all splits."""
        weight, mean = w[rows].sum(), np.average(y[rows], weights=w[rows])
        gain = lambda i: w[i].sum() * (np.average(y[i], weights=w[i]) - mean) ** 2
        sides = [(rows[x[rows, f] <= c], rows[x[rows, f] > c]) for f in range(3) for c in np.unique(x[rows, f])[:-1]] if depth else []
        sides = [s for s in sides if min(w[s[0]].sum(), w[s[1]].sum()) >= 2]
        if not sides or weight < 4:
            return {i: mean for i in rows.tolist()}
        low, high = max(sides, key=lambda s: gain(s[0]) + gain(s[1]))
        return grown(low, depth - 1) | grown(high, depth - 1)

    for depth in (0, 1, 4, 20):
        feature, cut, left, value, _ = subtree(x, y, w, depth, 2)
        want = grown(np.arange(120), depth)
        assert value[route(x, feature, cut, left)].tolist() == pytest.approx([want[i] for i in range(120)], rel=1e-12)
    feature, _, _, value, gains = subtree(x, np.full(120, 0.1), w, 20, 2)
    assert feature.tolist() == [-1] and value.tolist() == pytest.approx([0.1]) and not gains.any()


def test_bounds_of_bins_are_those_of_mllib(spark):
    """Few values, a value that most rows have, and more values than are counted."""
    from pyspark.ml.linalg import Vectors

    from bedwise.plans import trees as T

    assert T.bounds_between([(3.0, 1), (1.0, 5)], 4) == [2.0]
    rows = [(Vectors.dense(float(k % 3), float(max(0, k - 600))), float(k > 700)) for k in range(1000)]
    df = spark.createDataFrame(rows, ["features", "y"])
    few, many = T.bin_bounds(df, "features", 8)
    assert few == [0.5, 1.5] and len(many) == 7 and many[0] == 0.5 and len(set(many)) == 7
