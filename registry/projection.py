"""Queries over the baseline, forecasts, scenarios, actions and the learned model."""

from __future__ import annotations

import uuid
from datetime import date

from pyspark.ml import Pipeline
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from bedwise.functions.labels import MONTH_LABELS, PRIORITY_LABELS, WEEKDAY_LABELS, priority_label
from bedwise.operators import aggregates as A
from bedwise.operators import filters as FL
from bedwise.operators import series as W
from bedwise.operators.prep import build_features
from bedwise.plans import actions as R
from bedwise.plans import baseline as B
from bedwise.plans import forecast as M
from bedwise.plans import learning as L
from bedwise.plans import scenarios as X
from bedwise.settings import DAY_NAMES, FEATURE_COLUMNS
from bedwise.sources import models as S
from bedwise.sources.work import shared_dir, written
from registry.core import query
from registry.history import calendar_sql
from registry.tables import DAILY, HOSPITAL, HOSPITAL_FULL, SUPPLIER, daily_facts, hospital_days, hospital_full, sql_list, sql_season, supplier_days, supplier_visits, table

SITE = ["hospital_id"]
HORIZON = 30
NORMAL_LEVEL = 400

# --- SQL parts ---------------------------------------------------------------------------

BASELINE = """
overall AS (SELECT hospital_id, avg(total_admissions) AS m, stddev_samp(total_admissions) AS s FROM supplier_days GROUP BY 1),
dow_means AS (SELECT hospital_id, isodow(date) - 1 AS dow, avg(total_admissions) AS m FROM supplier_days GROUP BY 1, 2),
month_means AS (SELECT hospital_id, month(date) AS month, avg(total_admissions) AS m FROM supplier_days GROUP BY 1, 2)"""

FUTURE = f"""
starts AS (SELECT hospital_id, max(date) + 1 AS start FROM supplier_days GROUP BY 1),
future AS (SELECT hospital_id, CAST(unnest(generate_series(start::TIMESTAMP, start::TIMESTAMP + INTERVAL {HORIZON - 1} DAY, INTERVAL 1 DAY)) AS DATE) AS date FROM starts)"""

PREDICTED = f"""{SUPPLIER},{BASELINE},{FUTURE},
predicted AS (
  SELECT f.hospital_id, f.date, (coalesce(d.m, o.m) + coalesce(mm.m, o.m)) / 2 * (4e2 / o.m) AS predicted_admissions
  FROM future f JOIN overall o USING (hospital_id)
  LEFT JOIN dow_means d ON d.hospital_id = f.hospital_id AND d.dow = isodow(f.date) - 1
  LEFT JOIN month_means mm ON mm.hospital_id = f.hospital_id AND mm.month = month(f.date))"""


def _row(name: str, p: X.ScenarioParams) -> str:
    index = "NULL" if p.shock_day_index is None else str(p.shock_day_index)
    numbers = [p.epidemic_intensity, p.staffing_reduction, p.seasonal_multiplier, p.shock_day_spike]
    rest = [p.beds_reduction, p.stock_reduction]
    number = lambda v: f"{float(v)}e0"
    return f"('{name}', {', '.join(map(number, numbers))}, CAST({index} AS INTEGER), {', '.join(map(number, rest))})"


def projected_sql(with_: str, scenarios=X.PRESETS, source: str = "predicted", beds: int = 1450) -> str:
    return f"""{with_},
params(scenario, epidemic, staffing, seasonal, spike, shock_index, beds_cut, stock_cut) AS (VALUES {", ".join(_row(n, p) for n, p in scenarios.items())}),
indexed AS (SELECT *, row_number() OVER (PARTITION BY hospital_id ORDER BY date) - 1 AS day FROM {source}),
demand AS (
  SELECT *, predicted_admissions * (1 + epidemic / 100) * seasonal
           * CASE WHEN spike > 0 AND day = shock_index THEN 1 + spike / 100 ELSE 1e0 END AS scenario_admissions,
         425 * (1 - staffing / 100) AS effective_staff, {beds} * (1 - beds_cut / 100) AS effective_beds,
         75e0 * (1 - stock_cut / 100) AS effective_stock_pct
  FROM indexed CROSS JOIN params),
capped AS (
  SELECT *, least(450 * (1 - staffing / 100), effective_staff * 3, effective_beds * 0.85e0) AS effective_capacity FROM demand),
projected AS (
  SELECT scenario, hospital_id, date, predicted_admissions, scenario_admissions, effective_staff, effective_beds, effective_capacity,
         scenario_admissions - effective_capacity AS capacity_gap, effective_stock_pct,
         scenario_admissions / effective_beds AS occupancy_rate,
         scenario_admissions - effective_capacity > 0 AS is_overcapacity,
         scenario_admissions / effective_beds > 0.85e0 AS is_critical,
         predicted_admissions AS baseline_admissions,
         (scenario_admissions - predicted_admissions) / predicted_admissions * 100 AS demand_change_pct
  FROM capped)"""


PROJECTED = projected_sql(PREDICTED)

IMPACT = """round(avg(scenario_admissions), 6) AS avg_daily_admissions, round(max(scenario_admissions), 6) AS max_daily_admissions,
  count(*) FILTER (WHERE is_overcapacity) AS days_overcapacity, count(*) FILTER (WHERE is_critical) AS days_critical,
  round(avg(capacity_gap), 6) AS avg_capacity_gap, round(max(capacity_gap), 6) AS max_capacity_gap,
  round(avg(occupancy_rate), 6) AS avg_occupancy_rate"""


def actions_sql(source: str, keys: str) -> str:
    """One row per fired rule; ``source`` has the projected columns."""
    a = {k: v.replace("'", "''") for k, v in R.ACTIONS.items()}
    needed = "CAST(trunc((425e0 - effective_staff) * 0.8e0) AS INTEGER)"
    beds = "CAST(ceil(capacity_gap * 1.1e0) AS DOUBLE)"
    share = "effective_staff / 425e0"
    surge, busy = "is_overcapacity AND capacity_gap > 50", "NOT is_overcapacity AND occupancy_rate > 0.75e0"
    whole = "CAST(CAST({} AS BIGINT) AS VARCHAR)"
    gap_text, rate_text = whole.format("trunc(capacity_gap)"), whole.format("round_even(occupancy_rate * 100, 0)")
    stock_text = whole.format("round_even(effective_stock_pct, 0)")
    rules = [
        (1, "ACTIVATE_SURGE", f"'{R.CRITICAL}'", f"'Activer le protocole de surcharge - ' || {gap_text} || ' au-dessus de la capacité'", beds, "'lits'", surge),
        (2, "EXTERNAL_SUPPORT", f"'{R.CRITICAL}'", "'Demander le soutien des hôpitaux voisins'", "CAST(trunc(capacity_gap * 0.3e0) AS DOUBLE)", "'transferts'", surge),
        (3, "ADD_BEDS", f"'{R.HIGH}'", "'Ajouter des lits temporaires'", beds, "'lits'", "is_overcapacity AND capacity_gap > 0 AND capacity_gap <= 50"),
        (4, "ADD_STAFF", f"'{R.CRITICAL}'", "'Pénurie critique de personnel'", f"CAST({needed} AS DOUBLE)", "'personnel'", f"{share} < 0.7e0"),
        (5, "OVERTIME", f"'{R.HIGH}'", "'Autoriser les heures supplémentaires'", f"CAST({needed} * 4 AS DOUBLE)", "'heures'", f"{share} >= 0.7e0 AND {share} < 0.85e0"),
        (6, "ALERT_ADMIN", f"'{R.MEDIUM}'", f"'Occupation à ' || {rate_text} || '%'", "occupancy_rate * 100", "'% occupation'", busy),
        (7, "DELAY_ELECTIVE", f"'{R.MEDIUM}'", "'Envisager de reporter les interventions programmées'", "CAST(NULL AS DOUBLE)", "CAST(NULL AS VARCHAR)", f"{busy} AND occupancy_rate > 0.8e0"),
        (8, "STOCK_REPLENISH", f"CASE WHEN effective_stock_pct < 40 THEN '{R.HIGH}' ELSE '{R.MEDIUM}' END", f"'Fournitures à ' || {stock_text} || '%'", "50e0 - effective_stock_pct + 20", "'% stock'", "effective_stock_pct < 50"),
        (9, "REDISTRIBUTE", f"'{R.HIGH}'", "'Redistribuer les patients entre les services'", "CAST(NULL AS DOUBLE)", "CAST(NULL AS VARCHAR)", "is_critical"),
    ]
    select = " UNION ALL ".join(
        f"""SELECT {keys}, date, CAST({o} AS INTEGER) AS ord, '{a[k]}' AS action, {p} AS priority, {d} AS description, {q} AS quantity, {u} AS unit
FROM {source} WHERE {c}""" for o, k, p, d, q, u, c in rules)
    return f"""fired AS ({select}),
recs AS (SELECT * FROM fired UNION ALL SELECT {keys}, date, 10, '{a["MONITOR"]}', '{R.LOW}', 'Opérations normales', NULL, NULL
  FROM {source} WHERE NOT ({" OR ".join(f"({r[-1]})" for r in rules)}))"""


KEYS = "scenario, hospital_id"
RECS = f"{PROJECTED}, {actions_sql('projected', KEYS)}"


# --- Spark parts ----------------------------------------------------------------------------

def fitted(spark, sf):
    return B.train_baseline(supplier_days(spark, sf), by=SITE)


def predicted(spark, sf):
    return B.forecast_baseline(fitted(spark, sf), HORIZON, SITE, normal_level=NORMAL_LEVEL)


def projected(spark, sf):
    return X.apply_scenarios(predicted(spark, sf).select("hospital_id", "date", "predicted_admissions"))


def recommended(spark, sf):
    return R.generate_recommendations(projected(spark, sf))


# --- baseline and forecast ------------------------------------------------------------------

@query("scenario_comparison", f"""WITH {projected_sql(PREDICTED, {n: p for n, p in X.PRESETS.items() if n != X.REFERENCE_SCENARIO})} SELECT scenario, {IMPACT} FROM projected GROUP BY 1""")
def _(spark, sf):
    return X.compare_scenarios(predicted(spark, sf))


@query("baseline_fit", f"""WITH {SUPPLIER},{BASELINE} SELECT hospital_id, 'overall' AS part, CAST(0 AS INTEGER) AS key, round(m, 6) AS mean, round(s, 6) AS std FROM overall
UNION ALL SELECT hospital_id, 'dow', CAST(dow AS INTEGER), round(m, 6), NULL FROM dow_means
UNION ALL SELECT hospital_id, 'month', CAST(month AS INTEGER), round(m, 6), NULL FROM month_means""")
def _(spark, sf):
    rows = B.baseline_rows(fitted(spark, sf), SITE).where("part = 'overall' OR mean IS NOT NULL")
    return rows.select("hospital_id", "part", F.coalesce("position", F.lit(0)).alias("key"), "mean", "std")


@query("baseline_network_fit", f"""WITH {DAILY} SELECT round(avg(total_admissions), 6) AS overall_mean, round(stddev_samp(total_admissions), 6) AS overall_std FROM daily""")
def _(spark, sf):
    return B.train_baseline(daily_facts(spark, sf)).select("overall_mean", "overall_std")


@query("baseline_in_sample", f"""WITH {SUPPLIER},{BASELINE} SELECT h.hospital_id, h.date, total_admissions,
  round((coalesce(d.m, o.m) + coalesce(mm.m, o.m)) / 2, 6) AS predicted_admissions
FROM supplier_days h JOIN overall o USING (hospital_id) LEFT JOIN dow_means d ON d.hospital_id = h.hospital_id AND d.dow = isodow(h.date) - 1
LEFT JOIN month_means mm ON mm.hospital_id = h.hospital_id AND mm.month = month(h.date)""")
def _(spark, sf):
    return in_sample(spark, sf)


def in_sample(spark, sf):
    return B.predict_in_sample(supplier_days(spark, sf).select("hospital_id", "date", "total_admissions"), SITE)


IN_SAMPLE = f"""{SUPPLIER},{BASELINE}, fit AS (SELECT total_admissions AS y, (coalesce(d.m, o.m) + coalesce(mm.m, o.m)) / 2 AS f
FROM supplier_days h JOIN overall o USING (hospital_id) LEFT JOIN dow_means d ON d.hospital_id = h.hospital_id AND d.dow = isodow(h.date) - 1
LEFT JOIN month_means mm ON mm.hospital_id = h.hospital_id AND mm.month = month(h.date))"""


@query("regression_metrics", f"""WITH {IN_SAMPLE} SELECT count(*) AS rows, round(avg(abs(y - f)), 6) AS mae, round(sqrt(avg((y - f) * (y - f))), 6) AS rmse,
  round(1 - sum((y - f) * (y - f)) / (var_pop(y) * count(*)), 6) AS r2 FROM fit""")
def _(spark, sf):
    return A.regression_metrics(in_sample(spark, sf), "total_admissions", "predicted_admissions")


@query("error_ratio", f"""WITH {IN_SAMPLE} SELECT count(*) AS rows, round(avg(abs(y - f)), 6) AS mae, round(sqrt(avg((y - f) * (y - f))), 6) AS rmse,
  round(1 - sum((y - f) * (y - f)) / (var_pop(y) * count(*)), 6) AS r2,
  round(avg(abs(y - f)) / (SELECT avg(total_admissions) FROM supplier_days WHERE hospital_id = 'S1') * 100, 6) AS mape FROM fit""")
def _(spark, sf):
    metrics = A.regression_metrics(in_sample(spark, sf), "total_admissions", "predicted_admissions")
    return A.error_ratio_pct(metrics, supplier_days(spark, sf).where(F.col("hospital_id") == "S1"))


@query("residual_stats", f"""WITH {IN_SAMPLE} SELECT round(avg(y - f), 6) AS residual_mean, round(stddev_samp(y - f), 6) AS residual_std,
  round(avg(CAST(abs(y - f) < y * 0.1e0 AS DOUBLE)), 6) AS within_10pct FROM fit""")
def _(spark, sf):
    df = in_sample(spark, sf).select(F.col("total_admissions").alias("actual"), F.col("predicted_admissions").alias("predicted"))
    return A.residual_stats(df)


PROFILE = """{daily}, means AS (SELECT {key} AS k, avg(total_admissions) AS m FROM daily GROUP BY 1)
SELECT CAST(b AS INTEGER) AS {name}, {labels}[b + {off}] AS label, round(coalesce(m, 0), 6) AS mean FROM range({lo}, {hi}) t(b) LEFT JOIN means ON k = b"""


@query("weekday_profile", "WITH " + PROFILE.format(daily=DAILY, key="isodow(date) - 1", name="dow", labels=sql_list(WEEKDAY_LABELS), off=1, lo=0, hi=7))
def _(spark, sf):
    return B.weekday_profile(B.train_baseline(daily_facts(spark, sf)))


@query("month_profile", "WITH " + PROFILE.format(daily=DAILY, key="month(date)", name="month", labels=sql_list(MONTH_LABELS), off=0, lo=1, hi=13))
def _(spark, sf):
    return B.month_profile(B.train_baseline(daily_facts(spark, sf)))


@query("future_calendar", f"""WITH {SUPPLIER},{FUTURE} SELECT hospital_id, date, {calendar_sql('date')}, {sql_season('month(date)')} AS season, dayname(date) AS day_of_week FROM future""")
def _(spark, sf):
    return M.days_after(supplier_visits(spark, sf), HORIZON)


@query("forecast_drivers", f"""WITH {SUPPLIER},{FUTURE} SELECT hospital_id, date, {calendar_sql('date')}, {sql_season('month(date)')} AS season, dayname(date) AS day_of_week,
  {sql_list([4, 5, 9, 13, 17, 21, 24, 23, 19, 13, 8, 5])}[month(date)] AS temperature_c,
  CAST(CASE WHEN isodow(date) >= 6 THEN 20 ELSE {sql_list([42, 44, 45, 43, 40, 35, 30, 28, 38, 42, 44, 40])}[month(date)] END AS INTEGER) AS scheduled_surgeries,
  CAST(2 AS INTEGER) AS epidemic_level, CAST(0 AS INTEGER) AS heatwave_event, CAST(0 AS INTEGER) AS strike_level, 0.06e0 AS staff_absence_rate, CAST(420 AS INTEGER) AS available_staff,
  CAST(1420 AS INTEGER) AS available_beds, 72e0 AS medical_stock_level_pct, CAST(0 AS INTEGER) AS accident_event, CAST(0 AS INTEGER) AS external_alert_level FROM future""")
def _(spark, sf):
    return M.with_drivers(M.days_after(supplier_visits(spark, sf), HORIZON), {"epidemic_level": 2})


@query("baseline_forecast", f"""WITH {PREDICTED} SELECT hospital_id, date, round(predicted_admissions, 6) AS predicted_admissions,
  round(predicted_admissions * (1 - 0.15e0), 6) AS lower, round(predicted_admissions * (1 + 0.15e0), 6) AS upper FROM predicted""")
def _(spark, sf):
    return M.with_band(predicted(spark, sf).select("hospital_id", "date", "predicted_admissions"))


@query("forecast_kpis", f"""WITH {PREDICTED} SELECT hospital_id, round(avg(predicted_admissions), 6) AS avg_daily, round(max(predicted_admissions), 6) AS peak_day,
  round(sum(predicted_admissions), 6) AS total FROM predicted GROUP BY 1""")
def _(spark, sf):
    return M.forecast_kpis(predicted(spark, sf), by=SITE)


@query("forecast_table", f"""WITH {PREDICTED} SELECT hospital_id, strftime(date, '%d/%m/%Y') AS date, CAST(round_even(predicted_admissions, 0) AS INTEGER) AS predicted FROM predicted""")
def _(spark, sf):
    return M.forecast_table(predicted(spark, sf), by=SITE)


@query("history_and_forecast", f"""WITH {PREDICTED} SELECT hospital_id, date, 'history' AS series, CAST(total_admissions AS DOUBLE) AS admissions FROM
  (SELECT * FROM supplier_days QUALIFY row_number() OVER (PARTITION BY hospital_id ORDER BY date DESC) <= 90)
UNION ALL SELECT hospital_id, date, 'forecast', round(predicted_admissions, 6) AS admissions FROM predicted""")
def _(spark, sf):
    return W.labelled_series(W.last_rows(supplier_days(spark, sf), 90), predicted(spark, sf))


# --- scenarios --------------------------------------------------------------------------------

@query("scenario_projection", f"""WITH {PROJECTED} SELECT scenario, hospital_id, date, round(predicted_admissions, 6) AS predicted_admissions,
  round(scenario_admissions, 6) AS scenario_admissions, round(effective_staff, 6) AS effective_staff, round(effective_beds, 6) AS effective_beds,
  round(effective_capacity, 6) AS effective_capacity, round(capacity_gap, 6) AS capacity_gap, round(effective_stock_pct, 6) AS effective_stock_pct,
  round(occupancy_rate, 6) AS occupancy_rate, is_overcapacity, is_critical, round(baseline_admissions, 6) AS baseline_admissions,
  round(demand_change_pct, 6) AS demand_change_pct FROM projected""")
def _(spark, sf):
    return projected(spark, sf)


CUSTOM = X.ScenarioParams.from_dict({"epidemic_intensity": 20, "beds_reduction": 70, "stock_reduction": 45, "shock_day_spike": 50, "shock_day_index": 3})


@query("single_scenario", f"""WITH {projected_sql(PREDICTED, {'custom': CUSTOM})} SELECT hospital_id, date, round(scenario_admissions, 6) AS scenario_admissions,
  round(effective_capacity, 6) AS effective_capacity, round(capacity_gap, 6) AS capacity_gap, round(occupancy_rate, 6) AS occupancy_rate, is_overcapacity, is_critical FROM projected""")
def _(spark, sf):
    df = X.apply_scenario(predicted(spark, sf), CUSTOM)
    return df.select("hospital_id", "date", "scenario_admissions", "effective_capacity", "capacity_gap", "occupancy_rate", "is_overcapacity", "is_critical")


@query("scenario_impact_by_site", f"""WITH {PROJECTED} SELECT scenario, hospital_id, {IMPACT} FROM projected GROUP BY 1, 2""")
def _(spark, sf):
    return X.summarize_scenario_impact(projected(spark, sf), ["scenario", "hospital_id"])


@query("scenario_deltas", f"""WITH {PROJECTED} SELECT scenario, round((avg(scenario_admissions) - avg(baseline_admissions)) / avg(baseline_admissions) * 100, 6) AS avg_change_pct,
  round(max(scenario_admissions) - max(baseline_admissions), 6) AS peak_change, round(sum(baseline_admissions), 3) AS baseline_total,
  round((avg(occupancy_rate) - 0.45e0) * 100, 6) AS occupancy_points FROM projected GROUP BY 1""")
def _(spark, sf):
    df = X.scenario_deltas(projected(spark, sf), ["scenario"])
    return df.withColumn("baseline_total", F.round("baseline_total", 3))


@query("resource_impact", f"""WITH {PROJECTED} SELECT scenario, round(avg(effective_staff), 6) AS effective_staff, round(425 - avg(effective_staff), 6) AS staff_reduction,
  round(avg(effective_beds), 6) AS effective_beds, round(1450 - avg(effective_beds), 6) AS beds_reduction, round(avg(effective_stock_pct), 6) AS effective_stock_pct,
  avg(effective_stock_pct) < 50 AS stock_low FROM projected GROUP BY 1""")
def _(spark, sf):
    return X.resource_impact(projected(spark, sf), ["scenario"])


@query("scenario_detail", f"""WITH {PROJECTED} SELECT scenario, hospital_id, strftime(date, '%d/%m/%Y') AS "Date", CAST(round_even(baseline_admissions, 0) AS INTEGER) AS "Référence",
  CAST(round_even(scenario_admissions, 0) AS INTEGER) AS "Scénario", CAST(round_even(effective_capacity, 0) AS INTEGER) AS "Capacité",
  CAST(round_even(capacity_gap, 0) AS INTEGER) AS "Écart", CAST(round_even(occupancy_rate * 100, 1) AS VARCHAR) || '%' AS "Occupation",
  is_overcapacity AS "Surcapacité", is_critical AS "Critique", CASE WHEN is_overcapacity THEN 'overcapacity' WHEN is_critical THEN 'critical' ELSE 'none' END AS row_flag FROM projected""")
def _(spark, sf):
    return X.detail_table(projected(spark, sf), ["scenario", "hospital_id"])


# --- actions ------------------------------------------------------------------------------------

REC_COLUMNS = "scenario, hospital_id, date, ord, action, priority, description, round(quantity, 6) AS quantity, unit"


@query("recommendations", f"""WITH {RECS} SELECT {REC_COLUMNS} FROM recs""")
def _(spark, sf):
    return recommended(spark, sf)


# Line items as days with every kind of pressure: all ten rules fire.
PRESSED = """
pressed AS (
  SELECT l_orderkey AS day_key, l_linenumber AS line, CAST(l_shipdate AS DATE) AS date,
         l_quantity * 4 - 60 AS capacity_gap, l_quantity * 4 - 60 > 0 AND l_linestatus = 'O' AS is_overcapacity,
         l_quantity / 50 AS occupancy_rate, 425e0 * (1 - l_discount * 4) AS effective_staff,
         100e0 - l_tax * 1000 AS effective_stock_pct, l_returnflag = 'R' AS is_critical
  FROM lineitem)"""


def pressed(spark, sf):
    q = F.col("l_quantity")
    return table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("day_key"), F.col("l_linenumber").alias("line"), F.to_date("l_shipdate").alias("date"),
        (q * 4 - 60).alias("capacity_gap"), ((q * 4 - 60 > 0) & (F.col("l_linestatus") == "O")).alias("is_overcapacity"),
        (q / 50).alias("occupancy_rate"), (F.lit(425.0) * (1 - F.col("l_discount") * 4)).alias("effective_staff"),
        (F.lit(100.0) - F.col("l_tax") * 1000).alias("effective_stock_pct"), (F.col("l_returnflag") == "R").alias("is_critical"))


PRESSED_RECS = f"{PRESSED}, {actions_sql('pressed', 'day_key, line')}"


@query("all_rules", f"""WITH {PRESSED_RECS} SELECT action, priority, unit, description, count(*) AS actions, round(sum(quantity), 3) AS quantity FROM recs GROUP BY ALL""")
def _(spark, sf):
    recs = R.generate_recommendations(pressed(spark, sf), keep=["day_key", "line"])
    return recs.groupBy("action", "priority", "unit", "description").agg(F.count(F.lit(1)).alias("actions"), F.sum("quantity").alias("quantity"))


@query("urgent_actions", f"""WITH {RECS} SELECT {REC_COLUMNS} FROM recs WHERE priority IN ('{R.CRITICAL}', '{R.HIGH}')""")
def _(spark, sf):
    return R.get_priority_actions(recommended(spark, sf))


@query("selected_priorities", f"""WITH {RECS} SELECT {REC_COLUMNS} FROM recs WHERE priority IN ('{R.CRITICAL}', '{R.MEDIUM}')""")
def _(spark, sf):
    return FL.with_priority(recommended(spark, sf), [R.CRITICAL, R.MEDIUM])


SUMMARY = f"""scenario, count(*) AS total_recommendations, count(*) FILTER (WHERE priority = '{R.CRITICAL}') AS critical_count,
  count(*) FILTER (WHERE priority = '{R.HIGH}') AS high_count, count(DISTINCT date) FILTER (WHERE priority IN ('{R.CRITICAL}', '{R.HIGH}')) AS dates_with_issues"""


@query("recommendation_summary", f"""WITH {RECS} SELECT {SUMMARY} FROM recs GROUP BY 1""")
def _(spark, sf):
    return R.summarize_recommendations(recommended(spark, sf), ["scenario"])


@query("alert_level", f"""WITH {RECS}, s AS (SELECT {SUMMARY} FROM recs GROUP BY 1)
SELECT *, CASE WHEN critical_count > 0 THEN 'alert' WHEN high_count > 0 THEN 'attention' ELSE 'fine' END AS alert FROM s""")
def _(spark, sf):
    return R.alert_level(R.summarize_recommendations(recommended(spark, sf), ["scenario"]))


@query("actions_by_priority", f"""WITH {RECS} SELECT scenario, priority, count(*) AS actions FROM recs GROUP BY ALL""")
def _(spark, sf):
    return R.count_by_priority(recommended(spark, sf), ["scenario"])


@query("top_actions", f"""WITH {RECS} SELECT action, count(*) AS actions FROM recs GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10""")
def _(spark, sf):
    return R.top_actions(recommended(spark, sf))


NEEDS = """round(sum(quantity) FILTER (WHERE regexp_matches(action, '(?i)lits')), 6) AS extra_beds, count(*) FILTER (WHERE regexp_matches(action, '(?i)lits')) AS bed_actions,
  round(sum(quantity) FILTER (WHERE regexp_matches(action, '(?i)personnel|heures') AND unit = 'heures'), 6) AS overtime_hours,
  count(*) FILTER (WHERE regexp_matches(action, '(?i)personnel|heures')) AS staff_actions, count(*) FILTER (WHERE regexp_matches(action, '(?i)fournitures|stock')) AS stock_alerts"""


@query("resource_needs", f"""WITH {RECS} SELECT scenario, {NEEDS} FROM recs GROUP BY 1""")
def _(spark, sf):
    return R.resource_needs(recommended(spark, sf), ["scenario"])


@query("needs_under_pressure", f"""WITH {PRESSED_RECS} SELECT {NEEDS} FROM recs""")
def _(spark, sf):
    return R.resource_needs(R.generate_recommendations(pressed(spark, sf), keep=["day_key", "line"]))


@query("needs_by_unit", f"""WITH {RECS} SELECT scenario, unit, round(sum(quantity), 3) AS quantity FROM recs WHERE unit IS NOT NULL GROUP BY ALL""")
def _(spark, sf):
    return R.needs_by_unit(recommended(spark, sf), ["scenario"])


WEIGHTS = " ".join(f"WHEN '{k}' THEN {v}" for k, v in R.PRIORITY_WEIGHT.items())


@query("action_timeline", f"""WITH {RECS} SELECT {REC_COLUMNS}, CAST(CASE priority {WEIGHTS} END AS INTEGER) AS priority_value FROM recs""")
def _(spark, sf):
    return R.action_timeline(recommended(spark, sf))


@query("priority_labels", f"""SELECT o_orderkey, CASE split_part(o_orderpriority, '-', 2) {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in PRIORITY_LABELS.items())}
  ELSE split_part(o_orderpriority, '-', 2) END AS label FROM orders""")
def _(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", priority_label(F.split_part("o_orderpriority", F.lit("-"), F.lit(2))).alias("label"))


STRIKE = "Grève du Personnel"
STRIKE_PARAMS = X.PRESETS[STRIKE].to_dict()
#: Lines of the report's head by place; the counts are filled in by SQL.
REPORT_HEAD = [
    "'RAPPORT D''ACTIONS'", "'================='", "''", f"'Scénario : {STRIKE}'", "'Période : 01/12/2001 au 30/12/2001'", "'Généré le : test'", "''", "'RÉSUMÉ'", "'------'",
    "'- Actions Critiques : ' || c", "'- Priorité Haute : ' || h", "'- Total Recommandations : ' || n", "'- Jours avec Problèmes : ' || d || '/30'", "''", "'PARAMÈTRES DU SCÉNARIO'", "'----------------------'",
    f"'- Intensité Épidémique : +{STRIKE_PARAMS['epidemic_intensity']}%'", f"'- Réduction Personnel : {STRIKE_PARAMS['staffing_reduction']}%'",
    f"'- Multiplicateur Saisonnier : x{STRIKE_PARAMS['seasonal_multiplier']}'", f"'- Réduction Lits : {STRIKE_PARAMS['beds_reduction']}%'", f"'- Réduction Stocks : {STRIKE_PARAMS['stock_reduction']}%'", "''",
]


@query("action_report", f"""WITH {RECS}, urgent AS (SELECT * FROM recs WHERE scenario = '{STRIKE}'),
items AS (SELECT CAST(CASE WHEN priority = '{R.CRITICAL}' THEN 1 ELSE 2 END AS INTEGER) AS section, date, hospital_id, ord,
  '[' || strftime(date, '%d/%m/%Y') || '] ' || hospital_id || ' : ' || action AS title, '  → ' || description AS body FROM urgent WHERE priority IN ('{R.CRITICAL}', '{R.HIGH}')),
counts AS (SELECT count(*) FILTER (WHERE priority = '{R.CRITICAL}') AS c, count(*) FILTER (WHERE priority = '{R.HIGH}') AS h, count(*) AS n,
  count(DISTINCT date) FILTER (WHERE priority IN ('{R.CRITICAL}', '{R.HIGH}')) AS d FROM urgent)
SELECT section, date, hospital_id, ord, CAST(0 AS INTEGER) AS part, title AS line FROM items UNION ALL SELECT section, date, hospital_id, ord, 1, body FROM items
UNION ALL SELECT section, date, hospital_id, ord, 2, '' FROM items
UNION ALL SELECT CAST(0 AS INTEGER), NULL, NULL, 0, CAST(unnest(range(0, {len(REPORT_HEAD)})) AS INTEGER), unnest([{", ".join(REPORT_HEAD)}]) FROM counts
UNION ALL SELECT 1, NULL, NULL, 0, 0, 'ACTIONS CRITIQUES' UNION ALL SELECT 1, NULL, NULL, 0, 1, '-----------------'
UNION ALL SELECT 2, NULL, NULL, 0, 0, 'ACTIONS PRIORITÉ HAUTE' UNION ALL SELECT 2, NULL, NULL, 0, 1, '----------------------'""")
def _(spark, sf):
    recs = recommended(spark, sf).where(F.col("scenario") == STRIKE)
    return R.action_report(recs, STRIKE, STRIKE_PARAMS, date(2001, 12, 1), HORIZON, "test")


# --- learned model (iterative: checked on rows, and by metrics in the tests) ------------------

INPUTS = ["dow", "month", "temperature_c", "season", "day_of_week"]
FOREST_INPUTS = f"""{HOSPITAL},
holed AS (SELECT hospital_id, date, dow, month, CASE WHEN epidemic_level < 2 THEN temperature_c END AS temperature_c,
  CASE WHEN total_admissions > 300 THEN season END AS season, day_of_week FROM hospital),
known AS (SELECT * FROM holed WHERE date < DATE '2000-01-01'),
filled AS (SELECT hospital_id, date, dow, month, coalesce(temperature_c, (SELECT median(temperature_c) FROM known)) AS temperature_c,
  coalesce(season, (SELECT season FROM known WHERE season IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)) AS season, day_of_week FROM holed)"""


def holed(spark, sf):
    """Hospital days with nulls in a number and a text."""
    return hospital_days(spark, sf).select(
        "hospital_id", "date", "dow", "month", F.when(F.col("epidemic_level") < 2, F.col("temperature_c")).alias("temperature_c"),
        F.when(F.col("total_admissions") > 300, F.col("season")).alias("season"), "day_of_week", "total_admissions")


def hot(name: str, column: str, values) -> str:
    return ", ".join(f"CAST({column} = '{v}' AS INTEGER) AS {name}_{v}" for v in values)


@query("forest_inputs", f"""WITH {FOREST_INPUTS} SELECT hospital_id, date, CAST(dow AS DOUBLE) AS dow, CAST(month AS DOUBLE) AS month, round(temperature_c, 6) AS temperature_c,
  {hot("season", "season", ["autumn", "spring", "summer", "winter"])}, {hot("day_of_week", "day_of_week", sorted(DAY_NAMES))} FROM filled""")
def _(spark, sf):
    days = holed(spark, sf)
    model = Pipeline(stages=L.create_preprocessor(days.where(F.col("date") < F.lit(date(2000, 1, 1))), INPUTS)).fit(days)
    ready = model.transform(days).select("hospital_id", "date", vector_to_array("features").alias("x"))
    names = L.feature_names(model)
    numbers = ("dow", "month", "temperature_c")
    return ready.select("hospital_id", "date", *[
        F.col("x")[i].cast("double" if n in numbers else "int").alias(n) for i, n in enumerate(names)])


def labelled_days(spark, sf):
    return build_features(hospital_full(spark, sf))


_fits: dict[tuple[str, str], tuple] = {}


def trained(spark, sf):
    """One fit for all forest queries of an application: (model, metrics, test rows, saved model)."""
    key = (spark.sparkContext.applicationId, sf)
    if key not in _fits:
        train, test = L.get_train_test_split(labelled_days(spark, sf))
        model = L.train_model(train)
        # The forest is loaded once for the predictions, and the metrics are taken from them.
        predicted = written(L.predict(model, test), "predicted")
        metrics = written(A.regression_metrics(predicted, L.MODEL.target, L.PREDICTION), "metrics")
        _fits[key] = model, metrics, predicted, S.save_model(model, f"{shared_dir(spark)}/forest-{uuid.uuid4().hex}")
    return _fits[key]


@query("forest_metrics")
def _(spark, sf):
    return trained(spark, sf)[1]


@query("forest_predictions")
def _(spark, sf):
    return M.actual_and_predicted(trained(spark, sf)[2])


@query("forest_residuals")
def _(spark, sf):
    return A.residual_stats(M.actual_and_predicted(trained(spark, sf)[2]))


@query("forest_importance")
def _(spark, sf):
    return L.feature_importance(trained(spark, sf)[0], spark)


def forest_days(spark, sf):
    """The days after each site's last one, by the saved model, as an application that did not fit it would use it."""
    return M.forecast_sites(S.load_model(spark, trained(spark, sf)[3]), labelled_days(spark, sf), HORIZON)


@query("forest_forecast")
def _(spark, sf):
    return forest_days(spark, sf).select("hospital_id", "date", "predicted_admissions")


_compared: dict[tuple[str, str], object] = {}


def compared(spark, sf):
    """The three forests are fitted once for both queries on them."""
    key = (spark.sparkContext.applicationId, sf)
    if key not in _compared:
        _compared[key] = written(L.compare_feature_sets(labelled_days(spark, sf)), "compared")
    return _compared[key]


@query("feature_set_comparison")
def _(spark, sf):
    return compared(spark, sf)


# What SQL can say about a forest: which rows it predicts, and between which bounds.
CUT = """placed AS (SELECT *, row_number() OVER (ORDER BY date, hospital_id) AS place, count(*) OVER () AS n FROM hospital_full),
known AS (SELECT * FROM placed WHERE place <= floor(n * 0.8e0)),
held AS (SELECT * FROM placed WHERE place > floor(n * 0.8e0)),
bounds AS (SELECT min(total_admissions) AS low, max(total_admissions) AS high FROM known)"""


def within(df, spark, sf):
    """Whether a prediction lies between the least and the greatest target that the model learned from."""
    low, high = L.get_train_test_split(labelled_days(spark, sf))[0].agg(F.min("total_admissions"), F.max("total_admissions")).first()
    return df.withColumn("within", F.col("predicted_admissions").between(F.lit(low) - F.lit(1e-6), F.lit(high) + F.lit(1e-6)))


@query("forest_predicted_days", f"WITH RECURSIVE {HOSPITAL_FULL}, {CUT} SELECT hospital_id, date, CAST(total_admissions AS DOUBLE) AS actual, true AS within FROM held")
def _(spark, sf):
    return within(trained(spark, sf)[2], spark, sf).select("hospital_id", "date", F.col("total_admissions").cast("double").alias("actual"), "within")


@query("forest_forecast_days", f"""WITH RECURSIVE {HOSPITAL_FULL}, starts AS (SELECT hospital_id, max(date) + 1 AS start FROM hospital_full GROUP BY 1)
SELECT hospital_id, CAST(unnest(generate_series(start::TIMESTAMP, start::TIMESTAMP + INTERVAL {HORIZON - 1} DAY, INTERVAL 1 DAY)) AS DATE) AS date, true AS within FROM starts""")
def _(spark, sf):
    return within(forest_days(spark, sf), spark, sf).select("hospital_id", "date", "within")


@query("forest_metric_bounds", f"""WITH RECURSIVE {HOSPITAL_FULL}, {CUT} SELECT count(*) AS rows, true AS error_below_range, true AS mean_below_root, true AS r2_below_one FROM held""")
def _(spark, sf):
    spread = F.lit(trained(spark, sf)[2].agg(F.max("total_admissions")).first()[0]).cast("double")
    return trained(spark, sf)[1].select("rows", (F.col("mae") <= spread).alias("error_below_range"), (F.col("mae") <= F.col("rmse") + 1e-9).alias("mean_below_root"), (F.col("r2") < 1).alias("r2_below_one"))


TEXT_FEATURES = ["hospital_id", "season", "day_of_week"]


@query("forest_importance_shares", f"""WITH RECURSIVE {HOSPITAL_FULL}, {CUT} SELECT {" + ".join(f"count(DISTINCT {c})" for c in TEXT_FEATURES)} + {len(FEATURE_COLUMNS) - len(TEXT_FEATURES)} AS features,
  round(1e0, 6) AS total, true AS all_positive FROM known""")
def _(spark, sf):
    return L.feature_importance(trained(spark, sf)[0], spark, top=None).agg(
        F.count(F.lit(1)).alias("features"), F.sum("importance").alias("total"), F.bool_and(F.col("importance") >= 0).alias("all_positive"))


@query("feature_set_rows", f"""WITH RECURSIVE {HOSPITAL_FULL} SELECT unnest(['Full', 'Strong Corr', 'Realistic']) AS model, CAST(ceil(count(*) * 0.2e0) AS BIGINT) AS rows, true AS mean_below_root FROM hospital_full""")
def _(spark, sf):
    return compared(spark, sf).select("model", "rows", (F.col("mae") <= F.col("rmse") + 1e-9).alias("mean_below_root"))
