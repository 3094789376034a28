"""Queries over the daily history: cleaning, filters, dashboard, windows, quality, demand."""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from bedwise.functions.labels import (
    MONTH_LABELS, SEASON_LABELS, VARIABLE_LABELS, WEEKDAY_LABELS, month_label, season_label, variable_label, weekday_label,
)
from bedwise.functions.columns import day_name_of, season_of
from bedwise.operators import aggregates as A
from bedwise.operators import demand as G
from bedwise.operators import filters as FL
from bedwise.operators import prep as P
from bedwise.operators import quality as V
from bedwise.operators import series as W
from bedwise.operators.views import raw_preview, relation_points
from bedwise.settings import HOSPITALS, MONTH_FACTORS, WEEKDAY_FACTORS
from bedwise.sources.files import export_rows, hospital_catalogue, in_date_order
from registry.core import query
from registry.tables import (
    DAILY, HOSPITAL, HOSPITAL_FULL, LEDGER, SUPPLIER, daily_facts, hospital_days, hospital_full, sql_list, sql_season,
    supplier_days, supplier_visits, table,
)

START, END = date(1997, 1, 1), date(1998, 12, 31)
BETWEEN = f"date BETWEEN DATE '{START}' AND DATE '{END}'"
MONTH_MAP = sql_list(MONTH_LABELS)
DAY_MAP = sql_list(WEEKDAY_LABELS)


def line_days(spark, sf):
    """Line items as raw rows with repeated values: many rows are equal in all columns."""
    return table(spark, sf, "lineitem").select(
        F.concat(F.lit("S"), F.col("l_suppkey").cast("string")).alias("hospital_id"),
        F.to_date("l_shipdate").alias("date"), F.col("l_returnflag").alias("season"),
        F.col("l_discount").alias("discount"), F.col("l_tax").alias("tax"),
        F.when(F.col("l_linestatus") == "O", 1.0).otherwise(0.0).alias("supply_delivery_day"),
    )


LINE_DAYS = """
line_days AS (
  SELECT 'S' || CAST(l_suppkey AS VARCHAR) AS hospital_id, CAST(l_shipdate AS DATE) AS date, l_returnflag AS season,
         l_discount AS discount, l_tax AS tax, CASE WHEN l_linestatus = 'O' THEN 1e0 ELSE 0e0 END AS supply_delivery_day
  FROM lineitem)"""


def gaps(spark, sf):
    """Orders with nulls in a number, a whole number and two texts."""
    p = F.col("o_orderpriority")
    return table(spark, sf, "orders").select(
        "o_orderkey", F.to_date("o_orderdate").alias("date"),
        F.when(p != "5-LOW", F.col("o_totalprice")).alias("price"),
        F.when(p != "1-URGENT", F.dayofmonth("o_orderdate")).alias("day_number"),
        F.when(p != "3-MEDIUM", p).alias("priority"),
        F.when(p != "2-HIGH", F.col("o_orderstatus")).alias("status"),
    )


GAPS = """
gaps AS (
  SELECT o_orderkey, CAST(o_orderdate AS DATE) AS date,
         CASE WHEN o_orderpriority <> '5-LOW' THEN o_totalprice END AS price,
         CASE WHEN o_orderpriority <> '1-URGENT' THEN CAST(day(o_orderdate) AS INTEGER) END AS day_number,
         CASE WHEN o_orderpriority <> '3-MEDIUM' THEN o_orderpriority END AS priority,
         CASE WHEN o_orderpriority <> '2-HIGH' THEN o_orderstatus END AS status
  FROM orders)"""

CALENDAR = """CAST(year({d}) AS INTEGER) AS year, CAST(month({d}) AS INTEGER) AS month, CAST(day({d}) AS INTEGER) AS day,
  CAST(isodow({d}) - 1 AS INTEGER) AS dow, CAST(week({d}) AS INTEGER) AS week,
  CAST(isodow({d}) >= 6 AS INTEGER) AS is_weekend, CAST(dayofyear({d}) AS INTEGER) AS day_of_year"""


def calendar_sql(d: str) -> str:
    return CALENDAR.format(d=d)


# --- cleaning and features --------------------------------------------------------------

@query("clean_rows", f"""WITH {LINE_DAYS}
SELECT DISTINCT hospital_id, date, season, discount, tax, CAST(supply_delivery_day AS INTEGER) AS supply_delivery_day
FROM line_days""")
def _(spark, sf):
    return P.clean_data(line_days(spark, sf))


@query("temporal_features", f"""SELECT o_orderkey, CAST(o_orderdate AS DATE) AS date, {calendar_sql('o_orderdate')} FROM orders""")
def _(spark, sf):
    return P.add_temporal_features(table(spark, sf, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("date")))


@query("season_and_day_name", f"""SELECT o_orderkey, {sql_season('month(o_orderdate)')} AS season, dayname(o_orderdate) AS day_of_week FROM orders""")
def _(spark, sf):
    return table(spark, sf, "orders").select(
        "o_orderkey", season_of(F.month("o_orderdate")).alias("season"), day_name_of(F.weekday("o_orderdate")).alias("day_of_week"))


@query("filled_gaps", f"""WITH {GAPS}, medians AS (SELECT median(price) AS p, median(day_number) AS d FROM gaps),
modes AS (
  SELECT (SELECT priority FROM gaps WHERE priority IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1) AS p,
         (SELECT status FROM gaps WHERE status IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1) AS s)
SELECT o_orderkey, date, round(coalesce(price, medians.p), 6) AS price,
       CAST(coalesce(day_number, medians.d) AS INTEGER) AS day_number,
       coalesce(priority, modes.p) AS priority, coalesce(status, modes.s) AS status
FROM gaps, medians, modes""")
def _(spark, sf):
    return P.fill_missing_values(gaps(spark, sf))


@query("preprocessed_rows", f"""WITH {GAPS}, medians AS (SELECT median(price) AS p, median(day_number) AS d FROM gaps),
modes AS (
  SELECT (SELECT priority FROM gaps WHERE priority IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1) AS p,
         (SELECT status FROM gaps WHERE status IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1) AS s)
SELECT o_orderkey, date, round(coalesce(price, medians.p), 6) AS price,
       CAST(coalesce(day_number, medians.d) AS INTEGER) AS day_number,
       coalesce(priority, modes.p) AS priority, coalesce(status, modes.s) AS status, {calendar_sql('date')}
FROM gaps, medians, modes""")
def _(spark, sf):
    return P.preprocess_data(gaps(spark, sf))


FEATURES = f"""{HOSPITAL},
features AS (
  SELECT *, CAST(dow >= 5 AS INTEGER) AS is_weekend,
         available_staff * (1 - staff_absence_rate) AS effective_staff,
         epidemic_level * staff_absence_rate AS stress_indicator,
         1500e0 / (available_beds + 1) AS bed_utilization_proxy
  FROM hospital)"""


@query("load_features", f"""WITH {FEATURES}
SELECT hospital_id, date, dow, month, is_weekend, round(effective_staff, 6) AS effective_staff,
       round(stress_indicator, 6) AS stress_indicator, round(bed_utilization_proxy, 6) AS bed_utilization_proxy
FROM features""")
def _(spark, sf):
    return P.build_features(hospital_days(spark, sf)).select(
        "hospital_id", "date", "dow", "month", "is_weekend", "effective_staff", "stress_indicator", "bed_utilization_proxy")


@query("model_table", f"""WITH {FEATURES}
SELECT hospital_id, epidemic_level, temperature_c, heatwave_event, strike_level, staff_absence_rate, available_staff,
       available_beds, scheduled_surgeries, accident_event, external_alert_level, month, dow, is_weekend, season,
       day_of_week, total_admissions
FROM features""")
def _(spark, sf):
    return P.prepare_model_data(P.build_features(hospital_days(spark, sf)))


@query("display_labels", f"""SELECT o_orderkey, {DAY_MAP}[isodow(o_orderdate)] AS jour, {MONTH_MAP}[month(o_orderdate)] AS mois,
  CASE {sql_season('month(o_orderdate)')} {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in SEASON_LABELS.items())} END AS saison
FROM orders""")
def _(spark, sf):
    day = F.col("o_orderdate")
    return table(spark, sf, "orders").select(
        "o_orderkey", weekday_label(F.weekday(day)).alias("jour"), month_label(F.month(day)).alias("mois"),
        season_label(season_of(F.month(day))).alias("saison"))


@query("raw_preview", f"""WITH {HOSPITAL}
SELECT strftime(date, '%d/%m/%Y') AS date, hospital_id, total_admissions, emergency_admissions, available_beds,
       available_staff, bed_occupancy_rate
FROM hospital ORDER BY hospital.date, hospital_id LIMIT 100""")
def _(spark, sf):
    return raw_preview(hospital_days(spark, sf))


@query("relation_points", """SELECT l_quantity AS x, l_extendedprice AS y, l_returnflag AS color FROM lineitem""")
def _(spark, sf):
    return relation_points(table(spark, sf, "lineitem"), "l_quantity", "l_extendedprice", "l_returnflag")


# --- filters ------------------------------------------------------------------------------

@query("date_range", f"""WITH {SUPPLIER} SELECT * FROM supplier_days WHERE {BETWEEN}""")
def _(spark, sf):
    return FL.between_dates(supplier_days(spark, sf), START, END)


@query("event_days", f"""WITH {HOSPITAL}
SELECT hospital_id, date, total_admissions FROM hospital
WHERE epidemic_level > 0 OR heatwave_event = 1 OR accident_event = 1""")
def _(spark, sf):
    days = FL.on_event_days(hospital_days(spark, sf), ["epidemic", "heatwave", "accident"])
    return days.select("hospital_id", "date", "total_admissions")


@query("filter_guard", f"""WITH {DAILY}
SELECT count(*) FILTER (WHERE {BETWEEN} AND strike_level > 0) = 0 AS is_empty FROM daily""")
def _(spark, sf):
    df = FL.on_event_days(FL.between_dates(daily_facts(spark, sf), START, END), ["strike"])
    return spark.range(1).select(F.lit(FL.is_empty(df)).alias("is_empty"))


@query("wording_matches", """SELECT doc_id, regexp_matches(text, '(?i)personnel|heures|system') AS matched FROM documents""")
def _(spark, sf):
    return table(spark, sf, "documents").select(
        "doc_id", FL.contains_any("text", "personnel|heures|system").alias("matched"))


WRONG_NAMES = f"""{SUPPLIER},
named AS (SELECT hospital_id, date, CASE WHEN total_admissions >= 2 THEN 'Monday' ELSE dayname(date) END AS day_of_week FROM supplier_days)"""


def stored_names(spark, sf):
    name = F.when(F.col("total_admissions") >= 2, "Monday").otherwise(day_name_of(F.weekday("date")))
    return supplier_days(spark, sf).select("hospital_id", "date", name.alias("day_of_week"))


@query("wrong_day_names", f"""WITH {WRONG_NAMES}
SELECT hospital_id, date, day_of_week, dayname(date) AS expected_day FROM named WHERE day_of_week <> dayname(date)""")
def _(spark, sf):
    return FL.wrong_day_names(stored_names(spark, sf))


# --- dashboard aggregations -----------------------------------------------------------------

KPI_SQL = """count(*) FILTER (WHERE {c}) AS days,
  {means},
  round(avg(total_admissions) FILTER (WHERE {c}) - avg(total_admissions), 6) AS admissions_delta"""


def kpi_sql(condition: str, source: str, columns) -> str:
    factors = {"avg_occupancy_pct": " * 100", "avg_cost_thousands": " * 0.001e0"}
    means = ",\n  ".join(
        f"round(avg({c}) FILTER (WHERE {condition}){factors.get(name, '')}, 6) AS {name}"
        for c, (name, _) in A.KPI_COLUMNS.items() if c in columns)
    return f"SELECT {KPI_SQL.format(c=condition, means=means)} FROM {source}"


@query("kpi_block", f"""WITH RECURSIVE {HOSPITAL_FULL} {kpi_sql(f"{BETWEEN} AND epidemic_level > 0", "hospital_full", A.KPI_COLUMNS)}""")
def _(spark, sf):
    days = hospital_full(spark, sf)
    return A.kpi_block(days, F.col("date").between(F.lit(START), F.lit(END)) & FL.event_condition(days, ["epidemic"]))


@query("kpi_all_days", f"""WITH {DAILY} {kpi_sql("true", "daily", ["total_admissions", "emergency_admissions", "pediatric_admissions", "icu_admissions", "estimated_cost_per_day"])}""")
def _(spark, sf):
    return A.kpi_block(daily_facts(spark, sf))


RESAMPLED = """{with_},
means AS (SELECT {by} {label} AS date, {avgs} FROM {source} GROUP BY ALL),
ends AS (SELECT {by} min(date)::TIMESTAMP AS lo, max(date)::TIMESTAMP AS hi FROM means GROUP BY ALL),
spine AS (SELECT {by} CAST(unnest(generate_series(lo, hi, INTERVAL {step})) AS DATE) AS date FROM ends)
SELECT {by} date, {cols} FROM spine LEFT JOIN means USING ({by} date)"""


def resample_sql(with_: str, source: str, label: str, step: str, columns, by: str = "") -> str:
    return "WITH " + RESAMPLED.format(
        with_=with_, source=source, label=label, step=step, by=by,
        avgs=", ".join(f"avg({c}) AS {c}" for c in columns), cols=", ".join(f"round({c}, 6) AS {c}" for c in columns))


WEEK = "CAST(date_trunc('week', date) AS DATE) + 6"
MONTH = "CAST(date_trunc('month', date) AS DATE)"
DAILY_NUMBERS = ["total_admissions", "emergency_admissions", "icu_admissions", "pediatric_admissions",
                 "estimated_cost_per_day", "epidemic_level", "accident_event", "strike_level", "supply_delivery_day"]


@query("weekly_resample", resample_sql(DAILY, "daily", WEEK, "7 DAY", DAILY_NUMBERS))
def _(spark, sf):
    return A.resample(daily_facts(spark, sf), "week")


@query("monthly_resample", resample_sql(DAILY, "daily", MONTH, "1 MONTH", DAILY_NUMBERS))
def _(spark, sf):
    return A.resample(daily_facts(spark, sf), "month")


@query("weekly_resample_by_site", resample_sql(SUPPLIER, "supplier_days", WEEK, "7 DAY", ["total_admissions", "patients"], "hospital_id,"))
def _(spark, sf):
    return A.resample(supplier_days(spark, sf), "week", ["hospital_id"], ["total_admissions", "patients"])


@query("mean_by_month", f"""WITH {SUPPLIER} SELECT CAST(month(date) AS INTEGER) AS month, round(avg(total_admissions), 6) AS total_admissions FROM supplier_days GROUP BY 1""")
def _(spark, sf):
    return A.mean_by(P.add_temporal_features(supplier_days(spark, sf)), "month")


@query("mean_by_weekday", f"""WITH {SUPPLIER} SELECT CAST(isodow(date) - 1 AS INTEGER) AS dow, round(avg(total_admissions), 6) AS total_admissions FROM supplier_days GROUP BY 1""")
def _(spark, sf):
    return A.mean_by(P.add_temporal_features(supplier_days(spark, sf)), "dow")


@query("mean_by_season", f"""WITH {HOSPITAL} SELECT season, round(avg(total_admissions), 6) AS total_admissions FROM hospital GROUP BY 1""")
def _(spark, sf):
    return A.mean_by(hospital_days(spark, sf), "season").orderBy("total_admissions")


LINE_NUMBERS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_linenumber"]


def corr_sql(columns, source: str) -> str:
    return " UNION ALL ".join(
        f"SELECT '{a}' AS x, '{b}' AS y, round(corr({a}, {b}), 6) AS r FROM {source}" for a in columns for b in columns)


@query("correlation_matrix", corr_sql(LINE_NUMBERS, "lineitem"))
def _(spark, sf):
    return A.correlations(table(spark, sf, "lineitem"), LINE_NUMBERS)


HOSPITAL_NUMBERS = [c for c in A.CORRELATION_COLUMNS if c not in ("medical_stock_level_pct", "total_admissions")]
TARGET_CORR = f"""{HOSPITAL},
correlated AS ({" UNION ALL ".join(f"SELECT '{c}' AS variable, CASE WHEN stddev_pop({c}) > 0 AND stddev_pop(total_admissions) > 0 THEN corr(total_admissions, {c}) END AS r FROM hospital" for c in HOSPITAL_NUMBERS)})"""


@query("target_correlations", f"""WITH {TARGET_CORR} SELECT variable, round(r, 6) AS r FROM correlated""")
def _(spark, sf):
    return A.target_correlations(hospital_days(spark, sf), HOSPITAL_NUMBERS)


VARIABLE_CASE = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in VARIABLE_LABELS.items())


@query("labelled_correlations", f"""WITH {TARGET_CORR} SELECT CASE variable {VARIABLE_CASE} ELSE variable END AS label, round(r, 3) AS r FROM correlated""")
def _(spark, sf):
    correlated = A.target_correlations(hospital_days(spark, sf), HOSPITAL_NUMBERS)
    return correlated.select(variable_label(F.col("variable")).alias("label"), "r")


@query("top_correlations", f"""WITH {TARGET_CORR},
ranked AS (SELECT variable, r, CASE WHEN r > 0 THEN 'positive' ELSE 'negative' END AS sign,
  row_number() OVER (PARTITION BY r > 0 ORDER BY abs(r) DESC, variable) AS k FROM correlated WHERE r <> 0)
SELECT variable, round(r, 6) AS r, sign FROM ranked WHERE k <= 5""")
def _(spark, sf):
    return A.top_correlations(A.target_correlations(hospital_days(spark, sf), HOSPITAL_NUMBERS))


@query("sorted_correlations", f"""WITH {TARGET_CORR} SELECT variable, round(r, 6) AS r,
  CAST(row_number() OVER (ORDER BY r DESC NULLS LAST, variable) AS INTEGER) AS place FROM correlated""")
def _(spark, sf):
    return A.sorted_correlations(A.target_correlations(hospital_days(spark, sf), HOSPITAL_NUMBERS))


def histogram_sql(column: str, source: str, with_: str = "") -> str:
    return f"""WITH {with_} ends AS (SELECT min({column}) AS lo, (max({column}) - min({column})) / 30e0 AS w FROM {source}),
counts AS (SELECT CAST(least(floor(({column} - lo) / w), 29) AS INTEGER) AS bin, count(*) AS n FROM {source}, ends WHERE {column} IS NOT NULL GROUP BY 1)
SELECT CAST(b AS INTEGER) AS bin, round(lo + b * w, 6) AS lower, round(lo + (b + 1) * w, 6) AS upper, coalesce(n, 0) AS rows
FROM range(30) t(b) CROSS JOIN ends LEFT JOIN counts ON bin = b"""


@query("histogram", histogram_sql("l_extendedprice", "lineitem"))
def _(spark, sf):
    return A.histogram(table(spark, sf, "lineitem"), "l_extendedprice")


@query("event_value_histogram", histogram_sql("value", "events"))
def _(spark, sf):
    return A.histogram(table(spark, sf, "events"), "value")


@query("weekday_box_plot", f"""SELECT CAST(isodow(ts) - 1 AS INTEGER) AS dow, min(value) AS low, round(quantile_cont(value, 0.25), 6) AS q1,
  round(median(value), 6) AS median, round(quantile_cont(value, 0.75), 6) AS q3, max(value) AS high, {DAY_MAP}[isodow(ts)] AS label
FROM events GROUP BY ALL""")
def _(spark, sf):
    rows = table(spark, sf, "events").select(F.weekday("ts").alias("dow"), "value")
    return A.weekday_box_plot(rows, "value")


def stats_sql(columns, source: str, digits: int = 3) -> str:
    return " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", round(CAST(min({c}) AS DOUBLE), {digits}) AS min, round(CAST(max({c}) AS DOUBLE), {digits}) AS max,
  round(avg({c}), {digits}) AS mean, round(stddev_samp({c}), {digits}) AS std FROM {source}""" for c in columns)


@query("column_stats", stats_sql(LINE_NUMBERS, "lineitem"))
def _(spark, sf):
    return A.column_stats(table(spark, sf, "lineitem"), LINE_NUMBERS)


@query("describe", " UNION ALL ".join(
    f"""SELECT '{c}' AS "column", count({c}) AS count, round(avg({c}), 3) AS mean, round(stddev_samp({c}), 3) AS std,
  CAST(min({c}) AS DOUBLE) AS min, CAST(max({c}) AS DOUBLE) AS max, round(CAST(quantile_cont({c}, 0.25) AS DOUBLE), 3) AS q1,
  round(CAST(median({c}) AS DOUBLE), 3) AS median, round(CAST(quantile_cont({c}, 0.75) AS DOUBLE), 3) AS q3 FROM lineitem""" for c in LINE_NUMBERS))
def _(spark, sf):
    return A.describe(table(spark, sf, "lineitem"), LINE_NUMBERS)


@query("null_counts", f"""WITH {GAPS}, counted AS ({" UNION ALL ".join(f'''SELECT '{c}' AS "column", count(*) FILTER (WHERE {c} IS NULL) AS nulls FROM gaps''' for c in ("o_orderkey", "date", "price", "day_number", "priority", "status"))})
SELECT * FROM counted WHERE nulls > 0""")
def _(spark, sf):
    return A.null_counts(gaps(spark, sf))


@query("duplicate_count", f"""WITH {LINE_DAYS}
SELECT CAST((SELECT count(*) FROM line_days) - (SELECT count(*) FROM (SELECT DISTINCT * FROM line_days)) AS BIGINT) AS duplicates""")
def _(spark, sf):
    return A.duplicate_count(line_days(spark, sf))


DATE_TEXT = """
texts AS (SELECT CASE WHEN o_orderstatus = 'P' THEN strftime(o_orderdate, '%Y-%m-%d') ELSE strftime(o_orderdate, '%d/%m/%Y') END AS date FROM orders)"""


@query("unparseable_dates", f"""WITH {DATE_TEXT} SELECT count(*) FILTER (WHERE try_strptime(date, '%d/%m/%Y') IS NULL) AS invalid_dates FROM texts""")
def _(spark, sf):
    d = F.col("o_orderdate")
    text = F.when(F.col("o_orderstatus") == "P", F.date_format(d, "yyyy-MM-dd")).otherwise(F.date_format(d, "dd/MM/yyyy"))
    return A.unparseable_dates(table(spark, sf, "orders").select(text.alias("date")), pattern="dd/MM/yyyy")


@query("coverage", f"""WITH {SUPPLIER} SELECT count(*) AS n_rows, min(date) AS first_date, max(date) AS last_date, count(DISTINCT hospital_id) AS hospitals FROM supplier_days""")
def _(spark, sf):
    return A.coverage(supplier_days(spark, sf))


@query("site_summary", f"""WITH {HOSPITAL} SELECT hospital_id, round_even(avg(total_admissions), 1) AS admissions_mean,
  round_even(stddev_samp(total_admissions), 1) AS admissions_std, round_even(avg(emergency_admissions), 1) AS emergency_mean,
  round_even(avg(available_beds), 1) AS beds_mean FROM hospital GROUP BY 1""")
def _(spark, sf):
    return A.site_summary(hospital_days(spark, sf))


@query("seasonality_contrasts", f"""WITH {SUPPLIER}, m AS (SELECT avg(total_admissions) FILTER (WHERE isodow(date) >= 6) AS weekend_mean,
  avg(total_admissions) FILTER (WHERE isodow(date) < 6) AS weekday_mean, avg(total_admissions) FILTER (WHERE month(date) IN (12, 1, 2)) AS winter_mean,
  avg(total_admissions) FILTER (WHERE month(date) IN (6, 7, 8)) AS summer_mean FROM supplier_days)
SELECT round(weekend_mean, 6) AS weekend_mean, round(weekday_mean, 6) AS weekday_mean, round(winter_mean, 6) AS winter_mean,
  round(summer_mean, 6) AS summer_mean, weekend_mean < weekday_mean AS weekend_lower, winter_mean > summer_mean AS winter_higher FROM m""")
def _(spark, sf):
    return A.seasonality_contrasts(supplier_days(spark, sf))


# --- windows and order --------------------------------------------------------------------

@query("rolling_mean", f"""WITH {SUPPLIER} SELECT hospital_id, date, total_admissions,
  round(CASE WHEN count(*) OVER w = 7 THEN avg(total_admissions) OVER w END, 6) AS rolling_mean FROM supplier_days
WINDOW w AS (PARTITION BY hospital_id ORDER BY date ROWS 6 PRECEDING)""")
def _(spark, sf):
    return W.rolling_mean(supplier_days(spark, sf).select("hospital_id", "date", "total_admissions"))


@query("naive_forecast", f"""WITH {SUPPLIER} SELECT hospital_id, date, total_admissions,
  CAST(trunc(coalesce(avg(total_admissions) OVER (PARTITION BY hospital_id ORDER BY date ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING), 4e2)) AS INTEGER)
  AS naive_pred_total_admissions FROM supplier_days""")
def _(spark, sf):
    return W.naive_forecast(supplier_days(spark, sf).select("hospital_id", "date", "total_admissions"))


SPLIT = """{with_}, ranked AS (
  SELECT hospital_id, date, total_admissions, row_number() OVER (ORDER BY date, hospital_id) AS rank, count(*) OVER () AS n FROM supplier_days)
SELECT hospital_id, date, total_admissions, CASE WHEN rank <= {cut} THEN 'train' ELSE 'test' END AS part FROM ranked"""


def split_parts(spark, sf, n_train):
    days = supplier_days(spark, sf).select("hospital_id", "date", "total_admissions")
    train, test = P.split_rows(days, n_train)
    return train.withColumn("part", F.lit("train")).unionByName(test.withColumn("part", F.lit("test")))


@query("split_of_tied_rows", f"""WITH {LINE_DAYS}, per AS (
  SELECT hospital_id, date, count(*) AS rows FROM line_days GROUP BY ALL),
run AS (SELECT *, sum(rows) OVER (ORDER BY date, hospital_id) - rows AS before, floor(sum(rows) OVER () * (1 - 0.25e0)) AS cut FROM per)
SELECT hospital_id, date, CAST(greatest(0, least(rows, cut - before)) AS BIGINT) AS train_rows,
  CAST(rows - greatest(0, least(rows, cut - before)) AS BIGINT) AS test_rows FROM run""")
def _(spark, sf):
    """Several rows, some of them equal, for a date and site."""
    train, test = P.get_train_test_split(line_days(spark, sf), 0.25)
    both = train.withColumn("t", F.lit(1)).unionByName(test.withColumn("t", F.lit(0)))
    return both.groupBy("hospital_id", "date").agg(F.sum("t").cast("bigint").alias("train_rows"), F.sum(1 - F.col("t")).cast("bigint").alias("test_rows"))


@query("chronological_split", "WITH " + SPLIT.format(with_=SUPPLIER, cut="floor(n * (1 - 0.2e0))"))
def _(spark, sf):
    return split_parts(spark, sf, P.rounded_down(0.2))


@query("unshuffled_split", "WITH " + SPLIT.format(with_=SUPPLIER, cut="n - ceil(n * 0.2e0)"))
def _(spark, sf):
    return split_parts(spark, sf, P.rest_rounded_up(0.2))


@query("years_elapsed", f"""WITH {SUPPLIER} SELECT hospital_id, date, CAST(year(date) - min(year(date)) OVER (PARTITION BY hospital_id) AS INTEGER) AS years_elapsed FROM supplier_days""")
def _(spark, sf):
    return W.years_elapsed(supplier_days(spark, sf).select("hospital_id", "date"))


@query("centred_load", f"""WITH {SUPPLIER} SELECT hospital_id, date, round(CAST(patients AS DOUBLE) / total_admissions
  - avg(CAST(patients AS DOUBLE) / total_admissions) OVER (PARTITION BY hospital_id), 6) AS load FROM supplier_days""")
def _(spark, sf):
    df = W.centred(supplier_days(spark, sf), F.col("patients") / F.col("total_admissions"), "load")
    return df.select("hospital_id", "date", "load")


@query("day_index", f"""WITH {SUPPLIER} SELECT hospital_id, date, CAST(row_number() OVER (PARTITION BY hospital_id ORDER BY date) - 1 AS INTEGER) AS day_index FROM supplier_days""")
def _(spark, sf):
    return W.day_index(supplier_days(spark, sf).select("hospital_id", "date"))


@query("last_90_rows", f"""WITH {SUPPLIER} SELECT hospital_id, date, total_admissions FROM supplier_days
QUALIFY row_number() OVER (PARTITION BY hospital_id ORDER BY date DESC) <= 90""")
def _(spark, sf):
    return W.last_rows(supplier_days(spark, sf).select("hospital_id", "date", "total_admissions"))


@query("event_spells", f"""WITH {SUPPLIER}, runs AS (SELECT hospital_id, date, epidemic_level AS level,
  date - CAST(row_number() OVER (PARTITION BY hospital_id, epidemic_level ORDER BY date) AS INTEGER) AS run FROM supplier_days WHERE epidemic_level <> 0)
SELECT hospital_id, level, min(date) AS start_date, max(date) AS end_date, count(*) AS days FROM runs GROUP BY hospital_id, level, run""")
def _(spark, sf):
    return W.event_spells(supplier_days(spark, sf), "epidemic_level")


@query("epidemic_spells", f"""WITH {DAILY}, runs AS (SELECT hospital_id, date, epidemic_level AS level,
  date - CAST(row_number() OVER (PARTITION BY hospital_id, epidemic_level ORDER BY date) AS INTEGER) AS run FROM daily WHERE epidemic_level <> 0)
SELECT hospital_id, level, min(date) AS start_date, max(date) AS end_date, count(*) AS days FROM runs GROUP BY hospital_id, level, run""")
def _(spark, sf):
    return W.event_spells(daily_facts(spark, sf), "epidemic_level")


@query("stock_ledger", f"""WITH RECURSIVE {SUPPLIER},{LEDGER.format(source='supplier_days')}
SELECT hospital_id, date, round_even(level, 1) AS medical_stock_level_pct FROM walked""")
def _(spark, sf):
    return W.stock_ledger(supplier_days(spark, sf).select("hospital_id", "date", "supply_delivery_day")).drop("supply_delivery_day")


@query("date_order", f"""WITH {DAILY} SELECT hospital_id, date, total_admissions FROM daily ORDER BY date""")
def _(spark, sf):
    return in_date_order(daily_facts(spark, sf).select("hospital_id", "date", "total_admissions"))


# --- unions, catalogue, export ------------------------------------------------------------

@query("union_by_name", f"""WITH {DAILY}, {SUPPLIER}
SELECT hospital_id, date, total_admissions, epidemic_level, emergency_admissions, CAST(NULL AS BIGINT) AS patients FROM daily
UNION ALL SELECT hospital_id, date, total_admissions, epidemic_level, NULL, patients FROM supplier_days""")
def _(spark, sf):
    regions = daily_facts(spark, sf).select("hospital_id", "date", "total_admissions", "epidemic_level", "emergency_admissions")
    suppliers = supplier_days(spark, sf).select("hospital_id", "date", "total_admissions", "epidemic_level", "patients")
    return P.union_all([regions, suppliers])


SITE_OF_NATION = "CASE n_nationkey % 16 " + " ".join(f"WHEN {i} THEN '{h[0]}'" for i, h in enumerate(HOSPITALS)) + " END"


@query("sites_with_data", f"""WITH catalogue(hospital_id, name, file) AS (VALUES {", ".join(str(h) for h in HOSPITALS)}),
seen AS (SELECT {SITE_OF_NATION} AS hospital_id FROM customer JOIN nation ON c_nationkey = n_nationkey)
SELECT hospital_id, name, file FROM catalogue WHERE hospital_id IN (SELECT hospital_id FROM seen WHERE hospital_id IS NOT NULL)""")
def _(spark, sf):
    site = F.try_element_at(F.array(*[F.lit(h[0]) for h in HOSPITALS]), (F.col("n_nationkey") % 16 + 1).cast("int"))
    seen = table(spark, sf, "customer").join(table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).select(site.alias("hospital_id")).distinct()
    return hospital_catalogue(spark).join(seen, "hospital_id", "left_semi")


@query("export_rows", f"""WITH {DAILY} SELECT hospital_id, strftime(date, '%d/%m/%Y') AS date, total_admissions, emergency_admissions,
  icu_admissions, pediatric_admissions, estimated_cost_per_day, epidemic_level, accident_event, strike_level, supply_delivery_day
FROM daily WHERE {BETWEEN}""")
def _(spark, sf):
    return export_rows(FL.between_dates(daily_facts(spark, sf), START, END))


# --- quality ------------------------------------------------------------------------------

def flawed(spark, sf):
    """Daily facts with negative counts, nulls and rates out of range."""
    total, level = F.col("total_admissions"), F.col("epidemic_level")
    return daily_facts(spark, sf).select(
        "hospital_id", "date",
        F.when(total > 1, total).otherwise(-total).alias("total_admissions"),
        F.when(level < 2, F.col("icu_admissions")).alias("icu_admissions"),
        (level * F.lit(0.4)).alias("bed_occupancy_rate"),
        (level - F.lit(0.5)).alias("staff_absence_rate"),
    )


FLAWED = f"""{DAILY},
flawed AS (
  SELECT hospital_id, date, CASE WHEN total_admissions > 1 THEN total_admissions ELSE -total_admissions END AS total_admissions,
         CASE WHEN epidemic_level < 2 THEN icu_admissions END AS icu_admissions,
         epidemic_level * 0.4e0 AS bed_occupancy_rate, epidemic_level - 0.5e0 AS staff_absence_rate
  FROM daily)"""
FLAWED_COLUMNS = ["hospital_id", "date", "total_admissions", "icu_admissions", "bed_occupancy_rate", "staff_absence_rate"]


def issue_sql(parts: list[tuple], source: str = "flawed") -> str:
    """(ord, column, type, measure, text before, text after, severity, failing condition)"""
    union = " UNION ALL ".join(
        f"""SELECT {o} AS ord, '{c}' AS "column", '{t}' AS issue_type, {m} AS m, '{a}' AS a, '{b}' AS b, '{s}' AS severity, {f.format(m=m)} AS fails FROM {source}"""
        for o, c, t, m, a, b, s, f in parts)
    return f"""found AS ({union})
SELECT CAST(ord AS INTEGER) AS ord, "column", issue_type, a || CAST(m AS VARCHAR) || b AS message, severity FROM found WHERE fails"""


NEGATIVE = [(i, c, "negative_values", f"count(*) FILTER (WHERE {c} < 0)", "", " negative values found", "error", "{m} > 0")
            for i, c in ((1, "total_admissions"), (2, "icu_admissions"))]
CAPACITY_ISSUES = [
    (1, "bed_occupancy_rate", "constraint_violation", "count(*) FILTER (WHERE bed_occupancy_rate > 1)", "", " days with occupancy > 100%", "warning", "{m} > 0"),
    (2, "staff_absence_rate", "out_of_range", "count(*) FILTER (WHERE staff_absence_rate < 0 OR staff_absence_rate > 1)", "", " values outside [0, 1]", "error", "{m} > 0"),
]
MISSING = [(i + 1, c, "missing_values", f"count(*) FILTER (WHERE {c} IS NULL)", "", " missing values", "warning", "{m} > 0")
           for i, c in enumerate(FLAWED_COLUMNS)]
RANGE = [(1, "date", "incomplete_range", "max(year(date))", "Data ends at ", ", expected 2025", "error", "{m} < 2025")]


def _shift(parts, by):
    return [(o + by, *rest) for o, *rest in parts]


@query("negative_counts", f"WITH {FLAWED}, {issue_sql(NEGATIVE)}")
def _(spark, sf):
    return V.validate_no_negative_counts(flawed(spark, sf))


@query("capacity_constraints", f"WITH {FLAWED}, {issue_sql(CAPACITY_ISSUES)}")
def _(spark, sf):
    return V.validate_capacity_constraints(flawed(spark, sf))


@query("missing_values", f"WITH {FLAWED}, {issue_sql(MISSING)}")
def _(spark, sf):
    return V.validate_missing_values(flawed(spark, sf))


@query("date_range_check", f"WITH {FLAWED}, {issue_sql(RANGE)}")
def _(spark, sf):
    return V.validate_date_range(flawed(spark, sf))


ABSENT = ", ".join(c for c in V.REQUIRED_COLUMNS if c not in FLAWED_COLUMNS)
REPORT = [
    (0, "schema", "missing_columns", f"'{ABSENT}'", "Missing columns: ", "", "error", "count(*) >= 0"),
    *NEGATIVE, *_shift(CAPACITY_ISSUES, 2), *_shift(MISSING, 4), *_shift(RANGE, 4 + len(MISSING)),
]


@query("validation_issues", f"WITH {FLAWED}, {issue_sql(REPORT)}")
def _(spark, sf):
    return V.validate_dataset(flawed(spark, sf)).issues


@query("validation_summary", f"""WITH {FLAWED} SELECT count(*) AS n_rows, CAST(6 AS INTEGER) AS n_cols, min(date) AS first_date, max(date) AS last_date, false AS is_valid FROM flawed""")
def _(spark, sf):
    return V.validate_dataset(flawed(spark, sf)).summary


@query("validation_stats", f"WITH {FLAWED} {stats_sql(FLAWED_COLUMNS[2:], 'flawed')}")
def _(spark, sf):
    return V.validate_dataset(flawed(spark, sf)).column_stats


DRIFT_COLUMNS = ["total_admissions", "emergency_admissions", "icu_admissions", "pediatric_admissions", "estimated_cost_per_day", "epidemic_level"]


def drift_sql(columns, new: str, old: str) -> str:
    both = " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", (SELECT avg({c}) FROM {new}) AS gm, (SELECT avg({c}) FROM {old}) AS rm,
  (SELECT stddev_samp({c}) FROM {new}) AS gs, (SELECT stddev_samp({c}) FROM {old}) AS rs""" for c in columns)
    return f"""both_sides AS ({both}), compared AS (
SELECT "column", round_even(gm, 2) AS gen_mean, round_even(rm, 2) AS ref_mean, round_even(abs(gm - rm) / (rm + 1e-9) * 100, 1) AS mean_diff_pct,
  round_even(gs, 2) AS gen_std, round_even(rs, 2) AS ref_std, round_even(abs(gs - rs) / (rs + 1e-9) * 100, 1) AS std_diff_pct,
  CASE WHEN abs(gm - rm) / (rm + 1e-9) * 100 < 25e0 THEN 'OK' ELSE 'DRIFT' END AS status FROM both_sides)"""


DRIFT = f"""{DAILY}, new_days AS (SELECT * FROM daily WHERE date >= DATE '1998-01-01'), old_days AS (SELECT * FROM daily WHERE date < DATE '1998-01-01'),
{drift_sql(DRIFT_COLUMNS, "new_days", "old_days")}"""


def drift(spark, sf):
    days = daily_facts(spark, sf).select("hospital_id", "date", *DRIFT_COLUMNS)
    return V.compare_parts(days, F.col("date") >= F.lit(date(1998, 1, 1)), columns=DRIFT_COLUMNS)


@query("drift_comparison", f"WITH {DRIFT} SELECT * FROM compared")
def _(spark, sf):
    return drift(spark, sf)


LINE_DRIFT = f"""{SUPPLIER}, new_days AS (SELECT * FROM supplier_days WHERE total_admissions > 1), old_days AS (SELECT * FROM supplier_days WHERE total_admissions = 1),
{drift_sql(["total_admissions", "patients", "epidemic_level"], "new_days", "old_days")}"""


@query("drifted_columns", f"WITH {LINE_DRIFT} SELECT * FROM compared WHERE status = 'DRIFT'")
def _(spark, sf):
    days = supplier_days(spark, sf)
    return FL.drifted(V.compare_parts(days, F.col("total_admissions") > 1, columns=["total_admissions", "patients", "epidemic_level"]))


@query("calendar_consistency", f"""WITH {WRONG_NAMES}, stored AS (SELECT date, day_of_week, CAST(isodow(date) - 1 AS INTEGER) AS dow, CAST(month(date - 3) AS INTEGER) AS month FROM named)
SELECT count(*) FILTER (WHERE dow IS DISTINCT FROM isodow(date) - 1) AS dow_mismatches, count(*) FILTER (WHERE month IS DISTINCT FROM month(date)) AS month_mismatches,
  count(*) FILTER (WHERE day_of_week IS DISTINCT FROM dayname(date)) AS day_name_mismatches,
  count(*) FILTER (WHERE day_of_week IN ('Saturday', 'Sunday')) AS named_weekend_days, count(*) FILTER (WHERE isodow(date) >= 6) AS computed_weekend_days FROM stored""")
def _(spark, sf):
    stored = stored_names(spark, sf).withColumns({"dow": F.weekday("date"), "month": F.month(F.date_sub("date", 3))})
    return V.calendar_consistency(stored)


def profile_sql(columns: list[tuple[str, str, str]], source: str, digits: int = 3) -> str:
    """(name, Spark type, kind rule) per column; numeric kinds are decided from the values."""
    rows = []
    for i, (c, dtype, family) in enumerate(columns):
        if family == "number":
            whole = dtype in ("int", "bigint")
            ratio = any(w in c for w in V.RATIO_WORDS)
            rest = "'ratio'" if ratio else f"CASE WHEN min({c}) >= 0 THEN 'count' ELSE 'continuous' END" if whole else "'continuous'"
            kind = f"CASE WHEN count(DISTINCT {c}) = 2 AND min({c}) = 0 AND max({c}) = 1 THEN 'binary' ELSE {rest} END"
            moments = f"CAST(min({c}) AS DOUBLE) AS min, CAST(max({c}) AS DOUBLE) AS max, avg({c}) AS mean, stddev_samp({c}) AS std"
        else:
            kind = f"'{family}'"
            moments = "CAST(NULL AS DOUBLE) AS min, CAST(NULL AS DOUBLE) AS max, CAST(NULL AS DOUBLE) AS mean, CAST(NULL AS DOUBLE) AS std"
        rows.append(f"""SELECT {i} AS position, '{c}' AS "column", {kind} AS type, '{dtype}' AS dtype,
  CAST(count(*) FILTER (WHERE {c} IS NULL) AS DOUBLE) / count(*) AS na_rate, {moments} FROM {source}""")
    return f"""profiled AS ({" UNION ALL ".join(rows)})
SELECT CAST(position AS INTEGER) AS position, "column", type, dtype, round(na_rate, {digits}) AS na_rate, round(min, {digits}) AS min, round(max, {digits}) AS max,
  round(mean, {digits}) AS mean, round(std, {digits}) AS std, CASE WHEN type IN ('categorical', 'date') THEN NULL
  WHEN type = 'count' AND std * std < mean * 2 THEN 'poisson' ELSE 'normal' END AS distribution FROM profiled"""


DAILY_PROFILE = [
    ("hospital_id", "string", "categorical"), ("date", "date", "date"), ("total_admissions", "int", "number"),
    ("emergency_admissions", "int", "number"), ("icu_admissions", "int", "number"), ("pediatric_admissions", "int", "number"),
    ("estimated_cost_per_day", "double", "number"), ("epidemic_level", "int", "number"), ("accident_event", "int", "number"),
    ("strike_level", "int", "number"), ("supply_delivery_day", "int", "number"),
]


@query("column_profile", f"WITH {DAILY}, {profile_sql(DAILY_PROFILE, 'daily')}")
def _(spark, sf):
    return V.column_profile(daily_facts(spark, sf))


@query("line_profile", "WITH " + profile_sql([
    ("l_orderkey", "bigint", "number"), ("l_partkey", "bigint", "number"), ("l_suppkey", "bigint", "number"), ("l_linenumber", "int", "number"),
    ("l_quantity", "double", "number"), ("l_extendedprice", "double", "number"), ("l_discount", "double", "number"), ("l_tax", "double", "number"),
    ("l_returnflag", "string", "categorical"), ("l_linestatus", "string", "categorical"), ("l_shipdate", "timestamp_ntz", "date")], "lineitem"))
def _(spark, sf):
    return V.column_profile(table(spark, sf, "lineitem"))


@query("column_kinds", f"""WITH {FLAWED}, {profile_sql([("hospital_id", "string", "categorical"), ("date", "date", "date"), ("total_admissions", "int", "number"), ("icu_admissions", "int", "number"), ("bed_occupancy_rate", "double", "number"), ("staff_absence_rate", "double", "number")], 'flawed').replace("SELECT CAST(position", ', listed AS (SELECT CAST(position')}) SELECT "column", type FROM listed""")
def _(spark, sf):
    return V.column_profile(flawed(spark, sf)).select("column", "type")


@query("categorical_values", """SELECT 'l_returnflag' AS "column", l_returnflag AS value, count(*) AS rows FROM lineitem GROUP BY 2
UNION ALL SELECT 'l_linestatus', l_linestatus, count(*) FROM lineitem GROUP BY 2""")
def _(spark, sf):
    return V.categorical_values(table(spark, sf, "lineitem"))


ANALYSED = ["total_admissions", "emergency_admissions", "icu_admissions", "pediatric_admissions", "epidemic_level"]


@query("analysis_correlations", f"WITH {DAILY} {corr_sql(ANALYSED, 'daily')}")
def _(spark, sf):
    return V.analyze_dataset(daily_facts(spark, sf)).correlations


# --- demand and operations ----------------------------------------------------------------

@query("calendar_spine", f"""WITH sites AS (SELECT DISTINCT 'S' || CAST(l_suppkey AS VARCHAR) AS hospital_id FROM lineitem)
SELECT hospital_id, CAST(unnest(generate_series(TIMESTAMP '2001-01-01', TIMESTAMP '2001-03-31', INTERVAL 1 DAY)) AS DATE) AS date FROM sites""")
def _(spark, sf):
    return G.calendar_spine(supplier_visits(spark, sf).select("hospital_id").distinct(), date(2001, 1, 1), date(2001, 3, 31))


@query("expected_demand", f"""WITH {HOSPITAL}
SELECT hospital_id, date, CAST(trunc(least(greatest(4e2 * ((1 + (year(date) - min(year(date)) OVER (PARTITION BY hospital_id)) * 0.008e0)
  * {sql_list(WEEKDAY_FACTORS)}[dow + 1] * {sql_list(MONTH_FACTORS)}[month]
  * (1 + epidemic_level * 0.1e0) * (1 + heatwave_event * 0.06e0) * (1 + accident_event * 0.4e0)), 250e0), 620e0)) AS INTEGER) AS expected_demand
FROM hospital""")
def _(spark, sf):
    return G.expected_demand(hospital_days(spark, sf)).select("hospital_id", "date", "expected_demand")


@query("department_split", f"""WITH {HOSPITAL}, cal AS (SELECT avg(total_admissions) AS t, avg(emergency_admissions) AS e, avg(pediatric_admissions) AS p,
  avg(icu_admissions) AS i, avg(scheduled_surgeries) AS s FROM hospital WHERE hospital_id = 'ASIA'),
parts AS (SELECT hospital_id, date, total_admissions, CAST(trunc(total_admissions * (e / t)) AS INTEGER) AS emergency_admissions,
  CAST(trunc(total_admissions * (p / t)) AS INTEGER) AS pediatric_admissions,
  CAST(trunc(total_admissions * (i / t) * (1 + epidemic_level * 0.12e0)) AS INTEGER) AS icu_admissions,
  CAST(trunc(least(greatest(s * (1 - strike_level * 0.25e0) - CAST(dow >= 5 AS INTEGER) * 18, 15e0), 55e0)) AS INTEGER) AS scheduled_surgeries FROM hospital, cal)
SELECT *, CAST(trunc(emergency_admissions * 0.6e0) AS INTEGER) AS ambulance_arrivals FROM parts""")
def _(spark, sf):
    days = hospital_days(spark, sf)
    split = G.department_split(days, G.Calibration(days.where(F.col("hospital_id") == "ASIA")))
    return split.select("hospital_id", "date", "total_admissions", "emergency_admissions", "pediatric_admissions",
                        "icu_admissions", "scheduled_surgeries", "ambulance_arrivals")


@query("operational_measures", f"""WITH {HOSPITAL} SELECT hospital_id, date, bed_occupancy_rate, staff_absence_rate, waiting_time_avg_min,
  avg_patient_severity, temperature_c, estimated_cost_per_day, patient_satisfaction_score FROM hospital""")
def _(spark, sf):
    return hospital_days(spark, sf).select(
        "hospital_id", "date", "bed_occupancy_rate", "staff_absence_rate", "waiting_time_avg_min", "avg_patient_severity",
        "temperature_c", "estimated_cost_per_day", "patient_satisfaction_score")


@query("alerts_and_resources", f"""WITH {HOSPITAL} SELECT hospital_id, date, external_alert_level, available_beds, available_staff FROM hospital""")
def _(spark, sf):
    return hospital_days(spark, sf).select("hospital_id", "date", "external_alert_level", "available_beds", "available_staff")


@query("daily_table", f"""WITH RECURSIVE {HOSPITAL_FULL} SELECT * FROM hospital_full""")
def _(spark, sf):
    return hospital_full(spark, sf)
