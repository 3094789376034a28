"""Daily tables built from the generic test tables, in Spark and in SQL.

``region_days``    orders per (region, day)
``daily_facts``    its columns under the names of the daily schema
``hospital_days``  the daily schema filled with the demand and operations relations
``hospital_full``  the same with the stock ledger and the naive forecast: all 30 columns
``supplier_days``  line items per (supplier, day); sites grow with the data
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from bedwise.functions.columns import rounded_int
from bedwise.operators.demand import (
    available_resources, department_split, external_alert, operational_measures, with_calendar,
)
from bedwise.operators.series import naive_forecast, stock_ledger
from bedwise.schema import DAILY_TYPES

FIRST_DAY = date(1995, 1, 1)
ACCIDENT_PRICE = 490_000.0


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def region_days(spark: SparkSession, sf: str) -> DataFrame:
    orders, customer = table(spark, sf, "orders"), table(spark, sf, "customer")
    nation, region = table(spark, sf, "nation"), table(spark, sf, "region")
    priority, status = F.col("o_orderpriority"), F.col("o_orderstatus")
    # The dimensions are joined to each other first, so an order is joined once.
    placed = (
        customer.join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
        .join(region, F.col("n_regionkey") == F.col("r_regionkey"))
        .select("c_custkey", "c_mktsegment", "r_name")
    )
    return (
        orders.join(placed, F.col("o_custkey") == F.col("c_custkey"))
        .groupBy(F.col("r_name").alias("hospital_id"), F.to_date("o_orderdate").alias("date"))
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.count_if(priority.isin("1-URGENT", "2-HIGH")).alias("n_emergency"),
            F.count_if(priority == "1-URGENT").alias("n_icu"),
            F.count_if(F.col("c_mktsegment") == "HOUSEHOLD").alias("n_pediatric"),
            F.sum(F.round(F.col("o_totalprice") * 100).cast("bigint")).alias("cents"),
            F.max("o_totalprice").alias("top_price"),
            F.bool_and(status == "P").alias("all_p"),
            F.bool_and(status == "F").alias("all_f"),
        )
    )


def _flag(condition: Column) -> Column:
    return condition.cast("int")


def _events() -> dict[str, Column]:
    epidemic = F.least(F.lit(3), F.col("n_icu")).cast("int")
    return {
        "epidemic_level": epidemic,
        "accident_event": _flag(F.col("top_price") > ACCIDENT_PRICE),
        "strike_level": _flag(F.col("all_p")),
        "supply_delivery_day": _flag(F.pmod(F.datediff("date", F.lit(FIRST_DAY)), F.lit(4)) == 0),
    }


def daily_facts(spark: SparkSession, sf: str) -> DataFrame:
    return region_days(spark, sf).select(
        "hospital_id", "date", F.col("n").cast("int").alias("total_admissions"),
        F.col("n_emergency").cast("int").alias("emergency_admissions"),
        F.col("n_icu").cast("int").alias("icu_admissions"),
        F.col("n_pediatric").cast("int").alias("pediatric_admissions"),
        (F.col("cents") / 100).alias("estimated_cost_per_day"),
        *[c.alias(n) for n, c in _events().items()],
    )


def hospital_days(spark: SparkSession, sf: str) -> DataFrame:
    """Counts are scaled so that each site's mean demand is 400, the level the capacities are for."""
    k = F.lit(400.0) / F.avg("n").over(Window.partitionBy("hospital_id"))

    def scaled(c: str) -> Column:
        return rounded_int(F.col(c) * F.col("k"))

    df = region_days(spark, sf).withColumn("k", k)
    df = df.withColumns(_events() | {
        "heatwave_event": _flag(F.month("date").isin(6, 7, 8) & (F.col("n_icu") == 0)),
        "it_system_outage": _flag(F.col("all_f")),
        "total_admissions": scaled("n"),
    })
    df = department_split(external_alert(with_calendar(df)))
    df = df.withColumns({
        "emergency_admissions": scaled("n_emergency"), "icu_admissions": scaled("n_icu"),
        "pediatric_admissions": scaled("n_pediatric"),
    })
    df = df.withColumn("ambulance_arrivals", (F.col("emergency_admissions") * F.lit(0.6)).cast("int"))
    df = operational_measures(available_resources(df))
    return df.select(*[c for c in DAILY_TYPES if c in df.columns])


def hospital_full(spark: SparkSession, sf: str) -> DataFrame:
    df = stock_ledger(naive_forecast(hospital_days(spark, sf)))
    return df.select(*DAILY_TYPES)


def supplier_days(spark: SparkSession, sf: str) -> DataFrame:
    return (
        table(spark, sf, "lineitem")
        .groupBy("l_suppkey", F.to_date("l_shipdate").alias("date"))
        .agg(
            F.count(F.lit(1)).cast("int").alias("total_admissions"),
            F.sum(F.col("l_quantity").cast("bigint")).alias("patients"),
            F.count_if(F.col("l_returnflag") == "R").cast("int").alias("epidemic_level"),
            F.max(_flag(F.col("l_linestatus") == "O")).alias("supply_delivery_day"),
        )
        .select(F.concat(F.lit("S"), F.col("l_suppkey").cast("string")).alias("hospital_id"), "*").drop("l_suppkey")
    )


def supplier_visits(spark: SparkSession, sf: str) -> DataFrame:
    """Site and day of every row, for what needs no count per day."""
    return table(spark, sf, "lineitem").select(
        F.concat(F.lit("S"), F.col("l_suppkey").cast("string")).alias("hospital_id"), F.to_date("l_shipdate").alias("date"))


# --- the same tables as SQL common table expressions -----------------------------------

REGION_DAYS = """
region_days AS (
  SELECT r_name AS hospital_id, CAST(o_orderdate AS DATE) AS date, count(*) AS n,
         count(*) FILTER (WHERE o_orderpriority IN ('1-URGENT', '2-HIGH')) AS n_emergency,
         count(*) FILTER (WHERE o_orderpriority = '1-URGENT') AS n_icu,
         count(*) FILTER (WHERE c_mktsegment = 'HOUSEHOLD') AS n_pediatric,
         CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS BIGINT) AS cents,
         max(o_totalprice) AS top_price,
         bool_and(o_orderstatus = 'P') AS all_p, bool_and(o_orderstatus = 'F') AS all_f
  FROM orders JOIN customer ON o_custkey = c_custkey
  JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
  GROUP BY 1, 2)"""

_EVENTS = f"""
         CAST(least(3, n_icu) AS INTEGER) AS epidemic_level,
         CAST(top_price > {ACCIDENT_PRICE} AS INTEGER) AS accident_event,
         CAST(all_p AS INTEGER) AS strike_level,
         CAST((date - DATE '{FIRST_DAY}') % 4 = 0 AS INTEGER) AS supply_delivery_day"""

DAILY = f"""{REGION_DAYS},
daily AS (
  SELECT hospital_id, date, CAST(n AS INTEGER) AS total_admissions,
         CAST(n_emergency AS INTEGER) AS emergency_admissions, CAST(n_icu AS INTEGER) AS icu_admissions,
         CAST(n_pediatric AS INTEGER) AS pediatric_admissions,
         cents / 1e2 AS estimated_cost_per_day, {_EVENTS}
  FROM region_days)"""


def sql_season(month: str) -> str:
    return (f"CASE WHEN {month} IN (12, 1, 2) THEN 'winter' WHEN {month} IN (3, 4, 5) THEN 'spring' "
            f"WHEN {month} IN (6, 7, 8) THEN 'summer' ELSE 'autumn' END")


def sql_list(values) -> str:
    return "[" + ", ".join(f"'{v}'" if isinstance(v, str) else f"{float(v)}e0" for v in values) + "]"


HOSPITAL = f"""{REGION_DAYS},
scaled AS (
  SELECT *, 4e2 / avg(n) OVER (PARTITION BY hospital_id) AS k,
         CAST(isodow(date) - 1 AS INTEGER) AS dow, CAST(month(date) AS INTEGER) AS month, {_EVENTS}
  FROM region_days),
counted AS (
  SELECT hospital_id, date, dow, month, dayname(date) AS day_of_week, {sql_season('month')} AS season,
         CAST(month IN (6, 7, 8) AND n_icu = 0 AS INTEGER) AS heatwave_event,
         epidemic_level, strike_level, accident_event,
         CAST(round_even(n * k, 0) AS INTEGER) AS total_admissions,
         CAST(round_even(n_emergency * k, 0) AS INTEGER) AS emergency_admissions,
         CAST(round_even(n_pediatric * k, 0) AS INTEGER) AS pediatric_admissions,
         CAST(round_even(n_icu * k, 0) AS INTEGER) AS icu_admissions,
         supply_delivery_day, CAST(all_f AS INTEGER) AS it_system_outage
  FROM scaled),
resourced AS (
  SELECT *,
         CAST(trunc(least(greatest(1450e0 - strike_level * 0.10e0 * 1450e0, 1200e0), 1600e0)) AS INTEGER) AS available_beds,
         CAST(trunc(least(greatest(425e0 - strike_level * 425e0 * 0.15e0 - epidemic_level * 3, 370e0), 460e0)) AS INTEGER) AS available_staff,
         CAST(trunc(least(greatest(42e0 * (1 - strike_level * 0.25e0) - CAST(dow >= 5 AS INTEGER) * 18, 15e0), 55e0)) AS INTEGER) AS scheduled_surgeries,
         CAST(trunc(emergency_admissions * 0.6e0) AS INTEGER) AS ambulance_arrivals,
         CAST(least(greatest(epidemic_level + accident_event + heatwave_event * 2 - 1, 0), 2) AS INTEGER) AS external_alert_level
  FROM counted),
loaded AS (
  SELECT *, total_admissions / available_staff - avg(total_admissions / available_staff) OVER (PARTITION BY hospital_id) AS load
  FROM resourced),
measured AS (
  SELECT * EXCLUDE (load),
         round_even(least(greatest(CAST(total_admissions AS DOUBLE) / available_beds * 0.85e0, 0.30e0), 0.72e0), 3) AS bed_occupancy_rate,
         round_even(least(greatest(0.07e0 + epidemic_level * 0.012e0 + strike_level * 0.025e0, 0.04e0), 0.14e0), 2) AS staff_absence_rate,
         CAST(trunc(least(greatest(47e0 + load * 25 + epidemic_level * 8, 15e0), 115e0)) AS INTEGER) AS waiting_time_avg_min,
         round_even(least(greatest(2.3e0 + epidemic_level * 0.20e0, 2e0), 3.8e0), 1) AS avg_patient_severity,
         round_even(least(greatest([4e0, 5e0, 9e0, 13e0, 17e0, 21e0, 24e0, 23e0, 19e0, 13e0, 8e0, 5e0][month] + heatwave_event * 7, -6e0), 38e0), 1) AS temperature_c,
         CAST(trunc(60000e0 * 0.7e0 + total_admissions * 35 + icu_admissions * 180) AS INTEGER) AS estimated_cost_per_day
  FROM loaded),
hospital AS (
  SELECT *, round_even(least(greatest(7.5e0 + -0.015e0 * (waiting_time_avg_min - 47) + -0.08e0 * epidemic_level, 5.5e0), 8.5e0), 2) AS patient_satisfaction_score
  FROM measured)"""

# The ledger walks each site's days in order; RECURSIVE must follow WITH.
LEDGER = """
numbered AS (
  SELECT hospital_id, date, supply_delivery_day, row_number() OVER (PARTITION BY hospital_id ORDER BY date) AS rn
  FROM {source}),
walked AS (
  SELECT hospital_id, date, rn, 72e0 AS level FROM numbered WHERE rn = 1
  UNION ALL
  SELECT n.hospital_id, n.date, n.rn,
         least(greatest(w.level + (n.supply_delivery_day * 7e0 - 1.8e0), 40e0), 95e0)
  FROM walked w JOIN numbered n ON n.hospital_id = w.hospital_id AND n.rn = w.rn + 1)"""

HOSPITAL_FULL = f"""{HOSPITAL},{LEDGER.format(source='hospital')},
hospital_full AS (
  SELECT h.*, round_even(w.level, 1) AS medical_stock_level_pct,
         CAST(trunc(coalesce(avg(total_admissions) OVER (PARTITION BY h.hospital_id ORDER BY h.date
              ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING), 4e2)) AS INTEGER) AS naive_pred_total_admissions
  FROM hospital h JOIN walked w ON h.hospital_id = w.hospital_id AND h.date = w.date)"""

SUPPLIER = """
supplier_days AS (
  SELECT 'S' || CAST(l_suppkey AS VARCHAR) AS hospital_id, CAST(l_shipdate AS DATE) AS date,
         CAST(count(*) AS INTEGER) AS total_admissions,
         CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS patients,
         CAST(count(*) FILTER (WHERE l_returnflag = 'R') AS INTEGER) AS epidemic_level,
         max(CAST(l_linestatus = 'O' AS INTEGER)) AS supply_delivery_day
  FROM lineitem GROUP BY 1, 2)"""
