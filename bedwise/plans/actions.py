"""Prioritised actions from projected days."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bedwise.functions.columns import lookup, percent_text
from bedwise.functions.labels import PRIORITY_LABELS
from bedwise.operators.filters import contains_any
from bedwise.settings import CAPACITY, CSV, Capacity

# --- fixed values ---------------------------------------------------------
# Priorities from the most to the least urgent, and action names.
CRITICAL, HIGH, MEDIUM, LOW = (PRIORITY_LABELS[p] for p in ("CRITICAL", "HIGH", "MEDIUM", "LOW"))
PRIORITY_RANK = {CRITICAL: 1, HIGH: 2, MEDIUM: 3, LOW: 4}
PRIORITY_WEIGHT = {CRITICAL: 4, HIGH: 3, MEDIUM: 2, LOW: 1}
ACTIONS = {
    "ADD_BEDS": "Ajouter des lits temporaires",
    "ADD_STAFF": "Demander du personnel supplémentaire",
    "OVERTIME": "Autoriser les heures supplémentaires",
    "REDISTRIBUTE": "Redistribuer les patients",
    "STOCK_REPLENISH": "Réapprovisionner les fournitures",
    "DELAY_ELECTIVE": "Reporter les interventions programmées",
    "ALERT_ADMIN": "Alerter l'administration",
    "ACTIVATE_SURGE": "Activer le protocole de surcharge",
    "EXTERNAL_SUPPORT": "Demander un renfort externe",
    "MONITOR": "Continuer la surveillance",
}

RECOMMENDATION_COLUMNS = ["date", "ord", "action", "priority", "description", "quantity", "unit"]


def _rule(ord_: int, action: str, priority, description, quantity=None, unit: str | None = None) -> Column:
    def text(x):
        return F.lit(x) if x is None or isinstance(x, str) else x

    return F.struct(
        F.lit(ord_).alias("ord"), F.lit(ACTIONS[action]).alias("action"), text(priority).alias("priority"),
        text(description).alias("description"),
        (F.lit(None) if quantity is None else quantity).cast("double").alias("quantity"),
        F.lit(unit).cast("string").alias("unit"),
    )


def generate_recommendations(
    scenario_df: DataFrame, capacity: Capacity = CAPACITY, keep: Sequence[str] = ("scenario", "hospital_id"),
) -> DataFrame:
    """All actions of each day, one row each; ``ord`` is their order within the day.

    Columns absent from the input take the value of an uneventful day.
    """

    def given(name: str, default) -> Column:
        return F.col(name) if name in scenario_df.columns else F.lit(default)

    gap = given("capacity_gap", 0.0).cast("double")
    occupancy = given("occupancy_rate", 0.0).cast("double")
    staff = given("effective_staff", capacity.total_staff).cast("double")
    stock = given("effective_stock_pct", 75.0).cast("double")
    over, critical = given("is_overcapacity", False), given("is_critical", False)

    beds = F.ceil(gap * F.lit(1.1)).cast("int")
    share = F.try_divide(staff, F.lit(float(capacity.total_staff)))
    needed = ((F.lit(float(capacity.total_staff)) - staff) * F.lit(0.8)).cast("int")
    surge = over & (gap > 50)
    busy = ~over & (occupancy > F.lit(capacity.warning_occupancy))
    rules = [
        (surge, _rule(
            1, "ACTIVATE_SURGE", CRITICAL,
            F.concat(F.lit("Activer le protocole de surcharge - "), gap.cast("int").cast("string"),
                     F.lit(" au-dessus de la capacité")), beds, "lits")),
        (surge, _rule(
            2, "EXTERNAL_SUPPORT", CRITICAL, "Demander le soutien des hôpitaux voisins",
            (gap * F.lit(0.3)).cast("int"), "transferts")),
        (over & (gap > 0) & (gap <= 50), _rule(3, "ADD_BEDS", HIGH, "Ajouter des lits temporaires", beds, "lits")),
        (share < 0.7, _rule(4, "ADD_STAFF", CRITICAL, "Pénurie critique de personnel", needed, "personnel")),
        ((share >= 0.7) & (share < 0.85), _rule(
            5, "OVERTIME", HIGH, "Autoriser les heures supplémentaires", needed * 4, "heures")),
        (busy, _rule(
            6, "ALERT_ADMIN", MEDIUM, F.concat(F.lit("Occupation à "), percent_text(occupancy)),
            occupancy * 100, "% occupation")),
        (busy & (occupancy > 0.8), _rule(
            7, "DELAY_ELECTIVE", MEDIUM, "Envisager de reporter les interventions programmées")),
        (stock < F.lit(capacity.min_stock_pct), _rule(
            8, "STOCK_REPLENISH", F.when(stock < 40, HIGH).otherwise(MEDIUM),
            F.concat(F.lit("Fournitures à "), F.rint(stock).cast("int").cast("string"), F.lit("%")),
            F.lit(capacity.min_stock_pct) - stock + 20, "% stock")),
        (critical, _rule(9, "REDISTRIBUTE", HIGH, "Redistribuer les patients entre les services")),
    ]
    fired = F.filter(F.array(*[F.when(c, r) for c, r in rules]), lambda r: r.isNotNull())
    monitor = F.array(_rule(10, "MONITOR", LOW, "Opérations normales"))
    day = given("date", None).cast(scenario_df.schema["date"].dataType if "date" in scenario_df.columns else "date")
    kept = [c for c in keep if c in scenario_df.columns]
    return (
        scenario_df.select(*kept, day.alias("date"), fired.alias("fired"))
        .select(*kept, "date", F.inline(F.when(F.size("fired") > 0, F.col("fired")).otherwise(monitor)))
        .select(*kept, *RECOMMENDATION_COLUMNS)
    )


def _rank() -> Column:
    return F.coalesce(lookup(F.col("priority"), PRIORITY_RANK), F.lit(4))


def get_priority_actions(recommendations: DataFrame, max_priority: str = HIGH) -> DataFrame:
    """Actions at least as urgent as ``max_priority``, the most urgent first, then by date.

    Site, scenario and rule order follow in the key, so that range partitioning can divide a date's actions.
    """
    more = [c for c in ("hospital_id", "scenario", "ord") if c in recommendations.columns]
    return recommendations.where(_rank() <= PRIORITY_RANK[max_priority]).orderBy(_rank(), "date", *more)


def _urgent() -> Column:
    return F.col("priority").isin(CRITICAL, HIGH)


def summarize_recommendations(recommendations: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    group = recommendations.groupBy(*by) if by else recommendations
    return group.agg(
        F.count(F.lit(1)).alias("total_recommendations"),
        F.count_if(F.col("priority") == CRITICAL).alias("critical_count"),
        F.count_if(F.col("priority") == HIGH).alias("high_count"),
        F.count_distinct(F.when(_urgent(), F.col("date"))).alias("dates_with_issues"),
    )


def count_by_priority(recommendations: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return recommendations.groupBy(*by, "priority").agg(F.count(F.lit(1)).alias("actions"))


def top_actions(recommendations: DataFrame, n: int = 10) -> DataFrame:
    """The most frequent actions."""
    counts = recommendations.groupBy("action").agg(F.count(F.lit(1)).alias("actions"))
    return counts.orderBy(F.desc("actions"), "action").limit(n)


def resource_needs(recommendations: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Beds, overtime hours and stock alerts, selected by the wording of the action.

    Rows are summed per action and unit first, so that only the few different actions are searched for words.
    """
    per = recommendations.groupBy(*by, "action", "unit").agg(F.sum("quantity").alias("quantity"), F.count(F.lit(1)).alias("rows"))
    group = per.groupBy(*by) if by else per
    beds = contains_any("action", "lits")
    staff = contains_any("action", "personnel|heures")
    stock = contains_any("action", "fournitures|stock")

    def rows_of(kind: Column) -> Column:
        return F.coalesce(F.sum(F.when(kind, F.col("rows"))), F.lit(0))

    return group.agg(
        F.sum(F.when(beds, F.col("quantity"))).alias("extra_beds"), rows_of(beds).alias("bed_actions"),
        F.sum(F.when(staff & (F.col("unit") == "heures"), F.col("quantity"))).alias("overtime_hours"),
        rows_of(staff).alias("staff_actions"), rows_of(stock).alias("stock_alerts"),
    )


def needs_by_unit(recommendations: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Total quantity per unit; unlike ``resource_needs`` it includes the surge beds."""
    return recommendations.where(F.col("unit").isNotNull()).groupBy(*by, "unit").agg(F.sum("quantity").alias("quantity"))


def action_timeline(recommendations: DataFrame) -> DataFrame:
    return recommendations.withColumn("priority_value", lookup(F.col("priority"), PRIORITY_WEIGHT))


def alert_level(summary: DataFrame) -> DataFrame:
    """Banner level of a summary: alert, attention or fine."""
    level = F.when(F.col("critical_count") > 0, "alert").when(F.col("high_count") > 0, "attention").otherwise("fine")
    return summary.withColumn("alert", level)


def action_report(
    recommendations: DataFrame, scenario: str, params: Mapping[str, object], start, horizon: int, generated: str,
) -> DataFrame:
    """The text report as ``(section, date, hospital_id, ord, part, line)``; sorted by all but the last it reads top to bottom.

    Entries of a table with several sites name their site.
    """
    from datetime import timedelta

    end = start + timedelta(days=horizon - 1)
    total = summarize_recommendations(recommendations)

    def count(name: str) -> Column:
        return F.col(name).cast("string")

    head = [
        F.lit("RAPPORT D'ACTIONS"), F.lit("================="), F.lit(""),
        F.lit(f"Scénario : {scenario}"), F.lit(f"Période : {start:%d/%m/%Y} au {end:%d/%m/%Y}"),
        F.lit(f"Généré le : {generated}"), F.lit(""), F.lit("RÉSUMÉ"), F.lit("------"),
        F.concat(F.lit("- Actions Critiques : "), count("critical_count")),
        F.concat(F.lit("- Priorité Haute : "), count("high_count")),
        F.concat(F.lit("- Total Recommandations : "), count("total_recommendations")),
        F.concat(F.lit("- Jours avec Problèmes : "), count("dates_with_issues"), F.lit(f"/{horizon}")),
        F.lit(""), F.lit("PARAMÈTRES DU SCÉNARIO"), F.lit("----------------------"),
        F.lit(f"- Intensité Épidémique : +{params['epidemic_intensity']}%"),
        F.lit(f"- Réduction Personnel : {params['staffing_reduction']}%"),
        F.lit(f"- Multiplicateur Saisonnier : x{params['seasonal_multiplier']}"),
        F.lit(f"- Réduction Lits : {params['beds_reduction']}%"),
        F.lit(f"- Réduction Stocks : {params['stock_reduction']}%"), F.lit(""),
    ]
    no_day, no_site = F.lit(None).cast("date").alias("date"), F.lit(None).cast("string").alias("hospital_id")
    has_site = "hospital_id" in recommendations.columns
    lines = total.select(
        F.lit(0).alias("section"), no_day, no_site, F.lit(0).alias("ord"),
        F.posexplode(F.array(*head)).alias("part", "line"),
    )
    titles = [(1, "ACTIONS CRITIQUES", "-----------------"), (2, "ACTIONS PRIORITÉ HAUTE", "----------------------")]
    rows = [F.struct(
        F.lit(s).alias("section"), no_day, no_site, F.lit(0).alias("ord"), F.lit(i).alias("part"), F.lit(t).alias("line"),
    ) for s, *texts in titles for i, t in enumerate(texts)]
    lines = lines.unionByName(recommendations.sparkSession.range(1).select(F.inline(F.array(*rows))))
    entry = F.array(
        F.concat(F.lit("["), F.date_format("date", CSV.date_pattern), F.lit("] "), *([F.col("hospital_id"), F.lit(" : ")] if has_site else []), F.col("action")),
        F.concat(F.lit("  → "), F.col("description")), F.lit(""),
    )
    items = recommendations.where(_urgent()).select(
        F.when(F.col("priority") == CRITICAL, 1).otherwise(2).alias("section"), F.col("date").cast("date").alias("date"),
        F.col("hospital_id") if has_site else no_site, "ord", F.posexplode(entry).alias("part", "line"),
    )
    return lines.unionByName(items)
