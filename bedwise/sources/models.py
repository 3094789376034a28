"""Saved models, baselines and reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bedwise.operators.prep import union_all
from bedwise.operators.quality import ISSUE_COLUMNS, ValidationReport
from bedwise.plans.baseline import baseline_from_rows, baseline_rows
from bedwise.sources.files import DataNotFoundError, _glob


def save_model(model: PipelineModel, path: str, metrics: DataFrame | None = None) -> str:
    """The fitted pipeline, and its metrics beside it."""
    model.write().overwrite().save(f"{path}/model")
    if metrics is not None:
        metrics.write.mode("overwrite").json(f"{path}/metrics")
    return path


def load_model(spark: SparkSession, path: str) -> PipelineModel:
    if not _glob(spark, f"{path}/model"):
        raise DataNotFoundError(f"no model at {path}")
    return PipelineModel.load(f"{path}/model")


def load_metrics(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.json(f"{path}/metrics")


def save_baseline(baseline: DataFrame, path: str, by: Sequence[str] = ()) -> str:
    """One table in long format, written by one job, so the fit is computed once and a saved baseline is replaced as a whole."""
    baseline_rows(baseline, by).write.mode("overwrite").parquet(path)
    return path


def load_baseline(spark: SparkSession, path: str, by: Sequence[str] = ()) -> DataFrame:
    if not _glob(spark, f"{path}/_SUCCESS"):
        raise DataNotFoundError(f"no baseline at {path}")
    return baseline_from_rows(spark.read.parquet(path), by)


REPORT_COLUMNS = {
    "summary": ["n_rows", "n_cols", "first_date", "last_date", "is_valid"],
    "issues": ISSUE_COLUMNS,
    "column_stats": ["column", "min", "max", "mean", "std"],
    "comparison": ["column", "gen_mean", "ref_mean", "mean_diff_pct", "gen_std", "ref_std", "std_diff_pct", "status"],
}


def save_validation_report(report: ValidationReport, path: str) -> None:
    """All parts of a report as one table: ``part`` names the part, columns of other parts are null."""
    tables = [(n, getattr(report, n)) for n in REPORT_COLUMNS if getattr(report, n) is not None]
    union_all([t.withColumn("part", F.lit(n)) for n, t in tables]).write.mode("overwrite").parquet(path)


def load_validation_report(spark: SparkSession, path: str) -> ValidationReport:
    """The report as saved; its comparison is None where none was saved."""
    if not _glob(spark, f"{path}/_SUCCESS"):
        raise DataNotFoundError(f"no report at {path}")
    rows = spark.read.parquet(path)
    parts = {n: rows.where(F.col("part") == n).select(*columns) for n, columns in REPORT_COLUMNS.items() if set(columns) <= set(rows.columns)}
    return ValidationReport(parts["summary"], parts["issues"], parts["column_stats"], parts.get("comparison"))


def write_action_report(lines: DataFrame, path: str) -> None:
    """The report lines as text, top to bottom across the part files."""
    lines.orderBy("section", "date", "hospital_id", "ord", "part").select("line").write.mode("overwrite").text(path)
