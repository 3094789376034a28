import importlib.util
import os

import pytest

import __spark_entry__ as entry
from registry.all import ORACLE

SF = "/root/testdata/sf0.001"
ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are absent")


@pytest.fixture(scope="module")
def check():
    spec = importlib.util.spec_from_file_location("check_oracle", os.path.join(ROOT, "scripts", "check_oracle.py"))
    module = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(module)
    return module


@pytest.fixture(scope="module")
def con(check):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in check.TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_has_one_row_per_scenario(spark):
    df = entry.entry(spark)
    assert df.columns[0] == "scenario" and df.count() == 6


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_its_sql(spark, check, con, name):
    assert check.compare(entry.queries()[name](spark, SF), con.sql(entry.oracle_sql()[name])) == []


def test_results_do_not_depend_on_partitioning_or_broadcast(spark, check, con):
    old = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.autoBroadcastJoinThreshold")}
    spark.conf.set("spark.sql.shuffle.partitions", "3")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for name in ("recommendation_summary", "weekday_box_plot", "drift_comparison"):
            assert check.compare(entry.queries()[name](spark, SF), con.sql(entry.oracle_sql()[name])) == []
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


def test_forest_queries_fit_the_configured_model_on_all_features(spark):
    """The model that the queries above have fitted, not a smaller one."""
    from bedwise.operators.prep import get_feature_columns
    from bedwise.plans.learning import feature_sources
    from bedwise.settings import MODEL
    from registry.projection import trained

    model, metrics, predicted, path = trained(spark, SF)
    forest = model.stages[-1]
    assert (forest.getNumTrees, forest.getOrDefault("maxDepth")) == (MODEL.trees, MODEL.depth) == (300, 20)
    assert {c for c, _ in feature_sources(model)} == set(get_feature_columns()) and len(get_feature_columns()) == 17
    assert metrics.first()["rows"] == predicted.count() > 0
