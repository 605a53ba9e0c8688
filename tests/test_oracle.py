"""Every query with SQL gives exactly the rows of that SQL; the others give rows."""

import pytest

import __spark_entry__ as entry
from rigspark import catalog
from tests.oracle import compare, duck

QUERIES, ORACLES = catalog.queries(), catalog.oracle_sql()
TRAINED = {"random_forest", "gbt", "mlp_regress", "model_scores", "retrain_clean", "learning_curve", "hyper_search", "cross_validate",
           "feature_importance", "run_in_model"}


@pytest.fixture(scope="module")
def con(data):
    return duck(data)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_equals_sql(spark, con, data, name):
    assert compare(spark, con, QUERIES[name], ORACLES[name], data) is None


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES) - TRAINED))
def test_gives_rows(spark, data, name):
    assert QUERIES[name](spark, data).count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_oracles_have_queries():
    assert set(ORACLES) <= set(QUERIES)
