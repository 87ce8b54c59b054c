"""Every query against its SQL on the smallest test data, without cross joins or Python."""

import os

import pytest

import __spark_entry__ as contract
from staylens.plans import registry
from tests.test_plans import plan
from tools.check_oracle import connect, rows

SF_DIR = "/root/testdata/sf0.001"
registry.load_all()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test data")


def test_contract(spark):
    assert set(contract.oracle_sql()) <= set(contract.queries())
    assert contract.entry(spark).count() > 0


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_matches_sql(spark, name):
    df = registry.QUERIES[name](spark, SF_DIR)
    ours = df.toPandas()
    for word in ("CartesianProduct", "NestedLoopJoin", "EvalPython", "MapInPandas"):
        assert word not in plan(df), word
    theirs = connect(SF_DIR).execute(registry.ORACLES[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert rows(ours) == rows(theirs)


WITHOUT_SQL = sorted(set(registry.QUERIES) - set(registry.ORACLES))


@pytest.mark.parametrize("name", [n for n in WITHOUT_SQL if n not in ("score_unseen", "cv_tune")])
def test_fit_queries_run(spark, name):
    assert registry.QUERIES[name](spark, SF_DIR).count() > 0
