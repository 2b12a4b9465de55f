"""Every registered query against its SQL twin; the rest must run and give rows.

TWIN_SF_DIR picks another scale (the driver checks sf0.01).
"""

import os

import pytest
import twins

import __spark_entry__ as contract

SF = os.environ.get("TWIN_SF_DIR", "/root/testdata/sf0.001")
QUERIES, ORACLE = contract.queries(), contract.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return twins.connect(SF)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_twin(spark, con, name):
    assert twins.compare(QUERIES[name](spark, SF), con, ORACLE[name]) == []


def test_registry():
    assert set(ORACLE) <= set(QUERIES)


def test_entry(spark):
    out = contract.entry(spark)
    assert out.count() == 5
    assert out.columns == ["series_id", "n", "RMSE", "MAE", "R2", "mean_ma7", "weekend_days", "test_start"]
