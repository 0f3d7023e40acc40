"""Every registered query against its SQL on the smallest tables."""

import pytest

from __spark_entry__ import entry
from conftest import SF_SMALL
from logweave.plans.oracles import ORACLES
from logweave.plans.queries import QUERIES
from oracle_check import connect, differences


SF_LARGER = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def con():
    return connect(SF_SMALL)


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    why = differences(spark, con, name, SF_SMALL)
    if why == "no rows":  # what it looks for begins further on than the smallest table reaches
        why = differences(spark, connect(SF_LARGER), name, SF_LARGER)
    assert why == ""


def test_entry(spark):
    df = entry(spark)
    assert df.columns[:4] == ["source_id", "epoch", "n_events", "bytes"] and df.count() > 0
