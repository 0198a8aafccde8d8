"""Registered queries of the package beside their SQL, on the smallest test tables."""

import os

import pytest

import __spark_entry__ as contract
from tallyframe.llm.queries import ORACLES, QUERIES
from tallyframe.workload.check import compare, connect

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="test tables not present")


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query(spark, name):
    ok, note = compare(spark, connect(SF_DIR), SF_DIR, QUERIES[name], ORACLES[name])
    assert ok, note


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_a_row_per_row(spark, name):
    found = QUERIES[name](spark, SF_DIR)
    assert found.count() == spark.read.parquet(f"{SF_DIR}/documents.parquet").count()


def test_all_are_registered():
    assert set(QUERIES) | {"pipeline"} <= set(contract.queries())
    assert sorted(int(q[2:].split("_")[0]) for q in QUERIES) == [n for n in range(1, 14)]
