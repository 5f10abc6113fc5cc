"""Every registered query against its DuckDB oracle (small scale factor).

The driver runs the same comparison at sf0.01; here sf0.001 keeps it quick.
Set TABSENSE_ORACLE_SF to another data folder to run it elsewhere.
"""

import os

import pytest

import __spark_entry__ as E
from tabsense.plans.registry import ORACLE, QUERIES
from tests.oracle_check import compare, duck

SF_DIR = os.environ.get("TABSENSE_ORACLE_SF", "/root/testdata/sf0.001")
NAMES = sorted(QUERIES)


@pytest.fixture(scope="module")
def con():
    return duck(SF_DIR)


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_oracle(spark, con, name):
    ok, msg = compare(spark, con, name, QUERIES[name], ORACLE.get(name), SF_DIR)
    assert ok, msg


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.count() > 0 and "metric" in df.columns
