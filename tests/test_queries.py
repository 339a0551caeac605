"""Every registered query against its SQL equivalent on the smallest tables."""

import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT / "tools"))

import check_queries  # noqa: E402

import __spark_entry__ as entry  # noqa: E402
from wirevault.plans import oracle as plans_oracle  # noqa: E402
from wirevault.plans import queries as plans  # noqa: E402


@pytest.fixture(scope="module")
def oracle(small):
    return check_queries.connect(small)


def test_entry(spark):
    assert entry.entry(spark).columns[0] == "id"


def test_every_query_has_sql():
    assert set(plans.queries()) == set(plans_oracle.oracle_sql())
    assert set(plans.queries()) <= set(entry.queries())


@pytest.mark.parametrize("name", list(plans.queries()))
def test_query(spark, oracle, small, name):
    ok, note = check_queries.compare(spark, oracle, small, name)
    assert ok, note
