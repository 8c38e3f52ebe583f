"""Every registered query of the library against its SQL twin."""

import pytest

import __spark_entry__ as entry
from tests.helpers import same_rows
from timeloom import plans


@pytest.fixture
def sf_dir():
    return "/root/testdata/sf0.01"  # the smallest size has a repeated clip id


@pytest.mark.parametrize("name", sorted(plans.oracle_sql()))
def test_against_sql(spark, sf_dir, name):
    same_rows(plans.queries()[name](spark, sf_dir), plans.oracle_sql()[name], sf_dir)


@pytest.mark.parametrize("name", sorted(set(plans.queries()) - set(plans.oracle_sql())))
def test_runs(spark, sf_dir, name):
    assert plans.queries()[name](spark, sf_dir).count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
