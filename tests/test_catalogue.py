import pytest

import __spark_entry__ as entry
from treeloom.oracle import ORACLE
from treeloom.queries import CATALOGUE
from compare import differences, oracle_connection

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return oracle_connection(FOLDER)


def test_every_query_has_an_oracle():
    assert set(CATALOGUE) == set(ORACLE) and set(CATALOGUE) <= set(entry.queries())


@pytest.mark.parametrize("name", list(CATALOGUE))
def test_query_equals_oracle(spark, con, name):
    assert differences(entry.queries()[name](spark, FOLDER), con, entry.oracle_sql()[name]) is None


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() == 5
