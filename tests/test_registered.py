import re

import pytest

import __spark_entry__ as entry
from tests.compare import connect, difference

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


def test_every_query_has_its_check():
    without = set(entry.queries()) - set(entry.oracle_sql())
    assert all(name == "pipeline" or re.match(r"op\d+_", name) for name in without)
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_flagship(spark):
    df = entry.entry(spark)
    assert df.columns == ["id", "author_id", "linked_tweet", "withheld", "linked_withheld", "user_withheld"]
    assert df.count() > 0


@pytest.mark.parametrize("name", list(entry.oracle_sql()))
def test_query_equals_its_sql(spark, con, name):
    found = difference(spark, con, entry.queries()[name], entry.oracle_sql()[name], SF)
    assert found is None, found
