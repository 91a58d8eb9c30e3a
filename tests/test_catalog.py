"""Every registered query beside its SQL on the smallest tables."""

from pathlib import Path

import pytest

from compare import connect, difference
from tallymark.catalog import all_oracles, all_queries

SF = "/root/testdata/sf0.001"

pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="no test tables")


@pytest.fixture(scope="session")
def duck():
    return connect(SF)


def test_oracles_name_queries():
    assert set(all_oracles()) <= set(all_queries())


@pytest.mark.parametrize("name", sorted(all_queries()))
def test_query(spark, duck, name):
    assert difference(spark, duck, all_queries()[name], all_oracles().get(name), SF) is None
