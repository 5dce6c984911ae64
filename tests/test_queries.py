"""Every registered query against its oracle SQL, and that those without one give rows of a stable schema."""

import pytest

from compare import DATA, rows, views
from tidegauge import registry
from tidegauge.session import prepare

ORACLES = registry.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    return views(DATA)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_against_oracle(spark, duck, name):
    found = registry.queries()[name](prepare(spark), DATA).toPandas()
    expected = duck.execute(ORACLES[name]).df()
    assert sorted(found.columns) == sorted(expected.columns)
    assert rows(found) == rows(expected)


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(ORACLES)))
def test_without_oracle(spark, name):
    found = registry.queries()[name](prepare(spark), DATA)
    assert len(found.columns) == len(set(found.columns))
    found.limit(5).collect()


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 5
    assert set(ORACLES) <= set(__spark_entry__.queries())
