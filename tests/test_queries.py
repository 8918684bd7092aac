"""Every registered query beside its SQL twin."""

import pytest

from marketlens.plans import check
from marketlens.plans.registry import QUERIES, TWINS
from tests.conftest import SMALL



@pytest.fixture(scope="module")
def con():
    return check.duck(SMALL)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query_equals_twin(spark, con, name):
    ok, note = check.compare(spark, SMALL, name, con)
    assert ok, note


def test_only_raw_predictions_lack_a_twin():
    assert set(QUERIES) - set(TWINS) == {"forest_predictions"}


def test_names():
    assert not [n for n in QUERIES if n == "pipeline" or n.startswith("op")]


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).limit(1).count() == 1
    assert entry.queries().keys() >= QUERIES.keys()
    assert entry.oracle_sql().items() >= TWINS.items()
