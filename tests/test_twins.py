"""Every query beside its SQL twin, on the smallest tables."""

import pytest

from melisma.plans import catalogue
from tests.compare import compare, connect

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(DATA)


@pytest.mark.parametrize("name", sorted(catalogue.queries()))
def test_query_equals_its_twin(spark, con, name):
    rows, said = compare(spark, con, DATA, name, catalogue.queries()[name], catalogue.twins().get(name))
    assert said in ("equal", "rows only"), said
