"""Every registered query of the library against its SQL, on the smallest tables."""

import os

import pytest

from tessera import plans  # noqa: F401  (registers the queries)
from tessera.registry import ORACLES, QUERIES
from tests import oracle

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    return oracle.duck(SF)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_oracle(spark, con, name):
    assert oracle.differences(QUERIES[name](spark, SF), ORACLES[name], con) == ""


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_rows(spark, name):
    assert QUERIES[name](spark, SF).count() > 0
