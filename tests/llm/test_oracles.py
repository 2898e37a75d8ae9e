"""The training-text queries that SQL can express, against it."""

import os

import pytest

from formledger.llm import registry
from tests.oracle import SMALL, both

pytestmark = pytest.mark.skipif(not os.path.isdir(SMALL), reason="no test tables here")


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_same_rows_as_sql(spark, name):
    names, columns, ours, theirs = both(spark, registry.QUERIES[name], registry.ORACLES[name])
    assert names == columns
    assert ours == theirs
