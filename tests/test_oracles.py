"""Every registered query of the library against its SQL, on the smallest tables."""

import os

import pytest

from formledger.plans import registry
from tests.oracle import SMALL, both

pytestmark = pytest.mark.skipif(not os.path.isdir(SMALL), reason="no test tables here")


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_same_rows_as_sql(spark, name):
    names, columns, ours, theirs = both(spark, registry.QUERIES[name], registry.ORACLES[name])
    assert names == columns
    assert ours == theirs


@pytest.mark.parametrize("name", ["g1_ink_runs", "g11_row_sequence", "g18_resolve_boxes"])
def test_gives_rows(spark, name):
    assert registry.QUERIES[name](spark, SMALL).count() > 0
