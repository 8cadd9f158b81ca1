"""Registered queries of the training-data operators against their SQL."""

import os

import oracle
import pytest

from reportlake.llm import entries

SF = "/root/testdata/sf0.01"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.mark.parametrize("name", sorted(entries.ORACLE_SQL))
def test_query(spark, name):
    assert oracle.compare(entries.QUERIES[name](spark, SF), oracle.connect(SF), entries.ORACLE_SQL[name]) == []
