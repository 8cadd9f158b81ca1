"""Every registered report query at sf0.01: against its SQL, or that it runs."""

import os

import oracle
import pytest

from reportlake import queries as Q

SF = "/root/testdata/sf0.01"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    return oracle.connect(SF)


@pytest.mark.parametrize("name", sorted(Q.QUERIES))
def test_query(spark, con, name):
    df = Q.QUERIES[name](spark, SF)
    if name in Q.ORACLE_SQL:
        assert oracle.compare(df, con, Q.ORACLE_SQL[name]) == []
    else:
        assert df.count() >= 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
