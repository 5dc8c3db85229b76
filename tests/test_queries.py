"""Every query of the ledger against its SQL on the smallest tables."""

import os

import pytest

from ledgerloom.plans import queries
from tests.compare import agree

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.mark.parametrize("name", list(queries.QUERIES))
def test_query(spark, name):
    if name in queries.SQL:
        agree(spark, SF, name, queries.QUERIES[name], queries.SQL[name])
    else:
        assert queries.QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
