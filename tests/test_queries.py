"""Every core query against its SQL on the smallest tables."""

import os

import pytest

from cairn.plans import catalog
from verify_sql import connect, rows_of

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
ORACLES = catalog.oracle_sql()


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", catalog.queries())
def test_query(spark, name):
    df = catalog.queries()[name](spark, SF)
    got = rows_of(df.columns, df.collect())
    if name in ORACLES:
        cur = connect(SF).execute(ORACLES[name])
        cols = [c[0] for c in cur.description]
        assert sorted(cols) == sorted(df.columns) and got == rows_of(cols, cur.fetchall())
