"""Every query of the problems on the smallest tables: against its SQL where it has one, else for its columns."""

import os

import pytest

from cairn.llm import queries
from verify_sql import connect, rows_of

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
FOUND = {
    "p1_found": ["probe_id", "token"], "p2_found": ["query_id", "doc_id"], "p4_found": ["config_id", "token", "mark"], "p5_found": ["doc_id", "kind", "pos"],
    "p6_found": ["doc_id_a", "doc_id_b"], "p7_found": ["probe_id", "neighbour"], "p10_found": ["doc_id", "subject"],
}


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", queries.QUERIES)
def test_query(spark, name):
    df = queries.QUERIES[name](spark, SF)
    got = rows_of(df.columns, df.collect())
    if name in FOUND:
        assert df.columns == FOUND[name] and len(set(got)) == len(got)
    if name in queries.ORACLES:
        cur = connect(SF).execute(queries.ORACLES[name])
        cols = [c[0] for c in cur.description]
        assert sorted(cols) == sorted(df.columns) and got == rows_of(cols, cur.fetchall())
