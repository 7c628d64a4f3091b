"""Every registered query against its SQL on the smallest tables."""

import duckdb
import pytest

from sparkassay.plans import catalogue
from sparkassay.sources.tables import TABLES
from tools.parity import rows_of

ROOT = "/root/testdata/sf0.001"
QUERIES, ORACLES = catalogue.queries(), catalogue.oracles()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{ROOT}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(spark, duck, name):
    df = QUERIES[name](spark, ROOT)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    res = duck.execute(ORACLES[name])
    want = rows_of([d[0] for d in res.description], res.fetchall())
    assert got[1] == want[1]
    assert got[0] == want[0]


def test_names():
    assert set(ORACLES) <= set(QUERIES)
    assert set(QUERIES) - set(ORACLES) == {"topk_ann"}
