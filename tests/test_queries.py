"""Every named query against its checking SQL on the small tables."""

import __spark_entry__ as entry
import pytest
from compare import SF_DIR, connect, difference

QUERIES, ORACLES = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    df = QUERIES[name](spark, SF_DIR)
    if name in ORACLES:
        assert difference(df, con, ORACLES[name]) is None
    else:
        assert df.count() > 0


def test_entry(spark):
    rows = entry.entry(spark).collect()
    assert rows and sum(r["share_pct"] for r in rows) == pytest.approx(100)


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)
