"""Every query of the engine against its SQL on the smallest tables."""

from pathlib import Path

import duckdb
import pytest
from ledgerleaf.plans import catalogue

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(FOLDER).exists(), reason="no test tables")


def plain(rows):
    return sorted((tuple(repr(x) if isinstance(x, float) else str(x) for x in r) for r in rows), key=str)


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for p in Path(FOLDER).glob("*.parquet"):
        c.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return c


@pytest.mark.parametrize("name", sorted(catalogue.queries()))
def test_query(spark, con, name):
    df = catalogue.queries()[name](spark, FOLDER)
    columns = sorted(df.columns)
    got = plain(tuple(r[c] for c in columns) for r in df.collect())
    if sql := catalogue.oracle_sql().get(name):
        want = con.sql(sql)
        assert sorted(want.columns) == columns
        assert got == plain(want.select(", ".join(f'"{c}"' for c in columns)).fetchall())
    else:
        assert got


def test_entry(spark):
    import __spark_entry__

    assert set(catalogue.queries()) <= set(__spark_entry__.queries())
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert __spark_entry__.entry(spark).count() > 0
