"""The queries of the subpackage against their SQL on the smallest tables."""

from pathlib import Path

import duckdb
import pytest
from ledgerleaf.llm import queries, sql

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(FOLDER).exists(), reason="no test tables")


@pytest.mark.parametrize("name", sorted(sql.SQL))
def test_sql(spark, name):
    con = duckdb.connect()
    for p in Path(FOLDER).glob("*.parquet"):
        con.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    df = queries.queries()[name](spark, FOLDER)
    columns = sorted(df.columns)
    want = con.sql(sql.SQL[name])
    assert sorted(want.columns) == columns
    order = lambda rows: sorted((tuple(repr(x) if isinstance(x, float) else str(x) for x in r) for r in rows), key=str)
    assert order(tuple(r[c] for c in columns) for r in df.collect()) == order(want.select(", ".join(f'"{c}"' for c in columns)).fetchall())


def test_names():
    assert [n.split("_")[0] for n in sorted(queries.queries(), key=lambda n: int(n[2:].split("_")[0]))] == [f"op{i}" for i in range(1, 11)]
