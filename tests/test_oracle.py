"""Every panel query with SQL gives DuckDB's rows on the smallest tables."""

import math
import os
from pathlib import Path

import duckdb
import pytest

from panelspark import queries as panels

DATA = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.001")


def rows(cursor_rows, names):
    order = sorted(range(len(names)), key=names.__getitem__)

    def value(v):
        if isinstance(v, bool) or not isinstance(v, (int, float)):
            return str(v)
        return "nan" if math.isnan(v) else f"{float(v) + 0.0:.10g}"

    return sorted(tuple(value(row[i]) for i in order) for row in cursor_rows)


@pytest.mark.parametrize("name", sorted(panels.queries()))
def test_query(spark, name):
    df = panels.queries()[name](spark, DATA)
    got = df.collect()
    if name not in panels.oracle_sql():
        assert df.columns
        return
    con = duckdb.connect()
    for p in Path(DATA).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    cur = con.execute(panels.oracle_sql()[name])
    names = [c[0] for c in cur.description]
    assert sorted(names) == sorted(df.columns)
    assert rows([tuple(r) for r in got], df.columns) == rows(cur.fetchall(), names)
