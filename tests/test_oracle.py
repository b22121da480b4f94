"""Each query with SQL gives that SQL's rows on the smallest tables."""

from pathlib import Path

import duckdb
import pytest

from tallymark import quality_queries, queries, report_queries

SF = "/root/testdata/sf0.001"
ALL = queries.QUERIES | quality_queries.QUERIES | report_queries.QUERIES
SQL = queries.ORACLE_SQL | quality_queries.ORACLE_SQL | report_queries.ORACLE_SQL


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in Path(SF).glob("*.parquet"):
        c.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    return c


def _rows(rows):
    return sorted((tuple(round(v, 4) if isinstance(v, float) else v for v in r) for r in rows), key=str)


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows(spark, con, name):
    df = ALL[name](spark, SF)
    cols = sorted(df.columns)
    rel = con.execute(SQL[name])
    names = [x[0] for x in rel.description]
    assert sorted(names) == cols
    assert _rows(tuple(r[c] for c in cols) for r in df.collect()) == _rows(tuple(r[names.index(c)] for c in cols) for r in rel.fetchall())
