"""Every query with SQL gives the same rows in DuckDB; the rest give rows."""

import duckdb
import pytest

from assayer.registry import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def rows(table, columns):
    def value(x):
        return None if x is None or x != x else round(float(x), 5) if isinstance(x, (int, float)) and not isinstance(x, bool) else str(x)

    return sorted((tuple(value(r[c]) for c in columns) for r in table), key=repr)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF)
    got, columns = [r.asDict() for r in df.collect()], sorted(df.columns)
    assert got or name in ORACLE_SQL
    if name in ORACLE_SQL:
        want = duck.execute(ORACLE_SQL[name])
        names = [x[0] for x in want.description]
        assert sorted(names) == columns
        assert rows(got, columns) == rows([dict(zip(names, r)) for r in want.fetchall()], columns)
