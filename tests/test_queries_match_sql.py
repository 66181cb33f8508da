"""Every registered query outside the llm subpackage against its SQL in DuckDB, on the smallest tables."""

import duckdb
import pytest

from chronoweave.plans import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def rows(columns, values):
    order = sorted(range(len(columns)), key=columns.__getitem__)
    plain = lambda x: round(float(x), 7) + 0.0 if isinstance(x, float) else x
    return sorted(repr(tuple(plain(r[i]) for i in order)) for r in values)


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query(spark, duck, name):
    df = catalog.QUERIES[name](spark, SF)
    found = duck.execute(catalog.ORACLES[name])
    columns = [c[0] for c in found.description]
    assert sorted(columns) == sorted(df.columns)
    assert rows(df.columns, [tuple(r) for r in df.collect()]) == rows(columns, found.fetchall())
