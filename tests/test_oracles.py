"""Every registered query with an oracle against that oracle in DuckDB, on the smallest tables."""

import os

import duckdb
import pytest

from colloquy.plans import registry

D = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(D):
        path = f"{D}/{f}" if os.path.isfile(f"{D}/{f}") else f"{D}/{f}/*.parquet"
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{path}'")
    return con


def canonical(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    plain = [tuple(r[i] for i in order) for r in rows]
    return sorted(plain, key=lambda r: tuple((x is None, str(x)) for x in r))


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_oracle(spark, duck, name):
    df = registry.QUERIES[name](spark, D)
    want = duck.execute(registry.ORACLES[name])
    columns = [c[0] for c in want.description]
    assert sorted(df.columns) == sorted(columns)
    assert canonical([tuple(r) for r in df.collect()], df.columns) == canonical(want.fetchall(), columns)
