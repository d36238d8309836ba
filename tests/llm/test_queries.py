"""Queries of the operators that SQL can state, against that SQL."""

from pathlib import Path

import duckdb
import pytest

from sievewright.llm import queries

SF = "/root/testdata/sf0.001"


def test_one_query_an_operator():
    assert [sum(n.startswith(f"op{k}_") for n in queries.QUERIES) for k in range(1, 11)] == [1] * 10
    assert set(queries.ORACLES) <= set(queries.QUERIES)


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_as_sql(spark, name):
    con = duckdb.connect()
    for f in Path(SF).glob("*.parquet"):
        con.sql(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    want, got = con.sql(queries.ORACLES[name]), queries.QUERIES[name](spark, SF)
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    rows = got.select(*columns).collect()
    quoted = ", ".join(f'"{c}"' for c in columns)
    assert sorted(repr(tuple(r)) for r in rows) == sorted(map(repr, want.project(quoted).fetchall())) and rows
