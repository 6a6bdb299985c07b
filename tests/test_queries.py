"""Every registered query against its SQL in DuckDB."""

import functools
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from newsgraph.catalog import load_queries
from tools.check_oracles import rows

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in Path(SF).glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return con


@pytest.fixture(scope="module", autouse=True)
def one_store():
    """The load queries read one loaded store instead of loading again."""
    patch = pytest.MonkeyPatch()
    patch.setattr(load_queries, "loaded_store", functools.cache(load_queries.loaded_store))
    yield
    patch.undo()


@pytest.mark.parametrize("name", list(entry.oracle_sql()))
def test_query(spark, duck, name):
    df = entry.queries()[name](spark, SF)
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    result = duck.execute(entry.oracle_sql()[name])
    columns = [d[0] for d in result.description]
    assert sorted(df.columns) == sorted(columns)
    assert got == rows(columns, result.fetchall())


def test_entry(spark):
    assert entry.entry(spark).columns == ["beat_id", "topic", "pages"]
