"""Every query that has SQL gives the rows that DuckDB gives."""

import decimal

import duckdb
import pytest

from turnstone import queries as Q

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    for t in ("events", "documents", "benchmark", "labels", "conversations", "pages"):
        con.sql(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, bool) or v is None:
        return v
    return round(float(v), 6) if isinstance(v, int | float | decimal.Decimal) else str(v)


@pytest.mark.parametrize("name", sorted(Q.ORACLE_SQL))
def test_query(spark, tables, name):
    frame = Q.QUERIES[name](spark, DATA)
    columns = sorted(frame.columns)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in frame.collect()), key=str)
    found = tables.sql(Q.ORACLE_SQL[name])
    assert sorted(found.columns) == columns
    at = [found.columns.index(c) for c in columns]
    assert got == sorted((tuple(plain(r[i]) for i in at) for r in found.fetchall()), key=str)


def test_no_other_module_imports_the_subpackage():
    import pathlib

    root = pathlib.Path(Q.__file__).parent
    for p in root.rglob("*.py"):
        if "llm" not in p.relative_to(root).parts:
            assert "turnstone.llm" not in p.read_text()


def test_entry(spark):
    import __spark_entry__

    rows = __spark_entry__.entry(spark).collect()
    assert {r["qid"] for r in rows} <= {"en", "de", "fr", "es"} and rows
    assert set(Q.ORACLE_SQL) <= set(__spark_entry__.queries())
