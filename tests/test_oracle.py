"""Every registered query with SQL, against DuckDB on the same tables: columns, number of rows, values."""

from pathlib import Path

import duckdb
import pytest

from siftlens import plans


def compare(spark, data, query, sql):
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for f in Path(data).glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    df = query(spark, data)
    columns = sorted(df.columns)
    found = sorted(repr(tuple(r)) for r in df.select(*columns).collect())
    quoted = ", ".join(f'"{c}"' for c in columns)
    stated = sorted(map(repr, con.execute(f"SELECT {quoted} FROM ({sql})").fetchall()))
    assert found == stated


@pytest.mark.parametrize("name", sorted(plans.oracle_sql()))
def test_query_matches_sql(spark, data, name):
    compare(spark, data, plans.queries()[name], plans.oracle_sql()[name])


def test_the_rest_runs(spark, data):
    for name in plans.queries().keys() - plans.oracle_sql().keys():
        assert plans.queries()[name](spark, data).count() > 0


@pytest.mark.parametrize("keys", ["range(0, 20000)", "range(2097000, 12000000, 52429)"])
def test_sizes_as_sql_prints_them(spark, tmp_path, keys):
    """2304 bytes are 2.25 kB, and SQL rounds all halves up; it has no MB."""
    duckdb.sql(f"COPY (SELECT range AS o_orderkey FROM {keys}) TO '{tmp_path}/orders.parquet'")
    compare(spark, tmp_path, plans.queries()["print_or_value"], plans.oracle_sql()["print_or_value"])


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
