"""Each query with SQL against DuckDB on the smallest tables, by sorted rows."""

import duckdb
import pytest

from tidemark.plans import catalogue

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda k: names[k])
    plain = lambda v: round(v, 4) if isinstance(v, float) else v
    return sorted(repr(tuple(plain(r[k]) for k in order)) for r in rows)


@pytest.fixture(scope="module")
def duck(small):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{small}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(catalogue.SQL))
def test_matches_sql(spark, small, duck, name):
    df = catalogue.QUERIES[name](spark, small)
    mine = rows_of(df.columns, df.collect())
    found = duck.sql(catalogue.SQL[name])
    other = rows_of(found.columns, found.fetchall())
    assert sorted(df.columns) == sorted(found.columns)
    assert mine == other


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.SQL)))
def test_runs(spark, small, name):
    assert catalogue.QUERIES[name](spark, small).count() > 0


def test_margins_of_large_order_keys(spark, tmp_path):
    """A customer's later order may have a much smaller key; decoding times don't go back by that."""
    con = duckdb.connect()
    con.sql("CREATE TABLE orders AS SELECT * FROM (VALUES (90000000, 1, TIMESTAMP '2024-01-01'), (7, 1, TIMESTAMP '2024-01-02'), (5000000000, 2, TIMESTAMP '2024-01-05'), (3, 2, TIMESTAMP '2024-03-01')) t(o_orderkey, o_custkey, o_orderdate)")
    con.sql("CREATE TABLE lineitem AS SELECT o_orderkey AS l_orderkey, n::INT AS l_linenumber, o_orderdate + to_days((n * o_custkey - 3)::INT) AS l_shipdate FROM orders, range(1, 4) r(n)")
    for t in ("orders", "lineitem"):
        con.sql(f"COPY {t} TO '{tmp_path}/{t}.parquet'")
    df = catalogue.reorder_margin(spark, str(tmp_path))
    found = con.sql(catalogue.SQL["reorder_margin"])
    assert rows_of(df.columns, df.collect()) == rows_of(found.columns, found.fetchall()) == ["(1.0, 2)", "(2.0, 1)"]
