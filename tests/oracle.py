"""Spark rows against DuckDB rows."""

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def duck(sf_dir):
    """A connection with the tables as views."""
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{sf_dir}/{t}.parquet')")
    return con


def rows(columns, data):
    """Rows as sorted text, columns by name."""
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(repr(r[i]) for i in order) for r in data)


def same(spark, query, sql, sf_dir):
    """Assert that a query's rows are those of its SQL."""
    df = query(spark, sf_dir)
    rel = duck(sf_dir).sql(sql)
    names = list(rel.columns)
    assert sorted(df.columns) == sorted(names)
    assert rows(df.columns, [tuple(r) for r in df.collect()]) == rows(names, rel.fetchall())
