"""Runs a query and its SQL over the same tables and compares all rows."""

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SMALL = "/root/testdata/sf0.001"


def canonical(value):
    if isinstance(value, float):
        return "nan" if value != value else f"{value:.6g}"
    return str(value)


def compare(spark, query, sql, sf_dir=SMALL):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    df = query(spark, sf_dir)
    columns = sorted(df.columns)
    got = sorted(tuple(canonical(r[c]) for c in columns) for r in df.collect())
    want = con.sql(sql)
    assert sorted(want.columns) == columns
    at = [want.columns.index(c) for c in columns]
    expected = sorted(tuple(canonical(r[i]) for i in at) for r in want.fetchall())
    assert len(got) == len(expected)
    assert got == expected
