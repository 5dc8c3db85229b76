"""Spark's result of a query and DuckDB's, as sets of rows with repeats."""

import decimal

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if v is None:
        return "null"
    if isinstance(v, (float, decimal.Decimal)):
        return f"{v:.9g}"
    return str(v)


def agree(spark, sf, name, query, sql):
    db = duckdb.connect()
    for t in TABLES:
        db.execute(f"create view {t} as select * from read_parquet('{sf}/{t}.parquet')")
    df = query(spark, sf)
    cols = sorted(df.columns)
    got = sorted(tuple(map(plain, r)) for r in df.select(*cols).collect())
    found = db.execute(sql)
    names = [x[0] for x in found.description]
    assert sorted(names) == cols, name
    want = sorted(tuple(plain(r[names.index(c)]) for c in cols) for r in found.fetchall())
    assert got == want, name
