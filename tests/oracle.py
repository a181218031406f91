"""Query results beside DuckDB's on the same tables."""

import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
DATA = "/root/testdata/sf0.001"


def rows(table, cols):
    return sorted(repr(tuple(round(r[c], 5) + 0.0 if isinstance(r[c], float) else r[c] for c in cols)) for r in table.to_pylist())


def same(spark, query, sql, data=DATA):
    df = query(spark, data)
    cols = sorted(df.columns)
    con = duckdb.connect()
    for t in TABLES:
        p = f"{data}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p if os.path.isfile(p) else p + '/*.parquet'}')")
    want = con.execute(sql).to_arrow_table()
    assert sorted(want.column_names) == cols
    assert rows(df.toArrow(), cols) == rows(want, cols)
