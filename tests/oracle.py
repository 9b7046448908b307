"""A query's rows beside those of its SQL on the same tables."""

import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows_of_sql(sql, sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        if os.path.exists(p):
            c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{p + '/*.parquet' if os.path.isdir(p) else p}'")
    got = c.execute(sql)
    names = [x[0] for x in got.description]
    return names, got.fetchall()


def _plain(v):
    return round(v, 9) if isinstance(v, float) else v


def same(df, sql, sf_dir):
    names, want = rows_of_sql(sql, sf_dir)
    assert sorted(names) == sorted(df.columns)
    order = sorted(names)
    a = sorted(tuple(str(_plain(r[names.index(c)])) for c in order) for r in want)
    b = sorted(tuple(str(_plain(r[c])) for c in order) for r in df.collect())
    assert a == b
