"""Runs a registered query and its SQL over the same tables, and compares the rows as the driver does."""

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows_of(values):
    return sorted(repr(tuple(round(v, 9) if isinstance(v, float) else v for v in row)) for row in values)


def compare(spark, sf_dir, query, sql):
    df = query(spark, sf_dir)
    names = sorted(df.columns)
    got = [tuple(r[n] for n in names) for r in df.collect()]
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    result = con.execute(sql)
    cols = [d[0] for d in result.description]
    want = [tuple(dict(zip(cols, r))[n] for n in names) for r in result.fetchall()]
    assert sorted(cols) == names, (cols, names)
    a, b = rows_of(got), rows_of(want)
    if a != b:
        x, y = set(a) - set(b), set(b) - set(a)
        raise AssertionError(f"{len(a)} and {len(b)} rows; only ours {sorted(x)[:4]}; only theirs {sorted(y)[:4]}")
