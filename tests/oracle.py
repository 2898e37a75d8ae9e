"""Rows of a registered query and of its SQL, in one comparable form."""

import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SMALL = os.environ.get("FORMLEDGER_TESTDATA", "/root/testdata/sf0.001")


def norm(x):
    if isinstance(x, float):
        return repr(round(x, 9) + 0.0)
    if isinstance(x, (list, tuple)):
        return tuple(norm(y) for y in x)
    return x


def both(spark, query, sql, folder=SMALL):
    df = query(spark, folder)
    names = sorted(df.columns)
    ours = sorted(repr([norm(row[c]) for c in names]) for row in df.collect())
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet')")
    cursor = con.execute(sql)
    columns = [d[0] for d in cursor.description]
    theirs = sorted(repr([norm(row[columns.index(c)]) for c in names]) for row in cursor.fetchall())
    return names, sorted(columns), ours, theirs
