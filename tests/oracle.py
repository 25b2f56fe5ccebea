"""Runs a query and its SQL on another engine over the smallest test tables and compares rows."""

import decimal
import os
from collections import Counter

SF = "/root/testdata/sf0.001"


def _plain(v):
    if isinstance(v, (float, decimal.Decimal)):
        return round(float(v), 6) + 0.0
    return tuple(map(_plain, v)) if isinstance(v, list) else v


def same_rows(spark, query, sql, sf: str | None = None) -> None:
    import duckdb

    con, sf = duckdb.connect(), sf or SF
    for f in os.listdir(sf):
        con.execute(f"create view {f.removesuffix('.parquet')} as select * from '{sf}/{f}'")
    df = query(spark, sf)
    cols = sorted(df.columns)
    con.execute(sql)
    names = [d[0] for d in con.description]
    assert sorted(names) == cols
    at = [names.index(c) for c in cols]
    want = Counter(tuple(_plain(r[i]) for i in at) for r in con.fetchall())
    got = Counter(tuple(_plain(v) for v in r) for r in df.select(*cols).collect())
    assert got == want, (list((got - want).items())[:3], list((want - got).items())[:3])
