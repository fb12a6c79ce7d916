"""Compare a query with its SQL, which DuckDB runs on the same tables."""

from collections import Counter
from pathlib import Path

import duckdb


def norm(v):
    if v is None or v != v:
        return None
    if isinstance(v, float):
        return round(v, 6)
    if hasattr(v, "isoformat"):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, (list, tuple)) or type(v).__name__ == "ndarray":
        return tuple(norm(x) for x in v)
    return v


def rows(names, data):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return Counter(tuple(norm(r[i]) for i in order) for r in data)


def compare(spark, sf, fn, sql):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for p in sorted(Path(sf).glob("*.parquet")):
        con.execute(f"create view {p.stem} as select * from read_parquet('{p}{'/*' if p.is_dir() else ''}')")
    cur = con.execute(sql)
    want_names, want = [d[0] for d in cur.description], cur.fetchall()
    df = fn(spark, sf)
    got = [tuple(r) for r in df.collect()]
    assert sorted(df.columns) == sorted(want_names)
    a, b = rows(df.columns, got), rows(want_names, want)
    assert a == b, (len(got), len(want), list((a - b).items())[:3], list((b - a).items())[:3])
    return len(got)
