"""Run registered queries next to their SQL on DuckDB and compare the rows.

    python tests/oracle.py [sf_dir] [name ...]
"""

import datetime
import decimal
import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def plain(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else f"{x:.9g}"
    if isinstance(x, decimal.Decimal):
        return f"{float(x):.9g}"
    if isinstance(x, bool):
        return str(x)
    if isinstance(x, int):
        return f"{float(x):.9g}" if abs(x) < 1e8 else str(x)
    if isinstance(x, datetime.datetime):
        return x.replace(tzinfo=None).isoformat()
    return str(x)


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(plain(r[i]) for i in order) for r in rows)


def duck(sf_dir):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def compare(spark, con, sf_dir, fn, sql):
    """None when equal, else what differs."""
    df = fn(spark, sf_dir)
    got = df.collect()
    if sql is None:
        return None, len(got)
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    want = cur.fetchall()
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} != {sorted(names)}", len(got)
    a, b = rows_of(df.columns, got), rows_of(names, want)
    if a != b:
        left, right = set(a) - set(b), set(b) - set(a)
        return (
            f"{len(a)} rows != {len(b)} rows; only spark {len(left)} {list(left)[:2]}; "
            f"only sql {len(right)} {list(right)[:2]}"
        )[:1500], len(got)
    return None, len(got)


def main():
    import __spark_entry__ as entry
    from docmem.session import local_session

    args = sys.argv[1:]
    sf_dir = args.pop(0) if args and "/" in args[0] else "/root/testdata/sf0.01"
    spark = local_session("8")
    con = duck(sf_dir)
    oracles = entry.oracle_sql()
    bad = 0
    for name, fn in entry.queries().items():
        if args and not any(name.startswith(a) for a in args):
            continue
        start = time.time()
        try:
            diff, n = compare(spark, con, sf_dir, fn, oracles.get(name))
        except Exception as e:
            diff, n = f"{type(e).__name__}: {str(e)[:900]}", -1
        bad += diff is not None
        note = "" if name in oracles else " (no sql)"
        print(f"{'ok ' if diff is None else 'BAD'} {name} rows={n} {time.time() - start:.1f}s{note} {diff or ''}", flush=True)
    print("bad:", bad)


if __name__ == "__main__":
    main()
