"""python tests/verify.py [SF_DIR] [NAME ...]: compares queries with their SQL on DuckDB, as the driver does."""

from __future__ import annotations

import datetime
import math
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))


def norm(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return ""
    if isinstance(v, bool):
        return str(int(v))
    if isinstance(v, float):
        return f"{v:.6g}"
    if isinstance(v, datetime.datetime):
        return v.isoformat(sep=" ")
    if isinstance(v, datetime.date):
        return v.isoformat()
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(map(norm, v)) + "]"
    if isinstance(v, dict):
        return "{" + ",".join(f"{k}:{norm(x)}" for k, x in v.items()) + "}"
    if hasattr(v, "asDict"):
        return norm(v.asDict())
    return str(v)


def bag(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(norm(r[i]) for i in order) for r in rows)


def compare(spark, con, name, f, sql, root) -> str:
    df = f(spark, root)
    got = bag([tuple(r) for r in df.collect()], df.columns)
    if sql is None:
        return f"rows {len(got)}"
    cur = con.execute(sql)
    cols = [d[0] for d in cur.description]
    want = bag(cur.fetchall(), cols)
    if sorted(cols) != sorted(df.columns):
        return f"COLUMNS {df.columns} {cols}"
    if got != want:
        a, b = set(got), set(want)
        return f"DIFFER {len(got)} {len(want)} only spark {list(a - b)[:2]} only sql {list(b - a)[:2]}"
    return f"ok {len(got)}"


def connect(root):
    import duckdb

    con = duckdb.connect()
    for p in Path(root).iterdir():
        src = f"{p}/*.parquet" if p.is_dir() else str(p)
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{src}')")
    return con


if __name__ == "__main__":
    import __spark_entry__ as e

    from citeloom.runtime import session

    args = sys.argv[1:]
    root = args.pop(0) if args and "/" in args[0] else "/root/testdata/sf0.01"
    spark = session(master="local[8]", spark__sql__shuffle__partitions="8", spark__driver__memory="6g")
    spark.sparkContext.setLogLevel("ERROR")
    con, q, sql = connect(root), e.queries(), e.oracle_sql()
    for name in [n for n in q if not args or any(n == a or a.endswith("*") and n.startswith(a[:-1]) for a in args)]:
        t = time.time()
        try:
            said = compare(spark, con, name, q[name], sql.get(name), root)
        except Exception as x:
            said = f"ERROR {type(x).__name__} {str(x)[:1500]}"
        print(f"{name}: {said} ({time.time() - t:.1f} s)", flush=True)
