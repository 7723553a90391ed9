"""Compare registered Spark queries with their DuckDB SQL on the driver tables.

Row count, column names and types, and an order-insensitive multiset of rows
(values compared exactly, doubles included).
Run as a script: ``python tests/oracle_compare.py [sf_dir] [name ...]``.
"""

from __future__ import annotations

import decimal
import math
import os
import sys
import time

import duckdb

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
if ROOT not in sys.path:
    sys.path.insert(0, ROOT)

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        if os.path.exists(path):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path}')")
    return con


def _norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        return "nan" if math.isnan(v) else v
    if isinstance(v, decimal.Decimal):
        return float(v)
    if isinstance(v, bool):
        return int(v)
    if hasattr(v, "isoformat"):
        return v.isoformat()
    return v


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(_norm(r[i]) for i in order) for r in rows]
    return sorted(out, key=lambda t: tuple((x is None, str(type(x)), x if x is not None else 0) for x in t))


# Spark type names against DuckDB's.
TYPE_NAMES = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN",
              "date": "DATE"}


def compare(spark, name: str, sf_dir: str, con=None) -> dict:
    from __spark_entry__ import oracle_sql, queries

    con = con or duck(sf_dir)
    t0 = time.time()
    sdf = queries()[name](spark, sf_dir)
    s_cols = sdf.columns
    s_rows = [tuple(r) for r in sdf.collect()]
    t1 = time.time()
    sql = oracle_sql().get(name)
    if sql is None:
        return {"name": name, "ok": None, "rows": len(s_rows), "spark_sec": round(t1 - t0, 2)}
    rel = con.sql(sql)
    d_types = dict(zip(rel.columns, [str(t) for t in rel.types]))
    res = con.execute(sql)
    d_cols = [c[0] for c in res.description]
    d_rows = res.fetchall()
    s_types = {f.name: TYPE_NAMES.get(f.dataType.simpleString(), f.dataType.simpleString()) for f in sdf.schema.fields}
    ok_cols = sorted(s_cols) == sorted(d_cols) and s_types == d_types
    ok_count = len(s_rows) == len(d_rows)
    ok_vals = ok_cols and ok_count and _rows(s_cols, s_rows) == _rows(d_cols, d_rows)
    out = {
        "name": name,
        "ok": bool(ok_cols and ok_count and ok_vals),
        "rows": len(s_rows),
        "oracle_rows": len(d_rows),
        "spark_sec": round(t1 - t0, 2),
    }
    if not ok_cols:
        out["columns"] = (s_types, d_types)
    elif not ok_vals:
        a, b = _rows(s_cols, s_rows), _rows(d_cols, d_rows)
        diff_a = [r for r in a if r not in set(b)][:3]
        diff_b = [r for r in b if r not in set(a)][:3]
        out["spark_only"] = diff_a
        out["oracle_only"] = diff_b
    return out


def main(argv):
    from covlens.session import local_session

    sf_dir = argv[1] if len(argv) > 1 else "/root/testdata/sf0.01"
    names = argv[2:]
    from __spark_entry__ import queries

    spark = local_session(8)
    con = duck(sf_dir)
    names = names or sorted(queries())
    bad = 0
    for n in names:
        try:
            r = compare(spark, n, sf_dir, con)
        except Exception as e:  # report and go on
            r = {"name": n, "ok": False, "error": f"{type(e).__name__}: {str(e)[:400]}"}
        bad += r.get("ok") is False
        print(r, flush=True)
    print(f"{len(names) - bad}/{len(names)} ok")
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main(sys.argv))
