"""Compares registered queries with their DuckDB oracle.

Run by hand: python tests/oracle.py SF [name-prefix ...]"""

from __future__ import annotations

import datetime
import decimal
import math
import os
import re
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


# Operators that compare all rows with all rows, or call Python row by row.
PAIRS = re.compile("CartesianProduct|NestedLoopJoin|BatchEvalPython")


def duck(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(round(v, 9) + 0.0)
    if isinstance(v, decimal.Decimal):
        return repr(float(v))
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, (list, tuple)) and not hasattr(v, "asDict"):
        return "[" + ",".join(map(norm, v)) + "]"
    if hasattr(v, "asDict"):
        v = v.asDict()
    if isinstance(v, dict):
        return "{" + ",".join(f"{k}:{norm(x)}" for k, x in sorted(v.items())) + "}"
    return repr(v)


def compare(spark, con, fn, sql, sf_dir):
    """Returns (rows, list of problems)."""
    df = fn(spark, sf_dir)
    got = df.collect()
    problems = sorted(set(PAIRS.findall(df._jdf.queryExecution().executedPlan().toString())))
    if sql is None:
        return len(got), problems
    rel = con.execute(sql)
    cols = [d[0] for d in rel.description]
    want = rel.fetchall()
    if sorted(cols) != sorted(df.columns):
        return len(got), [f"columns {sorted(df.columns)} != {sorted(cols)}"]
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    names = [cols[i] for i in order]
    a = sorted(tuple(norm(r[n]) for n in names) for r in got)
    b = sorted(tuple(norm(r[i]) for i in order) for r in want)
    if len(a) != len(b):
        problems.append(f"rows {len(a)} != {len(b)}")
    if a != b:
        only_a = sorted(set(a) - set(b))[:3]
        only_b = sorted(set(b) - set(a))[:3]
        problems.append(f"{names}\n   spark {only_a}\n   duck  {only_b}")
    return len(a), problems


def main() -> int:
    from __spark_entry__ import oracle_sql, queries
    from cardflow.session import local_session

    sf_dir = f"/root/testdata/sf{sys.argv[1]}"
    spark, con = local_session("oracle"), duck(sf_dir)
    sqls, bad = oracle_sql(), 0
    for name, fn in queries().items():
        if len(sys.argv) > 2 and not any(name.startswith(p) for p in sys.argv[2:]):
            continue
        start = time.time()
        try:
            rows, problems = compare(spark, con, fn, sqls.get(name), sf_dir)
        except Exception as error:  # a failing query must not hide the others
            rows, problems = -1, [f"{type(error).__name__}: {str(error)[:1500]}"]
        bad += bool(problems)
        state = "FAIL" if problems else ("ok" if name in sqls else "rows")
        print(f"{state:5} {name:42} {rows:8} {time.time() - start:6.2f}s", *problems, flush=True)
    print("failed:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(1 if main() else 0)
