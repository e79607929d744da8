"""Compare registered queries with their SQL twins: ``python tests/oracle_check.py SF [prefix ...]``."""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def connect(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    con.sql("SET TimeZone='UTC'")
    for name in TABLES:
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def norm(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return None
    if isinstance(value, bool):
        return value
    if isinstance(value, float):
        return round(value, 6)
    return value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(norm(r[i]) for i in order) for r in rows]
    return [columns[i] for i in order], sorted(out, key=repr)


def compare(spark, con, name, fn, sql, sf_dir):
    """Return None when equal, otherwise a short description of the difference."""
    df = fn(spark, sf_dir)
    cols, left = rows_of(df.columns, [tuple(r) for r in df.collect()])
    if sql is None:
        return None if left else "no rows"
    rel = con.sql(sql)
    cols2, right = rows_of(rel.columns, rel.fetchall())
    if cols != cols2:
        return f"columns {cols} != {cols2}"
    types = {c: str(t) for c, t in zip(rel.columns, rel.types)}
    want = {"string": "VARCHAR", "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "boolean": "BOOLEAN"}
    bad = [(c, t, types[c]) for c, t in df.dtypes if want.get(t) != types[c]]
    if len(left) != len(right):
        a, b = set(left), set(right)
        return f"rows {len(left)} != {len(right)}; spark-only {list(a - b)[:2]}; duck-only {list(b - a)[:2]}"
    diff = [(x, y) for x, y in zip(left, right) if x != y]
    if diff:
        a, b = set(left), set(right)
        return f"{len(diff)} rows differ ({cols}); spark-only {sorted(a - b, key=repr)[:3]}; duck-only {sorted(b - a, key=repr)[:3]}"
    if bad:
        return f"types {bad}"
    return None if left else "equal but empty"


def main() -> int:
    from tests.conftest import make_session
    import __spark_entry__ as entry

    sf = sys.argv[1] if len(sys.argv) > 1 else "0.001"
    prefixes = tuple(sys.argv[2:])
    sf_dir = f"/root/testdata/sf{sf}"
    spark, con = make_session(), connect(sf_dir)
    queries, oracle = entry.queries(), entry.oracle_sql()
    failed = 0
    for name, fn in queries.items():
        if prefixes and not name.startswith(prefixes):
            continue
        t0 = time.time()
        try:
            msg = compare(spark, con, name, fn, oracle.get(name), sf_dir)
        except Exception as exc:  # report and go on with the next query
            msg = f"{type(exc).__name__}: {str(exc)[:700]}"
        failed += msg is not None
        print(f"{'ok  ' if msg is None else 'FAIL'} {name} {time.time() - t0:.1f}s {'' if name in oracle else '(rows)'} {msg or ''}", flush=True)
    print(f"{len(queries)} queries, {len(oracle)} with SQL, {failed} failed")
    return 1 if failed else 0


if __name__ == "__main__":
    raise SystemExit(main())
