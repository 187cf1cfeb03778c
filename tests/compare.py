"""Run registered queries against DuckDB and compare names, row counts and values."""

from __future__ import annotations

import glob
import math
import os
import sys
import time

import duckdb


def _plain(value):
    if isinstance(value, float):
        if math.isnan(value):
            return "nan"
        return repr(0.0 if value == 0 else value)
    if isinstance(value, (list, tuple)):
        return "[" + ",".join(_plain(v) for v in value) + "]"
    if value is None:
        return "NULL"
    return str(value)


def _rows(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(_plain(r[i]) for i in order) for r in rows)


def connect(sf_dir: str):
    con = duckdb.connect()
    for path in glob.glob(os.path.join(sf_dir, "*.parquet")):
        name = os.path.basename(path)[: -len(".parquet")]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def check(spark, name, plan, sql, sf_dir, con):
    """Return (ok, message, row count)."""
    df = plan(spark, sf_dir)
    got = [tuple(r) for r in df.collect()]
    if sql is None:
        return True, "rows only", len(got)
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    want = cur.fetchall()
    if sorted(names) != sorted(df.columns):
        return False, f"columns {sorted(df.columns)} != {sorted(names)}", len(got)
    a, b = _rows(df.columns, got), _rows(names, want)
    if len(a) != len(b):
        return False, f"rows spark={len(a)} sql={len(b)}", len(got)
    bad = [(x, y) for x, y in zip(a, b, strict=True) if x != y]
    if bad:
        lines = "\n".join(f"    spark {x}\n    sql   {y}" for x, y in bad[:3])
        return False, f"{len(bad)} of {len(a)} rows differ\n  {sorted(names)}\n{lines}", len(got)
    return True, "equal", len(got)


def main(argv):
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    from __spark_entry__ import oracle_sql, queries
    from oscilla.session import build_session

    sf_dir = os.environ.get("SF_DIR", "/root/testdata/sf0.01")
    extra = {"spark.ui.enabled": "false", "spark.driver.memory": "8g"}
    spark = build_session("compare", "local[8]", 8, extra)
    spark.sparkContext.setLogLevel("OFF")
    con = connect(sf_dir)
    plans, sqls = queries(), oracle_sql()
    wanted = argv or list(plans)
    failed = []
    for name in wanted:
        start = time.time()
        try:
            ok, message, rows = check(spark, name, plans[name], sqls.get(name), sf_dir, con)
        except Exception as exc:
            ok, message, rows = False, f"{type(exc).__name__}: {str(exc)[-700:]}", -1
        print(f"{'ok  ' if ok else 'FAIL'} {name:28s} rows={rows:<7d} {time.time() - start:6.2f}s {message}", flush=True)
        if not ok:
            failed.append(name)
    print(f"{len(wanted) - len(failed)} ok, {len(failed)} failed: {failed}")
    return 1 if failed else 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
