"""Run the registered queries on Spark and their SQL on DuckDB and compare all rows."""
import glob
import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def session(cores=None):
    from __spark_entry__ import local_session
    return local_session(cores)


def duck(sf_dir):
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path)[:-8]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


DUCK_TYPES = {"BIGINT": "bigint", "INTEGER": "int", "VARCHAR": "string", "DOUBLE": "double", "BOOLEAN": "boolean"}


def _canon(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else v + 0.0
    return v


def _rows(rows, order):
    return sorted((tuple(_canon(r[i]) for i in order) for r in rows),
                  key=lambda t: tuple((x is not None, str(x)) for x in t))


def compare(spark, con, sf_dir, name, fn, sql):
    """Returns (ok, message)."""
    t0 = time.time()
    df = fn(spark, sf_dir)
    rows = [tuple(r) for r in df.collect()]
    t1 = time.time()
    if sql is None:
        return bool(rows), f"rows={len(rows)} {t1 - t0:.1f}s rows-only"
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    types = [str(d[1]) for d in cur.description]
    want = cur.fetchall()
    t2 = time.time()
    msg = f"rows={len(rows)} cols={len(names)} spark={t1 - t0:.1f}s duck={t2 - t1:.1f}s"
    if sorted(names) != sorted(df.columns):
        return False, msg + f" columns differ {set(names) ^ set(df.columns)}"
    spark_types = dict(df.dtypes)
    for n, t in zip(names, types):
        if DUCK_TYPES.get(t) != spark_types[n]:
            return False, msg + f" type of {n}: {spark_types[n]} vs {t}"
    order = sorted(names)
    a = _rows(rows, [df.columns.index(n) for n in order])
    b = _rows(want, [names.index(n) for n in order])
    if len(a) != len(b):
        return False, msg + f" row counts {len(a)} vs {len(b)}"
    bad = [i for i in range(len(a)) if a[i] != b[i]]
    if bad:
        i = bad[0]
        diff = [(n, x, y) for n, x, y in zip(order, a[i], b[i]) if x != y]
        return False, msg + f" {len(bad)} rows differ, e.g. {diff[:4]} in {a[i][:8]}"
    nulls = [n for j, n in enumerate(order) if a and all(r[j] is None for r in a)]
    return bool(a), msg + (f" ALLNULL {nulls}" if nulls else "")


if __name__ == "__main__":
    import __spark_entry__ as entry
    sf_dir = os.environ.get("SF_DIR", "/root/testdata/sf0.01")
    spark, con = session(), duck(sf_dir)
    qs, sqls = entry.queries(), entry.oracle_sql()
    pick = sys.argv[1:]
    chosen = [n for n in qs if not pick or any(n == p or (p.endswith("*") and n.startswith(p[:-1])) for p in pick)]
    failed = []
    for n in chosen:
        try:
            ok, msg = compare(spark, con, sf_dir, n, qs[n], sqls.get(n))
        except Exception as e:
            ok, msg = False, f"{type(e).__name__}: {str(e)[:600]}"
        if not ok:
            failed.append(n)
        print("ok  " if ok else "FAIL", n, msg, flush=True)
    print(f"{len(chosen) - len(failed)}/{len(chosen)} ok; failed: {failed}")
