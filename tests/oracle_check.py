"""Run registered queries against their SQL in DuckDB. Usage: oracle_check.py [-d SF_DIR] [names...]"""

import math
import os
import sys
import tempfile
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def session(cpus="8"):
    from pyspark.sql import SparkSession
    s = (SparkSession.builder.master(f"local[{cpus}]").appName("check")
         .config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false")
         .config("spark.driver.memory", "12g").config("spark.ui.showConsoleProgress", "false")
         .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="visitgrid-check-")).config("spark.sql.session.timeZone", "UTC")
         .getOrCreate())
    s.sparkContext.setLogLevel("ERROR")
    return s


def duck(sf_dir):
    import duckdb
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def norm(v):
    if v is None:
        return "~"
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.6f}".replace("-0.000000", "0.000000")
    if isinstance(v, bool):
        return str(int(v))
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(norm(x) for x in v) + "]"
    if hasattr(v, "is_finite"):
        return norm(float(v))
    return str(v)


def rows_of(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return [cols[i] for i in order], sorted(tuple(norm(r[i]) for i in order) for r in rows)


def compare(spark, con, name, fn, sql, sf_dir):
    t = time.time()
    df = fn(spark, sf_dir)
    got = [tuple(r) for r in df.collect()]
    secs = time.time() - t
    a = rows_of(df.columns, got)
    if sql is None:
        return "rows", len(got), secs, got[:3]
    t = time.time()
    cur = con.execute(sql)
    b = rows_of([d[0] for d in cur.description], cur.fetchall())
    dsecs = time.time() - t
    if a[0] != b[0]:
        return "COLUMNS", len(got), secs, (a[0], b[0])
    if a[1] != b[1]:
        sa, sb = set(a[1]), set(b[1])
        return "DIFF", len(got), secs, (len(a[1]), len(b[1]), len(sa - sb),
                                        sorted(sa - sb)[:3], sorted(sb - sa)[:3])
    return "ok", len(got), secs, f"duck {dsecs:.1f}s"


if __name__ == "__main__":
    args = sys.argv[1:]
    sf = "/root/testdata/sf0.01"
    if args[:1] == ["-d"]:
        sf, args = args[1], args[2:]
    import __spark_entry__ as e
    q, o = e.queries(), e.oracle_sql()
    names = [n for n in q if not args or n in args or any(a.endswith("*") and n.startswith(a[:-1]) for a in args)]
    s, con = session(), duck(sf)
    bad = []
    for n in names:
        try:
            st, cnt, secs, info = compare(s, con, n, q[n], o.get(n), sf)
        except Exception as ex:  # report and go on
            st, cnt, secs, info = "ERROR", 0, 0, str(ex)[:900]
        print(f"{st:8s} {n:32s} rows={cnt} {secs:.1f}s {info}", flush=True)
        if st not in ("ok", "rows"):
            bad.append(n)
    print("BAD:", bad)
    os._exit(1 if bad else 0)
