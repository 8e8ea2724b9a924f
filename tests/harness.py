"""Compare a Spark check with its DuckDB oracle (as the driver does):
column names, row count and an order-insensitive hash of the values.

CLI: ``python -m tests.harness /root/testdata/sf0.01 [key ...]``
"""

from __future__ import annotations

import hashlib
import math
import os
import sys
import time

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def duck(sf_dir: str):
    import duckdb
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _norm(v):
    if v is None:
        return "∅"
    if isinstance(v, float):
        if math.isnan(v):
            return "∅"
        return repr(round(v, 6))
    if hasattr(v, "item"):
        v = v.item()
        return _norm(v)
    if isinstance(v, bool):
        return "T" if v else "F"
    return str(v)


def spark_family(t: str) -> str:
    t = t.lower()
    if t in ("tinyint", "smallint", "int", "bigint"):
        return "int"
    if t in ("float", "double") or t.startswith("decimal"):
        return "float"
    if t.startswith("timestamp") or t == "date":
        return "time"
    return {"string": "str", "boolean": "bool"}.get(t, t)


def duck_family(t: str) -> str:
    t = t.upper()
    if t in ("TINYINT", "SMALLINT", "INTEGER", "BIGINT", "HUGEINT", "UTINYINT", "USMALLINT",
             "UINTEGER", "UBIGINT"):
        return "int"
    if t in ("FLOAT", "DOUBLE") or t.startswith("DECIMAL"):
        return "float"
    if t.startswith("TIMESTAMP") or t == "DATE":
        return "time"
    return {"VARCHAR": "str", "BOOLEAN": "bool"}.get(t, t.lower())


def digest(rows):
    lines = sorted("|".join(_norm(x) for x in r) for r in rows)
    return hashlib.sha256("\n".join(lines).encode()).hexdigest(), lines


def compare(spark, key: str, sf_dir: str, con=None):
    """Return ``(ok, message)``."""
    import __spark_entry__ as E
    con = con or duck(sf_dir)
    q = E.queries()[key]
    sql = E.oracle_sql().get(key)
    df = q(spark, sf_dir)
    cols = sorted(df.columns)
    srows = [tuple(r[c] for c in cols) for r in df.collect()]
    if sql is None:
        return True, f"{key}: rows-only ({len(srows)} rows)"
    rel = con.execute(sql)
    dcols = [d[0] for d in rel.description]
    drows_raw = rel.fetchall()
    if sorted(dcols) != cols:
        return False, f"{key}: columns differ spark={cols} duck={sorted(dcols)}"
    stypes = dict(df.dtypes)
    dtypes = {d[0]: str(d[1]) for d in rel.description}
    bad_types = [(c, stypes[c], dtypes[c]) for c in cols
                 if spark_family(stypes[c]) != duck_family(dtypes[c])]
    if bad_types:
        return False, f"{key}: column types differ {bad_types}"
    idx = [dcols.index(c) for c in cols]
    drows = [tuple(r[i] for i in idx) for r in drows_raw]
    if len(srows) != len(drows):
        return False, f"{key}: rows spark={len(srows)} duck={len(drows)}"
    hs, ls = digest(srows)
    hd, ld = digest(drows)
    if hs != hd:
        diff = [(a, b) for a, b in zip(ls, ld) if a != b][:3]
        return False, f"{key}: values differ, e.g. {diff}"
    return True, f"{key}: ok ({len(srows)} rows)"


def main(argv):
    sys.path.insert(0, ".")
    from fleetframe.session import build_session
    sf_dir = argv[1] if len(argv) > 1 else "/root/testdata/sf0.01"
    import __spark_entry__ as E
    keys = argv[2:] or list(E.queries())
    spark = build_session("local[8]", shuffle_partitions=8)
    if os.environ.get("FF_SESSION_TZ"):      # prove results do not depend on the session zone
        spark.conf.set("spark.sql.session.timeZone", os.environ["FF_SESSION_TZ"])
    con = duck(sf_dir)
    bad = 0
    for k in keys:
        t0 = time.time()
        try:
            ok, msg = compare(spark, k, sf_dir, con)
        except Exception as ex:  # report and continue
            ok, msg = False, f"{k}: ERROR {type(ex).__name__}: {str(ex).splitlines()[0][:300]}"
        bad += not ok
        print(("PASS " if ok else "FAIL ") + msg + f"  [{time.time() - t0:.1f}s]", flush=True)
    print(f"{len(keys) - bad}/{len(keys)} passed")
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main(sys.argv))
