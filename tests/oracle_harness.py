"""Run a registered query in Spark and its oracle SQL in DuckDB, then compare.

Mirrors the driver's check: same row count, same column names and types, and the same
multiset of rows once columns are sorted by name.  Usage::

    python tests/oracle_harness.py [key ...]      # default: every key
"""

from __future__ import annotations

import datetime as dt
import decimal
import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def _norm(v):
    import numpy as np

    if v is None:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return None
        return round(v, 6)
    if isinstance(v, (np.floating,)):
        return None if np.isnan(v) else round(float(v), 6)
    if isinstance(v, (np.integer,)):
        return int(v)
    if isinstance(v, (np.bool_,)):
        return bool(v)
    if isinstance(v, decimal.Decimal):
        return round(float(v), 6)
    if isinstance(v, np.ndarray):
        return tuple(_norm(x) for x in v.tolist())
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    if isinstance(v, dict):
        return tuple((k, _norm(x)) for k, x in v.items())
    if hasattr(v, "asDict"):
        return tuple((k, _norm(x)) for k, x in v.asDict().items())
    if hasattr(v, "to_pydatetime"):
        try:
            return v.to_pydatetime().isoformat()
        except Exception:
            return None
    if isinstance(v, (dt.datetime, dt.date)):
        return v.isoformat()
    if v is getattr(__import__("pandas"), "NaT", object()):
        return None
    return v


# Spark type -> DuckDB type name, for the schema part of the comparison
SPARK_TO_DUCK = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR",
                 "boolean": "BOOLEAN", "timestamp": "TIMESTAMP", "timestamp_ntz": "TIMESTAMP", "date": "DATE",
                 "float": "FLOAT", "array<string>": "VARCHAR[]"}


def _rows(columns, records):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(_norm(r[i]) for i in order) for r in records]
    return sorted(out, key=repr)


def duck_connection(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def compare(spark, key: str, sf_dir: str, con=None, verbose: bool = True) -> dict:
    from tableguard.plans.registry import ORACLES, QUERIES, load_all

    load_all()
    con = con or duck_connection(sf_dir)
    t0 = time.time()
    sdf = QUERIES[key](spark, sf_dir)
    s_cols = sdf.columns
    s_recs = [tuple(r) for r in sdf.collect()]
    t_spark = time.time() - t0
    res = {"key": key, "spark_rows": len(s_recs), "spark_sec": round(t_spark, 2)}
    if key not in ORACLES:
        res["status"] = "rows-only"
        return res
    t1 = time.time()
    cur = con.execute(ORACLES[key]())
    d_cols = [d[0] for d in cur.description]
    d_recs = cur.fetchall()
    res.update(oracle_rows=len(d_recs), oracle_sec=round(time.time() - t1, 2))
    if sorted(s_cols) != sorted(d_cols):
        res["status"] = f"columns differ: spark={sorted(s_cols)} oracle={sorted(d_cols)}"
        return res
    s_types = {f.name: SPARK_TO_DUCK.get(f.dataType.simpleString(), f.dataType.simpleString())
               for f in sdf.schema.fields}
    rel = con.sql(ORACLES[key]())
    d_types = dict(zip(rel.columns, (str(t) for t in rel.types)))
    if s_types != d_types:
        res["status"] = f"types differ: spark={s_types} oracle={d_types}"
        return res
    a, b = _rows(s_cols, s_recs), _rows(d_cols, d_recs)
    if len(a) != len(b):
        res["status"] = "row count differs"
    elif a != b:
        diff_a = [r for r in a if r not in set(b)][:3]
        diff_b = [r for r in b if r not in set(a)][:3]
        res["status"] = f"values differ: spark-only={diff_a} oracle-only={diff_b}"
    else:
        res["status"] = "match"
    return res


def main(argv):
    from tableguard.plans.registry import QUERIES, load_all
    from tableguard.session import get_spark

    load_all()
    sf_dir = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.01")
    keys = argv or sorted(QUERIES)
    spark = get_spark()
    con = duck_connection(sf_dir)
    bad = 0
    for k in keys:
        try:
            r = compare(spark, k, sf_dir, con)
        except Exception as e:  # report and go on
            r = {"key": k, "status": f"error: {type(e).__name__}: {str(e)[:400]}"}
        ok = r["status"] in ("match", "rows-only")
        bad += 0 if ok else 1
        print(("OK  " if ok else "BAD ") + str(r)[:1500], flush=True)
    print(f"{len(keys) - bad}/{len(keys)} ok")
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1:]) else 0)
