"""Run registered queries against their DuckDB oracles, like the driver does.

Usage: python tests/oracle_check.py [sf_dir] [query ...]
Compares row count, column names and the order-insensitive multiset of rows.
"""

from __future__ import annotations

import json
import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def _norm(v):
    if v is None:
        return "\x00null"
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(round(v, 6))
    if hasattr(v, "tolist"):
        v = v.tolist()
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(_norm(x) for x in v) + "]"
    if isinstance(v, bytes):
        return v.hex()
    return str(v)


def rows_of(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted(tuple(_norm(r[i]) for i in order) for r in rows)


def compare(spark, con, name, fn, sql, sf_dir):
    t = time.time()
    sdf = fn(spark, sf_dir)
    scols = sdf.columns
    srows = [tuple(r) for r in sdf.collect()]
    ts = time.time() - t
    res = {"query": name, "spark_rows": len(srows), "spark_sec": round(ts, 2)}
    if sql is None:
        res["oracle"] = "none"
        return res
    t = time.time()
    rel = con.sql(sql)
    ocols = rel.columns
    orows = rel.fetchall()
    res.update(oracle_rows=len(orows), oracle_sec=round(time.time() - t, 2))
    res["cols_match"] = sorted(scols) == sorted(ocols)
    if not res["cols_match"]:
        res["cols"] = [sorted(scols), sorted(ocols)]
    a, b = rows_of(scols, srows), rows_of(ocols, orows)
    res["values_match"] = a == b
    if not res["values_match"]:
        sa, sb = set(a), set(b)
        res["only_spark"] = [list(x) for x in list(sa - sb)[:2]]
        res["only_oracle"] = [list(x) for x in list(sb - sa)[:2]]
    return res


def main(argv):
    import duckdb
    from multimatch.session import local_session
    import __spark_entry__ as entry

    sf_dir = argv[1] if len(argv) > 1 else "/root/testdata/sf0.01"
    names = argv[2:] or list(entry.queries())
    spark = local_session(8)
    spark.sparkContext.setLogLevel("ERROR")
    con = duckdb.connect()
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        if os.path.exists(p):
            con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    qs, orc = entry.queries(), entry.oracle_sql()
    ok = True
    for n in names:
        try:
            r = compare(spark, con, n, qs[n], orc.get(n), sf_dir)
        except Exception as e:  # report and go on
            r = {"query": n, "error": repr(e)[:800]}
        ok &= bool(r.get("values_match", r.get("oracle") == "none"))
        print(json.dumps(r, ensure_ascii=False), flush=True)
    print("ALL OK" if ok else "SOME FAILED")


if __name__ == "__main__":
    main(sys.argv)
