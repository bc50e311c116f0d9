"""Side-by-side check of registered queries against their DuckDB oracle SQL.

Usage: python -m litfeed.plans.verify [sf_dir] [name ...]
"""

from __future__ import annotations

import math
import sys
import time

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def duck(sf_dir: str):
    import duckdb
    import os
    con = duckdb.connect()
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        if os.path.exists(p):
            con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return con


def _norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return None
        return round(v, 6)
    if hasattr(v, "tolist"):
        v = v.tolist()
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    if isinstance(v, bool):
        return v
    if isinstance(v, int):
        return v
    return str(v) if not isinstance(v, (int, float)) else v


def rows_of(columns, records):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(_norm(r[i]) for i in order) for r in records]
    return sorted(out, key=repr)


def compare(spark, sf_dir: str, names=None, verbose=True):
    from litfeed.plans.catalogue import REGISTRY
    con = duck(sf_dir)
    results = {}
    for name, e in REGISTRY.items():
        if names and name not in names:
            continue
        t0 = time.time()
        df = e.build(spark, sf_dir)
        s_cols = df.columns
        s_rows = [tuple(r) for r in df.collect()]
        t1 = time.time()
        if e.sql is None:
            results[name] = ("rows-only", len(s_rows))
            if verbose:
                print(f"{name:28s} rows-only  spark={len(s_rows)} ({t1 - t0:.1f}s)", flush=True)
            continue
        rel = con.sql(e.sql)
        d_cols = rel.columns
        d_rows = rel.fetchall()
        same_cols = sorted(s_cols) == sorted(d_cols)
        a, b = rows_of(s_cols, s_rows), rows_of(d_cols, d_rows)
        ok = same_cols and a == b
        results[name] = ("ok" if ok else "MISMATCH", len(s_rows), len(d_rows))
        if verbose:
            print(f"{name:28s} {'ok' if ok else 'MISMATCH':8s} spark={len(s_rows)} duck={len(d_rows)} ({t1 - t0:.1f}s)", flush=True)
            if not same_cols:
                print("   columns:", sorted(s_cols), sorted(d_cols))
            elif not ok:
                sa, sb = set(a), set(b)
                cut = lambda rows: [tuple(str(v)[:80] for v in r) for r in rows]
                print("   spark-only:", cut(sorted(sa - sb, key=repr)[:3]))
                print("   duck-only: ", cut(sorted(sb - sa, key=repr)[:3]))
    return results


if __name__ == "__main__":
    import os
    sys.path.insert(0, os.getcwd())
    from litfeed.session import get_spark
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    compare(get_spark(), sf, set(sys.argv[2:]) or None)
