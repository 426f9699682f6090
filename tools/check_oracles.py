"""Run registered queries against their oracle statements on one data set.

usage: python tools/check_oracles.py [name-prefix ...]
"""

import importlib
import math
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
import duckdb

from emberline.plans import catalog, load
from emberline.session import local_session

SF = os.environ.get("CHECK_SF_DIR", "/root/testdata/sf0.01")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def canon(rows, cols):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    out = []
    for r in rows:
        t = []
        for i in order:
            v = r[i]
            if isinstance(v, float):
                v = "nan" if math.isnan(v) else f"{v:.5f}"
                v = "0.00000" if v == "-0.00000" else v
            elif isinstance(v, bool) or v is None:
                v = str(v)
            else:
                v = str(v)
            t.append(v)
        out.append(tuple(t))
    return sorted(out)


def main():
    mods = [m for m in load.MODULES if (Path(load.__file__).parent / f"{m}.py").exists()]
    for m in mods:
        importlib.import_module(f"emberline.plans.{m}")
    want = sys.argv[1:]
    spark = local_session()
    spark.sparkContext.setLogLevel("ERROR")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    bad = []
    for name, fn in catalog.QUERIES.items():
        if want and not any(name == w or (w.endswith("*") and name.startswith(w[:-1])) or fn.__module__.endswith(w) for w in want):
            continue
        t0 = time.time()
        try:
            df = fn(spark, SF)
            cols = df.columns
            rows = [tuple(r) for r in df.collect()]
        except Exception as e:
            print(f"ERROR {name}: {str(e)[:600]}", flush=True)
            bad.append(name)
            continue
        t1 = time.time()
        if name not in catalog.ORACLES:
            print(f"rows  {name}: {len(rows)} ({t1 - t0:.1f}s)", flush=True)
            continue
        try:
            cur = con.execute(catalog.ORACLES[name])
            ocols = [c[0] for c in cur.description]
            orows = cur.fetchall()
        except Exception as e:
            print(f"OERR  {name}: {str(e)[:600]}", flush=True)
            bad.append(name)
            continue
        a, b = canon(rows, cols), canon(orows, ocols)
        if sorted(cols) != sorted(ocols):
            print(f"COLS  {name}: {sorted(cols)} vs {sorted(ocols)}", flush=True)
            bad.append(name)
        elif a != b:
            diff = [(x, y) for x, y in zip(a, b) if x != y][:3]
            print(f"DIFF  {name}: {len(a)} vs {len(b)} rows; {diff}", flush=True)
            bad.append(name)
        else:
            print(f"ok    {name}: {len(a)} ({t1 - t0:.1f}s, oracle {time.time() - t1:.1f}s)", flush=True)
    print("BAD:", bad)


main()
