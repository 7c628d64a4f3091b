"""Compare registered queries with their SQL on the same parquet files.

usage: parity.py [--sf DIR] [name-prefix ...]
"""

from __future__ import annotations

import argparse
import datetime
import decimal
import math
import os
import sys
import time
import traceback

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
from sparkassay.plans import catalogue  # noqa: E402
from sparkassay.session import build_session  # noqa: E402
from sparkassay.sources.tables import TABLES  # noqa: E402


def canon(v):
    if v is None:
        return "\0null"
    if isinstance(v, bool):
        return "b" + str(v)
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return "f" + repr(v + 0.0)
    if isinstance(v, int):
        return "i" + str(v)
    if isinstance(v, decimal.Decimal):
        return "d" + str(v)
    if isinstance(v, datetime.datetime):
        return "t" + v.replace(tzinfo=None).isoformat()
    if isinstance(v, datetime.date):
        return "D" + v.isoformat()
    return "s" + str(v)


def rows_of(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted(tuple(canon(r[i]) for i in order) for r in rows), [cols[i] for i in order]


def main() -> int:
    ap = argparse.ArgumentParser()
    ap.add_argument("--sf", default="/root/testdata/sf0.01")
    ap.add_argument("--plan", action="store_true")
    ap.add_argument("--skip-oracle", action="store_true")
    ap.add_argument("names", nargs="*")
    a = ap.parse_args()
    spark = build_session("parity", "local[8]", **{
        "spark.sql.shuffle.partitions": "8", "spark.driver.memory": "8g", "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{a.sf}/{t}.parquet'")
    qs, os_ = catalogue.queries(), catalogue.oracles()
    picked = [q for q in qs if not a.names or any(q.startswith(n) for n in a.names)]
    bad = []
    for name in picked:
        t0 = time.time()
        try:
            df = qs[name](spark, a.sf)
            if a.plan:
                df.explain()
            got = [tuple(r) for r in df.collect()]
            t1 = time.time()
            srows, scols = rows_of(df.columns, got)
            if name not in os_ or a.skip_oracle:
                print(f"ROWS  {name:28s} rows={len(got):7d} spark={t1 - t0:6.2f}s")
                continue
            res = con.execute(os_[name])
            dcols = [d[0] for d in res.description]
            drows, dcols = rows_of(dcols, res.fetchall())
            t2 = time.time()
            ok = scols == dcols and srows == drows
            print(f"{'ok   ' if ok else 'DIFF '} {name:28s} rows={len(got):7d}/{len(drows):7d} "
                  f"spark={t1 - t0:6.2f}s duck={t2 - t1:6.2f}s", flush=True)
            if not ok:
                bad.append(name)
                print("   cols", scols, dcols)
                ss, dd = set(srows), set(drows)
                for r in sorted(ss - dd)[:3]:
                    print("   spark only", str(r)[:600])
                for r in sorted(dd - ss)[:3]:
                    print("   duck  only", str(r)[:600])
        except Exception as e:  # noqa: BLE001
            bad.append(name)
            print(f"FAIL  {name}: {type(e).__name__} {str(e)[:900]}", flush=True)
            if os.environ.get("TRACE"):
                traceback.print_exc()
    print(f"{len(picked) - len(bad)}/{len(picked)} good; bad: {bad}")
    spark.stop()
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main())
