"""Run registered queries beside their checking SQL: `python tests/check_oracle.py [folder] [names…]`."""

import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402

import __spark_entry__ as entry  # noqa: E402
from beaconry.plans.views import TABLES  # noqa: E402
from beaconry.session import build_session  # noqa: E402


def normal(row):
    out = []
    for v in row:
        if isinstance(v, bool):
            out.append(str(v))
        elif isinstance(v, (int, float)) or type(v).__name__ == "Decimal":
            f = float(v)
            out.append("nan" if math.isnan(f) else f"{f:.6f}".replace("-0.000000", "0.000000"))
        else:
            out.append(str(v))
    return tuple(out)


def compare(spark, con, name, folder):
    build = entry.queries()[name]
    sql = entry.oracle_sql().get(name)
    began = time.time()
    df = build(spark, folder)
    order = sorted(df.columns)
    got = sorted(normal(tuple(r[c] for c in order)) for r in df.collect())
    took = time.time() - began
    if sql is None:
        return True, f"{len(got)} rows, no SQL", took, got
    con.execute(sql)
    names = [d[0] for d in con.description]
    index = [names.index(c) for c in order] if sorted(names) == order else None
    if index is None:
        return False, f"columns differ: {order} / {sorted(names)}", took, got
    want = sorted(normal(tuple(r[i] for i in index)) for r in con.fetchall())
    if got == want:
        return bool(got), f"{len(got)} rows" + ("" if got else " EMPTY"), took, got
    only_got = [r for r in got if r not in set(want)][:3]
    only_want = [r for r in want if r not in set(got)][:3]
    return False, f"{len(got)} / {len(want)} rows\n   columns {order}\n   ours {only_got}\n   sql  {only_want}", took, got


def main():
    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.001"
    wanted = sys.argv[2:]
    spark = build_session("check", "local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.driver.memory": "12g"})
    spark.sparkContext.setLogLevel("ERROR")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    bad = 0
    for name in entry.queries():
        if wanted and not any(name == w or (w.endswith("*") and name.startswith(w[:-1])) for w in wanted):
            continue
        try:
            ok, note, took, _ = compare(spark, con, name, folder)
        except Exception as e:  # noqa: BLE001
            ok, note, took = False, f"{type(e).__name__}: {str(e)[:1500]}", 0
        bad += not ok
        print(f"{'ok  ' if ok else 'FAIL'} {name:32s} {took:6.2f}s {note}", flush=True)
    print("failures:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(1 if main() else 0)
