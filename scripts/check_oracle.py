"""Compare registered queries with their SQL: python scripts/check_oracle.py [sf] [name-prefix ...]"""

from __future__ import annotations

import glob
import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from lemmaforge.plans import ORACLES, QUERIES  # noqa: E402
from lemmaforge.session import build_session  # noqa: E402


def plain(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return None
    if isinstance(value, float):
        return float(f"{value:.9g}")
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    return value


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def kinds(rows):
    return [{type(v).__name__ for v in column if v is not None} for column in zip(*rows)] if rows else []


def main() -> int:
    scale = sys.argv[1] if len(sys.argv) > 1 else "0.001"
    wanted = sys.argv[2:]
    folder = f"/root/testdata/sf{scale}"
    con = duckdb.connect()
    for path in glob.glob(f"{folder}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    spark = build_session("8")
    bad = 0
    for name in sorted(QUERIES):
        if wanted and not any(name.startswith(w) for w in wanted):
            continue
        started = time.time()
        try:
            df = QUERIES[name](spark, folder)
            mine = rows_of(df.columns, [tuple(r) for r in df.collect()])
        except Exception as error:  # report and go on
            print(f"FAIL {name}: spark: {str(error)[:700]}")
            bad += 1
            continue
        spent = time.time() - started
        if name not in ORACLES:
            print(f"rows {name}: {len(mine)} rows {spent:.1f}s")
            continue
        try:
            cursor = con.execute(ORACLES[name])
            theirs_names = [d[0] for d in cursor.description]
            theirs = rows_of(theirs_names, cursor.fetchall())
        except Exception as error:
            print(f"FAIL {name}: sql: {str(error)[:700]}")
            bad += 1
            continue
        if sorted(df.columns) != sorted(theirs_names):
            print(f"FAIL {name}: columns {sorted(df.columns)} / {sorted(theirs_names)}")
            bad += 1
        elif mine != theirs or kinds(mine) != kinds(theirs):
            only_m = [r for r in mine if r not in set(theirs)][:3] if len(mine) < 50000 else mine[:2]
            only_t = [r for r in theirs if r not in set(mine)][:3] if len(theirs) < 50000 else theirs[:2]
            print(f"FAIL {name}: {len(mine)} / {len(theirs)} rows\n  spark {only_m}\n  sql   {only_t}\n  {kinds(mine)} {kinds(theirs)}")
            bad += 1
        else:
            print(f"ok   {name}: {len(mine)} rows {spent:.1f}s, sql {time.time() - started - spent:.1f}s")
    print("failed:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(1 if main() else 0)
