"""Run registered queries against their DuckDB oracle (development tool).

usage: python tests/compare_oracle.py [sf_dir] [name ...]

Compares column names, row counts and an order-insensitive hash of the
values (columns sorted by name), as the correctness gate does.
"""

from __future__ import annotations

import hashlib
import math
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


def _norm(v):
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return repr(round(v, 6))
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(_norm(x) for x in v) + "]"
    if isinstance(v, dict):
        return "{" + ",".join(f"{k}:{_norm(v[k])}" for k in sorted(v)) + "}"
    return repr(v)


def digest(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    lines = sorted("|".join(_norm(r[i]) for i in order) for r in rows)
    return hashlib.sha256("\n".join(lines).encode()).hexdigest()[:16], lines


def main(argv):
    sf = argv[1] if len(argv) > 1 else "/root/testdata/sf0.01"
    only = set(argv[2:])
    import duckdb

    import __spark_entry__ as E
    from tessera.plans.catalog import QUERIES
    from tessera.session import get_session
    from tessera.sources.tables import TABLES

    spark = get_session()
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    qs, oracles = E.queries(), E.oracle_sql()
    ok = bad = 0
    for name in QUERIES:
        if only and name not in only:
            continue
        t0 = time.time()
        try:
            df = qs[name](spark, sf)
            cols = df.columns
            rows = [tuple(r) for r in df.collect()]
        except Exception as exc:  # noqa: BLE001
            print(f"FAIL {name}: spark error {type(exc).__name__}: {str(exc)[:400]}")
            bad += 1
            continue
        ts = time.time() - t0
        if name not in oracles:
            print(f"ROWS {name}: {len(rows)} rows ({ts:.1f}s, no oracle)")
            continue
        try:
            cur = con.execute(oracles[name])
            ocols = [d[0] for d in cur.description]
            orows = cur.fetchall()
        except Exception as exc:  # noqa: BLE001
            print(f"FAIL {name}: oracle error {str(exc)[:400]}")
            bad += 1
            continue
        h1, l1 = digest(cols, rows)
        h2, l2 = digest(ocols, orows)
        same = sorted(cols) == sorted(ocols) and len(rows) == len(orows) and h1 == h2
        if same:
            ok += 1
            print(f"OK   {name}: {len(rows)} rows ({ts:.1f}s)")
        else:
            bad += 1
            print(f"DIFF {name}: cols {sorted(cols)} vs {sorted(ocols)}; rows {len(rows)} vs {len(orows)}")
            s1, s2 = set(l1), set(l2)
            for x in sorted(s1 - s2)[:3]:
                print("   spark only:", x[:300])
            for x in sorted(s2 - s1)[:3]:
                print("   oracle only:", x[:300])
    print(f"matched {ok}, failed {bad}")


if __name__ == "__main__":
    main(sys.argv)
