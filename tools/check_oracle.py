"""Compare registered queries with their oracle SQL: ``check_oracle.py SF [key ...]``."""

from __future__ import annotations

import math
import os
import sys
import time
import traceback
from collections import Counter

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from folioscope.catalog import registry  # noqa: E402
from folioscope.session import local_session  # noqa: E402

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def _cell(v: object) -> object:
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.6g}" if abs(v) > 1e6 else f"{v + 0.0:.6f}"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, int):
        return str(v)
    return str(v)


def _rows(columns: list[str], rows: list) -> Counter:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(_cell(r[i]) for i in order) for r in rows)


def main() -> int:
    sf_dir = f"/root/testdata/sf{sys.argv[1]}"
    spark = local_session(8)
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    queries, oracles = registry.queries(), registry.oracle_sql()
    wanted = sys.argv[2:] or list(queries)
    bad = []
    for key in wanted:
        started = time.time()
        try:
            df = queries[key](spark, sf_dir)
            got = df.collect()
            note = f"{len(got)} rows, {time.time() - started:.1f}s"
            if key in oracles:
                result = con.execute(oracles[key])
                names = [d[0] for d in result.description]
                want = result.fetchall()
                if sorted(names) != sorted(df.columns):
                    bad.append(key)
                    note += f" COLUMNS {sorted(df.columns)} vs {sorted(names)}"
                else:
                    a, b = _rows(df.columns, got), _rows(names, want)
                    if a != b:
                        bad.append(key)
                        note += f" MISMATCH oracle {len(want)} rows\n   spark-only {list((a - b).items())[:3]}\n   oracle-only {list((b - a).items())[:3]}"
                    else:
                        note += " ok"
            else:
                note += " (rows only)"
        except Exception as exc:
            bad.append(key)
            note = f"ERROR {type(exc).__name__}: {str(exc)[:600]}"
            if os.environ.get("TRACE"):
                traceback.print_exc()
        print(f"{key}: {note}", flush=True)
    print("bad:", bad)
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main())
