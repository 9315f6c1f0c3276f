"""Run registered queries against their SQL counterparts: ``python tests/check_oracle.py [sf_dir] [name ...]``."""

from __future__ import annotations

import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from __spark_entry__ import oracle_sql, queries  # noqa: E402

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"


def connect(sf: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES.split():
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf}/{name}.parquet')")
    return con


def normal(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = []
    for row in rows:
        cells = []
        for i in order:
            v = row[i]
            cells.append("" if v is None else f"{v:.6f}" if isinstance(v, float) else str(v))
        out.append(tuple(cells))
    return sorted(columns), sorted(out)


def compare(spark, con, name: str, sf: str):
    """Rows only on the Spark side, rows only on the SQL side, row count."""
    df = queries()[name](spark, sf)
    left_columns, left = normal([tuple(r) for r in df.collect()], df.columns)
    cur = con.execute(oracle_sql()[name])
    right_columns, right = normal(cur.fetchall(), [c[0] for c in cur.description])
    assert left_columns == right_columns, (left_columns, right_columns)
    if left == right:
        return [], [], len(left)
    a, b = set(left), set(right)
    return sorted(a - b) or ["multiplicity"], sorted(b - a) or ["multiplicity"], len(left)


def main() -> int:
    from aprlens.session import local_session

    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:] or list(queries())
    spark, con, failed = local_session(), connect(sf), 0
    spark.sparkContext.setLogLevel("ERROR")
    for name in names:
        start = time.time()
        try:
            left, right, rows = compare(spark, con, name, sf)
        except Exception as error:  # noqa: BLE001
            print(f"ERR  {name}: {type(error).__name__} {str(error)[:1500]}")
            failed += 1
            continue
        ok = not left and not right
        failed += not ok
        print(f"{'ok  ' if ok else 'DIFF'} {name}: {rows} rows, {time.time() - start:.1f}s")
        if not ok:
            print("   spark", len(left), left[:3])
            print("   sql  ", len(right), right[:3])
    print("missing oracle:", sorted(set(queries()) - set(oracle_sql())), "failed:", failed)
    return 1 if failed else 0


if __name__ == "__main__":
    sys.exit(main())
