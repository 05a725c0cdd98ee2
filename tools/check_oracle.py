"""Run every registered query next to its SQL in DuckDB and report differences.

usage: python tools/check_oracle.py [sf_dir] [name ...]
"""

from __future__ import annotations

import math
import os
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402

from tabulith import catalog  # noqa: E402
from tabulith.session import build_session, discard_scratch  # noqa: E402

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, bool) or isinstance(v, str):
        return v
    if isinstance(v, (int, float)):
        return float(f"{float(v):.10g}") + 0.0
    if hasattr(v, "isoformat"):
        return v.isoformat()
    if isinstance(v, (list, tuple)):
        return tuple(_plain(x) for x in v)
    return v if isinstance(v, (int, str)) else float(v) if hasattr(v, "as_tuple") else str(v)


def _kind(name: str) -> str:
    name = name.lower()
    for kind, words in (("int", ("int", "long", "short", "byte")), ("float", ("double", "float", "decimal")),
                        ("text", ("string", "varchar")), ("bool", ("bool",)), ("time", ("timestamp", "date"))):
        if any(w in name for w in words):
            return kind
    return name


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(_plain(r[i]) for i in order) for r in rows), key=repr)


def compare(df, con, sql) -> str | None:
    """None if equal, else what differs."""
    got = df.collect()
    res = con.execute(sql)
    names = [d[0] for d in res.description]
    kinds = {d[0]: _kind(str(d[1])) for d in res.description}
    want = res.fetchall()
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} != {sorted(names)}"
    off = {c: (t, kinds[c]) for c, t in df.dtypes if _kind(t) != kinds[c]}
    if off:
        return f"types {off}"
    if len(got) != len(want):
        return f"rows {len(got)} != {len(want)}"
    a, b = rows_of(df.columns, got), rows_of(names, want)
    if a != b:
        bad = [(x, y) for x, y in zip(a, b) if x != y]
        return f"{len(bad)} rows differ ({sorted(names)}), first: {bad[0]}"
    return None


def main() -> int:
    args = sys.argv[1:]
    sf_dir = args[0] if args else "/root/testdata/sf0.01"
    spark = build_session("local[8]", **{"spark.checkpoint.dir": tempfile.mkdtemp(prefix="oracle-"), "spark.sql.shuffle.partitions": "8", "spark.driver.memory": "16g",
                                         "spark.ui.enabled": "false",
                                         "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    catalog.load()
    con = duck(sf_dir)
    wanted = [n for n in catalog.QUERIES if not args[1:] or n in args[1:] or any(
        a.endswith("*") and n.startswith(a[:-1]) for a in args[1:])]
    failed = 0
    for name in wanted:
        start = time.time()
        try:
            df = catalog.QUERIES[name](spark, sf_dir)
            if name in catalog.ORACLES:
                diff = compare(df, con, catalog.ORACLES[name])
                note = "ok" if diff is None else f"DIFF {diff}"
            else:
                note = f"rows {df.count()}"
        except Exception as e:  # report and go on with the next query
            note = f"ERROR {type(e).__name__}: {str(e)[:1500]}"
        discard_scratch(spark)
        failed += note.startswith(("DIFF", "ERROR"))
        print(f"{time.time() - start:6.2f}s {name}: {note}", flush=True)
    print(f"{len(wanted)} queries, {failed} failed")
    return 1 if failed else 0


if __name__ == "__main__":
    sys.exit(main())
