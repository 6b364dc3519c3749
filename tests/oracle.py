"""Runs a query in Spark and its SQL in DuckDB over the same tables and compares all rows."""

from __future__ import annotations

import math
import sys
import time
from collections import Counter
from pathlib import Path

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(x):
    """A value that compares across engines: floats to nine digits, times as text."""
    if isinstance(x, float):
        if math.isnan(x):
            return "nan"
        return float(f"{x:.9g}")
    if isinstance(x, (list, tuple)):
        return tuple(plain(v) for v in x)
    if isinstance(x, dict):
        return tuple(sorted((k, plain(v)) for k, v in x.items()))
    if hasattr(x, "asDict"):
        return plain(x.asDict())
    if isinstance(x, (bytearray, bytes)):
        return bytes(x)
    return x


def in_duckdb(sql: str, sf_dir: str) -> tuple[list[str], list[tuple]]:
    db = duckdb.connect()
    db.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        path = Path(sf_dir, f"{t}.parquet")
        if path.exists():
            db.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path / '*.parquet' if path.is_dir() else path}')")
    got = db.execute(sql)
    return [d[0] for d in got.description], got.fetchall()


def differences(df, sql: str, sf_dir: str) -> str:
    """Empty where both agree, else what differs."""
    names, rows = in_duckdb(sql, sf_dir)
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} against {sorted(names)}"
    order = [names.index(c) for c in df.columns]
    mine = Counter(tuple(plain(v) for v in r) for r in df.collect())
    theirs = Counter(tuple(plain(r[k]) for k in order) for r in rows)
    if mine == theirs:
        return ""
    a, b = mine - theirs, theirs - mine
    return f"{sum(mine.values())} rows against {sum(theirs.values())}; {sum(a.values())} only here, {sum(b.values())} only there; {list(a)[:2]!r:.700} / {list(b)[:2]!r:.700}"


if __name__ == "__main__":
    sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
    import __spark_entry__ as entry
    from quillon.session import local_session

    spark, sf = local_session(cpus=4), sys.argv[1]
    queries, sqls = entry.queries(), entry.oracle_sql()
    names = sys.argv[2:] or [n for n in queries if n in sqls]
    for name in names:
        began = time.time()
        try:
            said = differences(queries[name](spark, sf), sqls[name], sf) if name in sqls else f"{queries[name](spark, sf).count()} rows, no SQL"
        except Exception as e:  # noqa: BLE001
            said = f"{type(e).__name__}: {str(e)[:900]}"
        print(f"{name}: {said or 'equal'} ({time.time() - began:.1f} s)", flush=True)
