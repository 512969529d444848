"""Run registered queries and their SQL twins on the same tables and compare all rows.

    [blockRows=60 broadcastRows=20] python tests/compare.py [sf_dir] [name prefix ...]
"""

from __future__ import annotations

import math
import os
import sys
import time
import warnings

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def _plain(v):
    if v is None or isinstance(v, bool):
        return v
    if isinstance(v, float):
        return "nan" if math.isnan(v) else v
    if hasattr(v, "as_tuple"):
        return float(v) if v % 1 else int(v)
    return v


def _key(row):
    return tuple((v is None, str(v)) for v in row)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted((tuple(_plain(r[i]) for i in order) for r in rows), key=_key)


def difference(spark_df, con, sql: str) -> str | None:
    """None when equal, otherwise what differs first."""
    got_cols, got = rows_of(spark_df.columns, [tuple(r) for r in spark_df.collect()])
    cur = con.execute(sql)
    want_cols, want = rows_of([d[0] for d in cur.description], cur.fetchall())
    if got_cols != want_cols:
        return f"columns {got_cols} != {want_cols}"
    if len(got) != len(want):
        return f"{len(got)} rows, SQL has {len(want)}; e.g. {got[:2]} / {want[:2]}"
    for g, w in zip(got, want):
        for a, b in zip(g, w):
            if a != b or type(a) is not type(b):
                return f"{g} != {w}"
    return None


def main(argv: list[str]) -> int:
    warnings.filterwarnings("ignore")
    import __spark_entry__ as entry
    from lapcast.session import build_session

    sf = argv[0] if argv else "/root/testdata/sf0.01"
    spark = build_session(8, 8)
    spark.sparkContext.setLogLevel("ERROR")
    # Small limits send even small tables down the paths for over-full keys and large lookups.
    for name in ("blockRows", "broadcastRows"):
        if name in os.environ:
            spark.conf.set(f"lapcast.{name}", os.environ[name])
    con = connect(sf)
    bad = 0
    twins = entry.oracle_sql()
    for name, f in entry.queries().items():
        if argv[1:] and not any(name.startswith(p) for p in argv[1:]):
            continue
        start = time.time()
        try:
            df = f(spark, sf)
            if name in twins:
                verdict = difference(df, con, twins[name])
                verdict = "ok" if verdict is None else f"DIFFERS {verdict[:600]}"
            else:
                verdict = f"rows {df.count()}"
        except Exception as e:  # noqa: BLE001
            verdict = f"FAILED {type(e).__name__}: {str(e)[:900]}"
        bad += not (verdict == "ok" or verdict.startswith("rows"))
        print(f"{time.time() - start:6.2f}s {name}: {verdict}", flush=True)
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1:]) else 0)
