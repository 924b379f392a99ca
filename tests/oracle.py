"""Compare registered queries with their SQL in DuckDB, value by value.

Command line: python -m tests.oracle [sf] [query ...]
"""

from __future__ import annotations

import math
import sys
import time

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def _plain(v):
    if isinstance(v, float) and math.isnan(v):
        return None
    return v


def _sorted(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(_plain(r[i]) for i in order) for r in rows]
    return [columns[i] for i in order], sorted(out, key=repr)


TYPES = {"string": "VARCHAR", "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE",
         "boolean": "BOOLEAN"}


def compare(spark, con, query, sql, sf_dir):
    """None if both give the same rows, else a description of the difference."""
    df = query(spark, sf_dir)
    got_cols, got = _sorted(df.columns, [tuple(r) for r in df.collect()])
    result = con.execute(sql)
    want_cols, want = _sorted([c[0] for c in result.description], result.fetchall())
    if got_cols != want_cols:
        return f"columns {got_cols} != {want_cols}"
    got_types = {n: TYPES.get(t, t) for n, t in df.dtypes}
    want_types = {c[0]: str(c[1]) for c in result.description}
    if got_types != want_types:
        return f"types { {n: (t, want_types[n]) for n, t in got_types.items() if t != want_types[n]} }"
    if len(got) != len(want):
        return f"rows {len(got)} != {len(want)}"
    bad = [(g, w) for g, w in zip(got, want, strict=True) if repr(g) != repr(w)]
    if bad:
        g, w = bad[0]
        diff = {c: (str(x)[:300], str(y)[:300])
                for c, x, y in zip(got_cols, g, w, strict=True) if repr(x) != repr(y)}
        return f"{len(bad)} of {len(got)} rows differ, first (key {str(g[-1])[:40]}): {diff}"
    return None


def main() -> int:
    from __spark_entry__ import oracle_sql, queries
    from codecorpus.session import local_session

    args = sys.argv[1:]
    sf = args[0] if args else "0.01"
    sf_dir = f"/root/testdata/sf{sf}"
    spark, con = local_session(), connect(sf_dir)
    qs, oracles, failed = queries(), oracle_sql(), 0
    for name in args[1:] or qs:
        start = time.time()
        try:
            if name in oracles:
                problem = compare(spark, con, qs[name], oracles[name], sf_dir)
                note = ""
            else:
                note, problem = f" (rows only: {qs[name](spark, sf_dir).count()})", None
        except Exception as e:
            problem, note = f"{type(e).__name__}: {str(e)[:1500]}", ""
        failed += problem is not None
        print(f"{'FAIL' if problem else 'ok  '} {name} {time.time() - start:.2f}s{note} {problem or ''}",
              flush=True)
    print(f"{failed} failed")
    return failed


if __name__ == "__main__":
    sys.exit(main())
