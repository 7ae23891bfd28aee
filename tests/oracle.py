"""Run queries in Spark and their SQL in DuckDB and compare whole results.

    python tests/oracle.py /root/testdata/sf0.01 [name-prefix ...]
"""
from __future__ import annotations

import math
import os
import sys
import time

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()


def canon(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "~"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, float):
        return repr(round(v, 6) + 0.0)
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(canon(x) for x in v) + "]"
    return str(v)


def duck(root: str):
    import duckdb

    con = duckdb.connect()
    con.sql("SET TimeZone='UTC'")
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{root}/{t}.parquet'")
    return con


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], sorted(tuple(canon(r[i]) for i in order) for r in rows)


def compare(q, spark, con, root):
    df = q.run(spark, root)
    got_names, got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    if q.sql is None:
        return f"rows-only {len(got)}", bool(got), []
    rel = con.sql(q.sql)
    names, types = rel.columns, [str(t) for t in rel.types]
    want_names, want = rows_of(names, rel.fetchall())
    notes = []
    for n, t in zip(names, types):
        have = dict(df.dtypes).get(n)
        loose = {"HUGEINT": "?", "BIGINT": "bigint", "INTEGER": "int", "DOUBLE": "double", "VARCHAR": "string",
                 "BOOLEAN": "boolean"}.get(t)
        if have and loose and have != loose:
            notes.append(f"type {n}: {have} vs {t}")
        if t.startswith("DECIMAL") or (have or "").startswith("decimal"):
            notes.append(f"decimal {n}: {have} vs {t}")
    if got_names != want_names:
        return f"columns {got_names} vs {want_names}", False, notes
    if got != want:
        a, b = set(got), set(want)
        only_got, only_want = sorted(a - b)[:3], sorted(b - a)[:3]
        return f"{len(got)} vs {len(want)} rows; differ {len(a - b)}/{len(b - a)}\n   S {only_got}\n   D {only_want}", False, notes
    return f"{len(got)} rows", bool(got), notes


def main() -> None:
    from chorale.plans import QUERIES
    from chorale.session import build_session

    root, wanted = sys.argv[1], sys.argv[2:]
    chosen = [q for n, q in QUERIES.items() if not wanted or any(n.startswith(w) for w in wanted)]
    spark, con, bad = build_session(), duck(root), []
    for q in chosen:
        t = time.time()
        try:
            text, ok, notes = compare(q, spark, con, root)
        except Exception as e:  # report and go on
            text, ok, notes = f"{type(e).__name__}: {str(e)[:700]}", False, []
        print(f"{'ok  ' if ok else 'FAIL'} {q.name} {time.time() - t:.1f}s {text} {'; '.join(notes)}", flush=True)
        if not ok:
            bad.append(q.name)
    print(f"{len(chosen) - len(bad)} of {len(chosen)} agree; failing: {bad}")
    spark.stop()


if __name__ == "__main__":
    main()
