"""Run registered queries on Spark and their SQL twins on DuckDB, and compare whole results."""

from __future__ import annotations

import datetime
import math
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
    "labels conversations"
).split()


def duck(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _norm(v):
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return v + 0.0
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    if isinstance(v, datetime.datetime):
        return v.isoformat()
    if hasattr(v, "asDict"):
        return tuple(_norm(x) for x in v)
    return v


def rows_of(cols, raw):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    rows = [tuple(_norm(r[i]) for i in order) for r in raw]
    rows.sort(key=lambda r: tuple((x is None, str(type(x)), x if x is not None else 0) for x in r))
    return [cols[i] for i in order], rows


def type_family(name: str) -> str:
    n = name.lower()
    for fam, keys in {
        "list": ("array", "[]"),
        "int": ("bigint", "int", "long", "short", "hugeint"),
        "float": ("double", "float", "decimal", "real"),
        "str": ("string", "varchar"),
        "bool": ("bool",),
        "time": ("timestamp", "date"),
    }.items():
        if any(k in n for k in keys):
            return fam
    return n


def compare(df, con, sql) -> str | None:
    """None when equal, else a short description of the first difference."""
    s_cols, s_rows = rows_of(df.columns, df.collect())
    cur = con.execute(sql)
    d_types = {c[0]: str(c[1]) for c in cur.description}
    d_cols, d_rows = rows_of([c[0] for c in cur.description], cur.fetchall())
    if s_cols != d_cols:
        return f"columns {s_cols} vs {d_cols}"
    s_types = dict(df.dtypes)
    for c in s_cols:
        a, b = s_types[c], d_types[c]
        exact = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}
        if a in exact and exact[a] != b:
            return f"type of {c}: {a} vs {b}"
    if len(s_rows) != len(d_rows):
        return f"row count {len(s_rows)} vs {len(d_rows)}; e.g. {s_rows[:2]} vs {d_rows[:2]}"
    bad = [(a, b) for a, b in zip(s_rows, d_rows) if a != b]
    if bad:
        return f"{len(bad)} of {len(s_rows)} rows differ; e.g.\n   {s_cols}\n   {bad[0][0]}\n   {bad[0][1]}"
    return None


def main(argv):
    import __spark_entry__ as E
    from cytomesh.session import local_session

    sf_dir = "/root/testdata/sf0.01"
    if argv and argv[0].startswith("/"):
        sf_dir = argv.pop(0)
    spark = local_session()
    con = duck(sf_dir)
    qs, oracles = E.queries(), E.oracle_sql()
    names = [n for n in qs if not argv or any(n.startswith(a) or a in n for a in argv)]
    failed = 0
    for name in names:
        t = time.time()
        try:
            df = qs[name](spark, sf_dir)
            if name in oracles:
                msg = compare(df, con, oracles[name])
            else:
                n = df.count()
                msg = None if n > 0 else "no rows"
        except Exception as exc:  # report and go on
            msg = f"{type(exc).__name__}: {str(exc)[:1500]}"
        failed += msg is not None
        kind = "sql " if name in oracles else "rows"
        print(f"{'OK  ' if msg is None else 'FAIL'} {kind} {time.time() - t:6.2f}s {name}" + (f"\n   {msg}" if msg else ""), flush=True)
    print(f"{len(names)} queries, {failed} failed")
    return failed


if __name__ == "__main__":
    sys.exit(min(1, main(sys.argv[1:])))
