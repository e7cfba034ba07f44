"""Compare queries() with oracle_sql(): python tests/oracle_check.py [sf_dir] [name ...]

CHECK_CONF=key=value,... adds session settings, e.g. spark.meshlark.hotGroupRows=50 to take every
group above 50 rows through the split forms.
"""

from __future__ import annotations

import math
import os
import sys
import time

sys.path.insert(0, os.path.join(os.path.dirname(__file__), ".."))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def duck(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    con.execute("SET threads TO 8")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def _norm(v):
    if isinstance(v, bool) or v is None:
        return v
    if isinstance(v, float):
        return "nan" if math.isnan(v) else v + 0.0
    return v


def rows_of(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    out = [tuple(_norm(row[i]) for i in order) for row in rows]
    return [cols[i] for i in order], sorted(out, key=repr)


def compare(df, con, text: str) -> str | None:
    """None when equal, else a description of the first difference."""
    scols, srows = rows_of(df.columns, [tuple(x) for x in df.collect()])
    cur = con.execute(text)
    dcols, drows = rows_of([d[0] for d in cur.description], cur.fetchall())
    if scols != dcols:
        return f"columns {scols} vs {dcols}"
    if len(srows) != len(drows):
        return f"rows {len(srows)} vs {len(drows)}; spark {srows[:2]} oracle {drows[:2]}"
    diff = [(a, b) for a, b in zip(srows, drows) if a != b]
    if diff:
        return f"{len(diff)}/{len(srows)} rows differ, first: {diff[0]} {diff[len(diff)//2]}"
    kinds = {c: {type(v).__name__ for v in col if v is not None} for c, col in zip(scols, zip(*srows))} if srows else {}
    dkinds = {c: {type(v).__name__ for v in col if v is not None} for c, col in zip(dcols, zip(*drows))} if drows else {}
    return None if kinds == dkinds else f"types {kinds} vs {dkinds}"


def main() -> None:
    import __spark_entry__ as entry
    from meshlark.session import build_session

    args = sys.argv[1:]
    sf_dir = args[0] if args else "/root/testdata/sf0.01"
    extra = dict(kv.split("=", 1) for kv in os.environ.get("CHECK_CONF", "").split(",") if kv)
    spark = build_session("oracle-check", "local[8]", **{
        "spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.driver.memory": "8g", **extra})
    spark.sparkContext.setLogLevel("ERROR")
    con = duck(sf_dir)
    queries, oracles = entry.queries(), entry.oracle_sql()
    names = [n for n in (args[1:] or queries) if n in queries]
    bad = 0
    for name in names:
        t0 = time.time()
        try:
            df = queries[name](spark, sf_dir)
            if name in oracles:
                err = compare(df, con, oracles[name])
            else:
                err = None if df.count() > 0 else "no rows"
        except Exception as e:  # report and go on to the next query
            err = f"{type(e).__name__}: {str(e)[:1500]}"
        n = "" if name in oracles else " (rows only)"
        print(f"{'ok  ' if err is None else 'FAIL'} {name}{n} {time.time() - t0:.1f}s {err or ''}", flush=True)
        bad += err is not None
    print(f"{len(names) - bad}/{len(names)} ok; no query for oracle: {sorted(set(oracles) - set(queries))}")


if __name__ == "__main__":
    main()
