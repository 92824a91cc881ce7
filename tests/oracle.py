"""Run a query and its SQL side by side. As a script: python tests/oracle.py [sf] [name part ...]"""

from __future__ import annotations

import math
import sys
import time

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()


def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def _plain(v):
    if v is None:
        return "~"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v if v != int(v) or abs(v) > 1e15 else float(v))
    if type(v).__name__ == "Decimal":
        return repr(float(v))
    return str(v)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(_plain(r[i]) for i in order) for r in rows), [columns[i] for i in order]


def compare(spark, con, name, fn, sql, sf_dir):
    df = fn(spark, sf_dir)
    got, got_cols = rows_of(df.columns, [tuple(r) for r in df.collect()])
    if sql is None:
        return True, f"{len(got)} rows, no SQL"
    cur = con.execute(sql)
    want, want_cols = rows_of([d[0] for d in cur.description], cur.fetchall())
    if got_cols != want_cols:
        return False, f"columns {got_cols} != {want_cols}"
    if got != want:
        wanted, found = set(want), set(got)
        only_got, only_want = [r for r in got if r not in wanted][:3], [r for r in want if r not in found][:3]
        return False, f"{len(got)} vs {len(want)} rows\n  spark only {only_got}\n  duck only  {only_want}"
    return True, f"{len(got)} rows"


if __name__ == "__main__":
    sys.path.insert(0, "/root/repo")
    import __spark_entry__ as entry

    from datavigil.session import get_spark

    sf_dir = f"/root/testdata/{sys.argv[1] if len(sys.argv) > 1 else 'sf0.01'}"
    spark = get_spark("check", "local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false",
                                              "spark.driver.memory": "8g"})
    spark.sparkContext.setLogLevel("ERROR")
    con = duck(sf_dir)
    parts, bad = sys.argv[2:], []
    oracle = entry.oracle_sql()
    for name, fn in entry.queries().items():
        if parts and not any(p in name for p in parts):
            continue
        start = time.time()
        try:
            ok, note = compare(spark, con, name, fn, oracle.get(name), sf_dir)
        except Exception as e:  # noqa: BLE001
            ok, note = False, f"{type(e).__name__}: {str(e)[:1500]}"
        print(f"{'ok  ' if ok else 'FAIL'} {time.time() - start:6.2f}s {name}: {note}", flush=True)
        if not ok:
            bad.append(name)
    print(f"{len(bad)} failed: {bad}")
