"""Run registered queries and their SQL twins side by side."""

from __future__ import annotations

import datetime
import decimal
import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def _cell(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.9g}"
    if isinstance(v, bool) or v is None:
        return str(v)
    if isinstance(v, (int, str)):
        return str(v)
    if isinstance(v, decimal.Decimal):
        return f"{float(v):.9g}"
    if isinstance(v, (datetime.date, datetime.datetime)):
        return v.isoformat()
    return repr(v)


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(_cell(r[i]) for i in order) for r in rows), [columns[i] for i in order]


def compare(spark, sf_dir, con, name, query, sql):
    """None when equal, else a short description of the difference."""
    df = query(spark, sf_dir)
    left, lc = _rows(df.columns, [tuple(r) for r in df.collect()])
    cur = con.execute(sql)
    right, rc = _rows([c[0] for c in cur.description], cur.fetchall())
    if lc != rc:
        return f"{name}: columns {lc} vs {rc}", len(left)
    if left == right:
        return None, len(left)
    in_left, in_right = set(left), set(right)
    only_l = [[c[:70] for c in r] for r in left if r not in in_right][:3]
    only_r = [[c[:70] for c in r] for r in right if r not in in_left][:3]
    return f"{name}: rows {len(left)} vs {len(right)}; columns {lc}\n  spark {only_l}\n  sql   {only_r}", len(left)


def main(argv):
    import __spark_entry__ as entry
    from clausegrid.session import build_session

    sf_dir = argv[0]
    wanted = argv[1:]
    spark = build_session(master="local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.driver.memory": "16g"})
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    queries, sqls = entry.queries(), entry.oracle_sql()
    bad = 0
    for name, query in queries.items():
        if wanted and not any(name.startswith(w) for w in wanted):
            continue
        start = time.time()
        try:
            if name in sqls:
                diff, n = compare(spark, sf_dir, con, name, query, sqls[name])
            else:
                diff, n = None, query(spark, sf_dir).count()
        except Exception as e:  # noqa: BLE001 - report and go on
            diff, n = f"{name}: {type(e).__name__} {str(e)[:1500]}", 0
        took = time.time() - start
        print(f"{'ok ' if diff is None else 'BAD'} {name} rows={n} {took:.1f}s{'' if name in sqls else ' (rows only)'}", flush=True)
        if diff:
            bad += 1
            print(diff[:2500], flush=True)
    print("bad:", bad)


if __name__ == "__main__":
    main(sys.argv[1:])
