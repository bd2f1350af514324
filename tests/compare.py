"""Side-by-side run of Spark queries and their SQL oracles."""

from __future__ import annotations

import datetime as dt
import decimal
import math
import sys
import time
from collections import Counter

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, decimal.Decimal):
        return repr(float(v))
    if isinstance(v, (int, float)):
        return repr(float(v) + 0.0)
    if isinstance(v, (dt.datetime, dt.date)):
        return v.isoformat()
    return str(v)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(plain(r[i]) for i in order) for r in rows)


def connect(sf_dir):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def compare(spark, con, name, build, sql, sf_dir):
    """None if equal, else a short description."""
    df = build(spark, sf_dir)
    got = rows_of(df.columns, df.collect())
    if sql is None:
        return None if sum(got.values()) else "no rows"
    con.execute(sql)
    columns = [d[0] for d in con.description]
    want = rows_of(columns, con.fetchall())
    if sorted(columns) != sorted(df.columns):
        return f"columns {sorted(df.columns)} != {sorted(columns)}"
    if got == want:
        return None if sum(want.values()) else "no rows on either side"
    extra, lost = got - want, want - got
    return (
        f"{sum(got.values())} rows, oracle {sum(want.values())}; "
        f"{sum(extra.values())} only here {list(extra)[:2]}; {sum(lost.values())} only there {list(lost)[:2]}"
    )


def main(pattern="", sf="0.01"):
    import re
    import traceback

    sys.path.insert(0, __file__.rsplit("/", 2)[0])
    import __spark_entry__ as entry
    from isotherm import build_session

    sf_dir = f"/root/testdata/sf{sf}"
    spark = build_session(
        "check", "local[8]",
        **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "8g"},
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    queries, oracles = entry.queries(), entry.oracle_sql()
    bad = 0
    for name in queries:
        if not re.search(pattern, name):
            continue
        start = time.time()
        try:
            problem = compare(spark, con, name, queries[name], oracles.get(name), sf_dir)
        except Exception as error:
            problem = f"{type(error).__name__}: {str(error)[:700]}"
            if "-v" in sys.argv:
                traceback.print_exc()
        bad += problem is not None
        kind = "sql" if name in oracles else "rows"
        print(f"{'ok  ' if problem is None else 'FAIL'} {kind:4} {time.time() - start:6.2f}s {name}{'' if problem is None else '  ' + problem}", flush=True)
    print(f"{bad} problems")


if __name__ == "__main__":
    main(*[a for a in sys.argv[1:] if a != "-v"])
