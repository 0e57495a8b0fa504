"""Run registered queries on Spark and DuckDB and compare the rows.

    python -m tests.compare [-d SF_DIR] [-c ROWS_PER_CHUNK] [name-prefix ...]
"""

from __future__ import annotations

import argparse
import math
import time
from collections import Counter

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def oracle(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def cell(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v)
    if isinstance(v, (list, tuple)):
        return tuple(cell(x) for x in v)
    return v if v is None else str(v)


def difference(df, con, sql: str) -> str | None:
    cols = sorted(df.columns)
    got = df.select(*cols).collect()
    cur = con.execute(sql)
    names = [c[0] for c in cur.description]
    rows = cur.fetchall()
    if sorted(names) != cols:
        return f"columns {cols} vs {sorted(names)}"
    pick = [names.index(c) for c in cols]
    a = Counter(tuple(cell(v) for v in r) for r in got)
    b = Counter(tuple(cell(r[i]) for i in pick) for r in rows)
    if a == b:
        return None
    return (f"rows {len(got)} vs {len(rows)}; {cols}; only spark {sorted(map(str, a - b))[:3]}; "
            f"only oracle {sorted(map(str, b - a))[:3]}; n={sum((a - b).values())}/{sum((b - a).values())}")


def main() -> int:
    from chronoband.plans.registry import ORACLES, QUERIES
    import chronoband.plans  # noqa: F401
    from chronoband.session import ROWS_PER_CHUNK_CONF, session

    ap = argparse.ArgumentParser()
    ap.add_argument("-d", default="/root/testdata/sf0.01")
    ap.add_argument("-c", type=int)
    ap.add_argument("names", nargs="*")
    args = ap.parse_args()
    spark = session("local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false",
                                   "spark.driver.memory": "12g"})
    spark.sparkContext.setLogLevel("ERROR")
    if args.c:
        spark.conf.set(ROWS_PER_CHUNK_CONF, str(args.c))
    con = oracle(args.d)
    bad = 0
    for name, fn in QUERIES.items():
        if args.names and not any(name.startswith(p) for p in args.names):
            continue
        t = time.time()
        try:
            df = fn(spark, args.d)
            if name in ORACLES:
                msg = difference(df, con, ORACLES[name])
                state = "same" if msg is None else "DIFF " + msg
            else:
                state = f"rows {len(df.collect())}"
        except Exception as e:  # report and go on with the next query
            state = "FAIL " + str(e)[:1500]
        bad += not state.startswith(("same", "rows"))
        print(f"{time.time() - t:6.2f}s {name}: {state}", flush=True)
    print("problems:", bad)
    return bad


if __name__ == "__main__":
    raise SystemExit(main())
