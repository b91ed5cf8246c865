"""Runs registered queries against their oracle SQL on DuckDB and compares whole results.

Usage: python tests/oracle.py [sf] [name ...]
"""

from __future__ import annotations

import collections
import math
import os
import sys
import time
import traceback

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def canon(value):
    if value is None:
        return None
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(round(value, 6) + 0.0)
    if isinstance(value, bool):
        return value
    if isinstance(value, int):
        return value
    if isinstance(value, str):
        return value
    raise TypeError(f"{type(value).__name__} {value!r}")


def compare(spark, con, name, query, sql, sf_dir):
    df = query(spark, sf_dir)
    cols = sorted(df.columns)
    left = collections.Counter(tuple(canon(r[c]) for c in cols) for r in df.select(*[f"`{c}`" for c in cols]).collect())
    if sql is None:
        return f"rows {sum(left.values())}", not left
    rel = con.sql(sql)
    names = list(rel.columns)
    if sorted(names) != cols:
        return f"columns {cols} vs {sorted(names)}", True
    order = [names.index(c) for c in cols]
    right = collections.Counter(tuple(canon(r[i]) for i in order) for r in rel.fetchall())
    if left == right:
        return f"ok {sum(left.values())}", sum(left.values()) == 0
    diff = left - right, right - left
    return (
        f"DIFF spark {sum(left.values())} oracle {sum(right.values())} cols {cols}\n"
        f"   only spark {sum(diff[0].values())}: {list(diff[0])[:3]}\n   only oracle {sum(diff[1].values())}: {list(diff[1])[:3]}"
    ), True


def main(argv):
    import duckdb

    import __spark_entry__ as entry
    from balanza.session import local_session

    sf = argv[0] if argv else "0.01"
    wanted = argv[1:]
    sf_dir = f"/root/testdata/sf{sf}"
    spark = local_session(8)
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    queries, oracle = entry.queries(), entry.oracle_sql()
    bad = []
    for name in wanted or queries:
        started = time.time()
        try:
            text, failed = compare(spark, con, name, queries[name], oracle.get(name), sf_dir)
        except Exception as err:  # noqa: BLE001
            text, failed = f"ERROR {type(err).__name__} {str(err)[:600]}", True
            if wanted:
                traceback.print_exc(limit=4)
        print(f"{name:28s} {time.time() - started:6.2f}s {text}", flush=True)
        if failed:
            bad.append(name)
    print(f"{len(wanted or queries)} queries, {len(bad)} to look at: {bad}")


if __name__ == "__main__":
    main(sys.argv[1:])
