"""python tests/oracle.py [SF_DIR] [NAME...]: runs queries against their DuckDB SQL and reports rows that differ."""

from __future__ import annotations

import math
import os
import sys
import time
from collections import Counter

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(x):  # noqa: ANN001, ANN201
    if isinstance(x, float):
        return None if math.isnan(x) else float(f"{x:.6g}")
    if isinstance(x, dict):
        return tuple(sorted((k, plain(v)) for k, v in x.items()))
    if isinstance(x, (list, tuple)):
        return tuple(plain(v) for v in x)
    if type(x).__name__ == "Decimal":
        return float(f"{float(x):.6g}")
    return x


def compare(spark, query, sql: str, folder: str) -> tuple[int, int, list, list]:  # noqa: ANN001
    """Rows on both sides, and what only one of them has."""
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    frame = query(spark, folder)
    names = sorted(frame.columns)
    mine = Counter(tuple(plain(v) for v in r) for r in frame.select(*[f"`{n}`" for n in names]).collect())
    got = con.execute(sql)
    theirs_names = [d[0] for d in got.description]
    assert sorted(theirs_names) == names, (names, sorted(theirs_names))
    order = [theirs_names.index(n) for n in names]
    theirs = Counter(tuple(plain(r[i]) for i in order) for r in got.fetchall())
    return sum(mine.values()), sum(theirs.values()), list((mine - theirs).items())[:3], list((theirs - mine).items())[:3]


if __name__ == "__main__":
    import __spark_entry__ as entry
    from pyspark.sql import SparkSession

    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark = SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8").config("spark.driver.memory", "6g").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    queries, sql = entry.queries(), entry.oracle_sql()
    bad = 0
    for name in sys.argv[2:] or queries:
        began = time.time()
        try:
            if name not in sql:
                print(f"{name}: no SQL, {queries[name](spark, folder).count()} rows, {time.time() - began:.1f} s", flush=True)
                continue
            n, m, a, b = compare(spark, queries[name], sql[name], folder)
            bad += bool(a or b)
            print(f"{name}: {'DIFFERS' if a or b else 'equal'}, {n} and {m} rows, {time.time() - began:.1f} s", *(["\n  mine", a, "\n  sql ", b] if a or b else []), flush=True)
        except Exception as e:  # noqa: BLE001
            bad += 1
            print(f"{name}: FAILED {type(e).__name__} {str(e)[:700]}", flush=True)
    print("bad:", bad)
