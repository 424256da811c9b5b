"""Run registered queries and their SQL on the same tables and compare whole results."""

import math
import sys
import time

import duckdb
from pyspark.sql import SparkSession

from plumbline.sources.views import BASE

DATA = "/root/testdata"


def session(cores="8", partitions="8"):
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("plumbline")
        .config("spark.sql.shuffle.partitions", partitions)
        .config("spark.driver.memory", "12g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.parallelismFirst", "false")
        .getOrCreate()
    )


def connect(sf_dir):
    con = duckdb.connect()
    for name in BASE:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return con


def _cell(value):
    if isinstance(value, bool):
        return ("b", value)
    if isinstance(value, float):
        return ("f", "nan" if math.isnan(value) else repr(value + 0.0))
    if isinstance(value, int):
        return ("i", value)
    if value is None:
        return ("n", "")
    return ("s", str(value))


def normal(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(str([_cell(r[i]) for i in order]) for r in rows)


def compare(spark, con, name, queries, oracles, sf_dir):
    """Returns (spark rows, problem or None, seconds)."""
    start = time.time()
    df = queries[name](spark, sf_dir)
    columns = df.columns
    rows = [tuple(r) for r in df.collect()]
    spent = time.time() - start
    if name not in oracles:
        return len(rows), None if rows else "no rows", spent
    result = con.execute(oracles[name])
    names = [d[0] for d in result.description]
    kinds = [str(d[1]) for d in result.description]
    theirs = result.fetchall()
    if any("HUGEINT" in k or "DECIMAL" in k for k in kinds):
        return len(rows), f"oracle types {list(zip(names, kinds))}", spent
    mine, other = normal(columns, rows), normal(names, theirs)
    if mine[0] != other[0]:
        return len(rows), f"columns {mine[0]} / {other[0]}", spent
    if mine[1] != other[1]:
        a, b = set(mine[1]), set(other[1])
        return (
            len(rows),
            f"rows {len(mine[1])}/{len(other[1])}; only Spark {sorted(a - b)[:3]}; only SQL {sorted(b - a)[:3]}",
            spent,
        )
    return len(rows), None, spent


def main(argv):
    from __spark_entry__ import oracle_sql, queries

    sf = argv[1]
    spark = session()
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(f"{DATA}/{sf}")
    q, o = queries(), oracle_sql()
    wanted = [n for n in q if not argv[2:] or any(n.startswith(p) for p in argv[2:])]
    bad = 0
    for name in wanted:
        try:
            n, problem, spent = compare(spark, con, name, q, o, f"{DATA}/{sf}")
        except Exception as error:
            n, problem, spent = -1, f"{type(error).__name__}: {str(error)[:1500]}", 0.0
        if problem:
            bad += 1
        mark = "ok" if not problem else "BAD"
        print(f"{mark:4}{name:32}{n:8}{spent:8.2f}s {'' if name in o else '(rows only)'} {problem or ''}", flush=True)
    print(f"{len(wanted)} queries, {bad} bad", flush=True)


if __name__ == "__main__":
    main(sys.argv)
