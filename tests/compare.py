"""Run a query on Spark and its SQL on DuckDB and list the differences.

    python tests/compare.py [folder] [name ...]
"""

from __future__ import annotations

import math
import os
import sys
import time
from collections import Counter

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()

TYPES = {
    "BIGINT": "bigint",
    "INTEGER": "int",
    "DOUBLE": "double",
    "VARCHAR": "string",
    "BOOLEAN": "boolean",
    "TIMESTAMP": "timestamp_ntz",
}


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet'")
    return connection


def _key(row: tuple) -> tuple:
    return tuple("NaN" if isinstance(v, float) and math.isnan(v) else v for v in row)


def differences(df, connection: duckdb.DuckDBPyConnection, sql: str) -> list[str]:
    relation = connection.sql(sql)
    names = sorted(df.columns)
    found = []
    if names != sorted(relation.columns):
        return [f"columns {names} against {sorted(relation.columns)}"]
    theirs = dict(zip(relation.columns, map(str, relation.types), strict=True))
    for name, ours in df.dtypes:
        if TYPES.get(theirs[name], theirs[name]) != ours:
            found.append(f"type of {name}: {ours} against {theirs[name]}")
    place = [relation.columns.index(n) for n in names]
    left = Counter(_key(tuple(r)) for r in df.select(*[f"`{n}`" for n in names]).collect())
    right = Counter(_key(tuple(r[i] for i in place)) for r in relation.fetchall())
    if left != right:
        found.append(f"rows {sum(left.values())} against {sum(right.values())}")
        found.append(f"only Spark: {list((left - right).items())[:3]}")
        found.append(f"only DuckDB: {list((right - left).items())[:3]}")
    return found


def main() -> None:
    import __spark_entry__ as entry

    from tallymill.session import build_session

    args = sys.argv[1:]
    folder = args.pop(0) if args and "/" in args[0] else "/root/testdata/sf0.01"
    spark = build_session("compare", "local[8]", **{"spark.sql.shuffle.partitions": 8, "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    connection = connect(folder)
    queries, oracles = entry.queries(), entry.oracle_sql()
    failed = 0
    for name in args or queries:
        start = time.time()
        try:
            df = queries[name](spark, folder)
            if name in oracles:
                bad = differences(df, connection, oracles[name])
            else:
                bad = [] if df.count() >= 0 else []
        except Exception as error:  # noqa: BLE001
            bad = [f"{type(error).__name__}: {str(error)[:600]}"]
        failed += bool(bad)
        print(f"{'FAIL' if bad else 'ok  '} {name} {time.time() - start:.1f}s", *bad, sep="\n     ")
    print(f"{failed} failed")


if __name__ == "__main__":
    main()
