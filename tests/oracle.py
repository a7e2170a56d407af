"""Side-by-side run of a query in Spark and its SQL in DuckDB."""

from __future__ import annotations

import math
import sys
import time
from collections import Counter

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def _cell(value):
    if isinstance(value, float):
        if math.isnan(value):
            return "nan"
        return f"{value:.6f}" if value else "0.000000"
    return value


def _rows(columns: list[str], rows) -> Counter:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(_cell(row[i]) for i in order) for row in rows)


def difference(frame, con, sql: str) -> str | None:
    """None if both agree, else what differs."""
    result = con.execute(sql)
    columns = [d[0] for d in result.description]
    expected = result.fetchall()
    if sorted(columns) != sorted(frame.columns):
        return f"columns {sorted(frame.columns)} != {sorted(columns)}"
    found = [tuple(r) for r in frame.collect()]
    a, b = _rows(frame.columns, found), _rows(columns, expected)
    if not expected:
        return "the query has no rows"
    if a == b:
        return None
    return f"{len(found)} vs {len(expected)} rows; only spark {list((a - b).items())[:3]}; only duckdb {list((b - a).items())[:3]}"


if __name__ == "__main__":
    sys.path.insert(0, ".")
    from __spark_entry__ import oracle_sql, queries
    from shelfspark.session import build_session

    sf_dir = sys.argv[1]
    wanted = sys.argv[2:] or list(queries())
    spark = build_session("oracle", "local[8]", {"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false",
                                                "spark.driver.memory": "8g"})
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    bad = 0
    for name in wanted:
        start = time.time()
        try:
            problem = difference(queries()[name](spark, sf_dir), con, oracle_sql()[name])
        except Exception as error:
            problem = f"{type(error).__name__}: {str(error)[:1500]}"
        bad += problem is not None
        print(f"{'OK  ' if problem is None else 'FAIL'} {name} {time.time() - start:.2f}s {problem or ''}", flush=True)
    print(f"{len(wanted) - bad} of {len(wanted)} agree")
