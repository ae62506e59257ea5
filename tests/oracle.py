"""Compare registered queries with their SQL: rows, columns and values.

    python tests/oracle.py SF_DIR [query ...]
"""

from __future__ import annotations

import datetime
import math
import sys
import time
from collections import Counter
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


def _cell(value):
    if isinstance(value, bool) or value is None or isinstance(value, str):
        return value
    if isinstance(value, (int, float)):
        if isinstance(value, float) and math.isnan(value):
            return "nan"
        return float(value)
    if isinstance(value, (datetime.date, datetime.datetime)):
        return value.isoformat()
    return str(value)


def sql_rows(sf_dir: str, sql: str):
    connection = duckdb.connect()
    connection.execute("SET TimeZone = 'UTC'")
    for path in sorted(Path(sf_dir).glob("*.parquet")):
        connection.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM read_parquet('{path}')")
    cursor = connection.execute(sql)
    names = [d[0] for d in cursor.description]
    return names, cursor.fetchall()


def bag(names, rows) -> Counter:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return Counter(tuple(_cell(row[i]) for i in order) for row in rows)


def compare(spark, sf_dir: str, function, sql: str) -> tuple[int, str | None]:
    """(Spark row count, what differs or None)."""
    df = function(spark, sf_dir)
    found = bag(df.columns, df.collect())
    names, rows = sql_rows(sf_dir, sql)
    if sorted(names) != sorted(df.columns):
        return found.total(), f"columns {sorted(df.columns)} != {sorted(names)}"
    wanted = bag(names, rows)
    if found == wanted:
        return found.total(), None
    extra, lacking = found - wanted, wanted - found
    return found.total(), (
        f"{found.total()} rows != {wanted.total()}; only Spark: {list(extra)[:2]}; "
        f"only SQL: {list(lacking)[:2]}"
    )


def main() -> int:
    import __spark_entry__
    from textmason.session import local_session

    QUERIES, ORACLES = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    sf_dir, chosen = sys.argv[1], sys.argv[2:] or list(QUERIES)
    spark = local_session("8")
    spark.sparkContext.setLogLevel("ERROR")
    bad = 0
    for name in chosen:
        start = time.time()
        try:
            if name in ORACLES:
                rows, problem = compare(spark, sf_dir, QUERIES[name], ORACLES[name])
            else:
                rows, problem = QUERIES[name](spark, sf_dir).count(), None
        except Exception as error:  # report and go on
            rows, problem = -1, f"{type(error).__name__}: {str(error)[:1500]}"
        state = "ok  " if problem is None else "FAIL"
        print(f"{state} {name:32} {rows:>8} rows {time.time() - start:6.2f}s "
              f"{'' if name in ORACLES else '(rows only)'} {problem or ''}", flush=True)
        bad += problem is not None
    print(f"{bad} of {len(chosen)} differ")
    return bad


if __name__ == "__main__":
    sys.exit(1 if main() else 0)
