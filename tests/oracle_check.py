"""Compare driver queries with their reference SQL: ``python tests/oracle_check.py SF_DIR [names]``."""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def plain(value):
    """One form for values of both engines: integers, floats, text, booleans, null."""
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return "null"
    if isinstance(value, bool):
        return str(value)
    if isinstance(value, float):
        return repr(value + 0.0)
    return str(value)


def rows_of(columns: list[str], rows) -> tuple[list[str], list[tuple]]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(plain(r[i]) for i in order) for r in rows)


def compare(spark, con, query, sql: str, sf_dir: str) -> str:
    """Empty text when both sides agree, else what differs."""
    df = query(spark, sf_dir)
    mine = rows_of(df.columns, df.collect())
    cursor = con.execute(sql)
    theirs = rows_of([d[0] for d in cursor.description], cursor.fetchall())
    if mine[0] != theirs[0]:
        return f"columns {mine[0]} != {theirs[0]}"
    if mine[1] != theirs[1]:
        extra, missing = set(mine[1]) - set(theirs[1]), set(theirs[1]) - set(mine[1])
        return (
            f"rows {len(mine[1])} vs {len(theirs[1])}; only spark {sorted(extra)[:2]}; "
            f"only sql {sorted(missing)[:2]}"
        )
    return "" if mine[1] else "EMPTY on both sides"


def main() -> None:
    import __spark_entry__ as entry
    from cohortgate.session import local_session

    sf_dir, names = sys.argv[1], sys.argv[2:]
    spark, con = local_session(), connect(sf_dir)
    queries, oracles = entry.queries(), entry.oracle_sql()
    for name in names or queries:
        start = time.time()
        try:
            if name in oracles:
                verdict = compare(spark, con, queries[name], oracles[name], sf_dir) or "ok"
            else:
                verdict = f"no sql, {queries[name](spark, sf_dir).count()} rows"
        except Exception as error:  # noqa: BLE001
            verdict = f"FAIL {type(error).__name__} {str(error)[:300]}"
        print(f"RESULT {name:30s} {time.time() - start:6.2f} {verdict[:700]}", flush=True)


if __name__ == "__main__":
    main()
