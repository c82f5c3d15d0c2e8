"""Run queries in Spark and in DuckDB and compare rows: ``python -m tests.compare [sf_dir] [query ...]``."""

import datetime
import decimal
import math
import sys
import time

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return con


def plain(value):
    """A value as both engines agree on it."""
    if isinstance(value, decimal.Decimal):
        value = float(value)
    if isinstance(value, float):
        return None if math.isnan(value) else value + 0.0
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None)
    return value


def sorted_rows(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(plain(row[i]) for i in order) for row in rows]
    return sorted(out, key=lambda row: tuple((v is None, str(v)) for v in row))


def differences(spark, con, name, query, sql, sf_dir, limit=3):
    """(what differs between the two engines, rows, seconds of the SQL)."""
    df = query(spark, sf_dir)
    got = sorted_rows([tuple(r) for r in df.collect()], df.columns)
    started = time.time()
    cursor = con.execute(sql)
    columns = [c[0] for c in cursor.description]
    want = sorted_rows(cursor.fetchall(), columns)
    sql_seconds = time.time() - started
    if sorted(df.columns) != sorted(columns):
        return [f"columns {sorted(df.columns)} and {sorted(columns)}"], len(got), sql_seconds
    found = [] if len(got) == len(want) else [f"{len(got)} and {len(want)} rows"]
    differing = [(a, b) for a, b in zip(got, want) if a != b]
    if differing:
        found.append(f"{len(differing)} rows differ, as {differing[:limit]}")
    return found, len(got), sql_seconds


def main() -> int:
    from briefwerk.plans.oracle import ORACLE
    from briefwerk.plans.queries import QUERIES
    from briefwerk.session import local_session

    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:] or list(QUERIES)
    spark, con, bad = local_session(), connect(sf_dir), 0
    for name in names:
        start = time.time()
        if name not in ORACLE:
            print(f"{name:28s} no SQL", flush=True)
            continue
        try:
            found, n, sql = differences(spark, con, name, QUERIES[name], ORACLE[name], sf_dir)
        except Exception as error:  # report and go on with the next query
            found, n, sql = [f"{type(error).__name__}: {str(error)[:700]}"], -1, 0.0
        bad += bool(found)
        print(f"{name:28s} {n:7d} rows {time.time() - start:6.1f}s (SQL {sql:5.1f}s) {'ok' if not found else found}", flush=True)
    print(f"{bad} differ")
    return bad


if __name__ == "__main__":
    sys.exit(1 if main() else 0)
