"""Run named queries and their SQL equivalents side by side and compare rows.

    python tools/compare_engines.py [SF_DIR] [name-prefix ...]
"""

from __future__ import annotations

import datetime
import decimal
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()


def plain(value):
    if isinstance(value, bool) or value is None:
        return value
    if isinstance(value, decimal.Decimal):
        value = float(value)
    if isinstance(value, float):
        return "nan" if value != value else int(value) if value == int(value) and abs(value) < 1e15 else round(value, 9)
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None).isoformat()
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    if isinstance(value, dict):
        return tuple(sorted((k, plain(v)) for k, v in value.items()))
    return value


def normal(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr), [columns[i] for i in order]


def duck(sf_dir):
    import duckdb

    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return connection


def compare(spark, connection, sf_dir, name, fn, sql):
    """('ok' | 'rows' | problem text, row count, seconds)."""
    begin = time.time()
    frame = fn(spark, sf_dir)
    rows = [tuple(r) for r in frame.collect()]
    took = time.time() - begin
    if sql is None:
        return ("rows" if rows else "rows: EMPTY"), len(rows), took
    got, names = normal(frame.columns, rows)
    answer = connection.execute(sql)
    want_columns = [c[0] for c in answer.description]
    want, want_names = normal(want_columns, answer.fetchall())
    if names != want_names:
        return f"columns differ: {names} != {want_names}", len(rows), took
    if got != want:
        extra = [r for r in got if r not in want][:3] if len(got) < 30000 else "?"
        lost = [r for r in want if r not in got][:3] if len(want) < 30000 else "?"
        return f"rows differ: {len(got)} != {len(want)}\n   spark only {extra}\n   sql only   {lost}", len(rows), took
    return ("ok" if rows else "ok: EMPTY"), len(rows), took


def main():
    from proofline.plans import load_catalog
    from proofline.session import build_session

    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    prefixes = tuple(sys.argv[2:])
    catalog = load_catalog()
    spark = build_session("local[8]", 8)
    spark.sparkContext.setLogLevel("ERROR")
    connection = duck(sf_dir)
    bad = 0
    for name, fn in catalog.QUERIES.items():
        if prefixes and not name.startswith(prefixes):
            continue
        try:
            status, count, took = compare(spark, connection, sf_dir, name, fn, catalog.EQUIVALENT_SQL.get(name))
        except Exception as error:  # noqa: BLE001 - one broken query must not hide the others
            status, count, took = f"ERROR {type(error).__name__}: {str(error)[:900]}", 0, 0.0
        bad += status not in ("ok", "rows")
        print(f"{name:34s} {count:8d} rows {took:7.2f}s  {status}", flush=True)
    print(f"{bad} problem(s)")


if __name__ == "__main__":
    main()
