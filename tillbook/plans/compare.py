"""Compare a registered query with its SQL counterpart on one data folder."""

from __future__ import annotations

import datetime as dt
import decimal
from collections import Counter

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()


def sql_rows(sql: str, sf_dir: str):
    import duckdb

    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    cursor = connection.execute(sql)
    columns = [d[0] for d in cursor.description]
    return columns, cursor.fetchall()


def plain(value):
    if isinstance(value, bool) or value is None:
        return value
    if isinstance(value, (float, decimal.Decimal)):
        return f"{float(value):.9g}"
    if isinstance(value, int):
        return f"{float(value):.9g}" if abs(value) < 1e9 else str(value)
    if isinstance(value, dt.datetime):
        return value.replace(tzinfo=None).isoformat()
    if isinstance(value, (bytes, bytearray)):
        return bytes(value).hex()
    if isinstance(value, (list, tuple)):
        return [plain(v) for v in value]
    return str(value)


def bag(columns, rows) -> Counter:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(repr([plain(row[i]) for i in order]) for row in rows)


def compare(frame, sql: str, sf_dir: str) -> str | None:
    """None when both give the same rows, else what differs."""
    columns, expected = sql_rows(sql, sf_dir)
    actual = [tuple(r) for r in frame.collect()]
    if sorted(frame.columns) != sorted(columns):
        return f"columns {sorted(frame.columns)} != {sorted(columns)}"
    left, right = bag(frame.columns, actual), bag(columns, expected)
    if left == right:
        return None
    only_left, only_right = list((left - right).items())[:3], list((right - left).items())[:3]
    return f"rows {len(actual)} vs {len(expected)}; only spark {only_left}; only sql {only_right}"
