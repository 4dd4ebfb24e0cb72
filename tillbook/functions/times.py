"""Zone-free times as instants, for watermarks, and back.

Both directions read the wall-clock time as UTC, whatever the session's zone.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EPOCH = "TIMESTAMP_NTZ'1970-01-01 00:00:00'"


def micros(ts: str) -> Column:
    """Microseconds of a zone-free timestamp column."""
    return F.expr(f"timestampdiff(MICROSECOND, {EPOCH}, CAST({ts} AS TIMESTAMP_NTZ))")


def instant(ts: str) -> Column:
    return F.timestamp_micros(micros(ts))


def wall_clock(us: Column) -> Column:
    """Zone-free timestamp of microseconds."""
    seconds = (us.cast("decimal(20,0)") / F.lit(1_000_000).cast("decimal(20,0)")).cast("decimal(18,6)")
    return F.expr(EPOCH) + F.make_dt_interval(secs=seconds)
