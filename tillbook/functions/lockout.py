"""The failure-lockout rules as column expressions.

Two counters per account, each with a window anchored at its first failure:

* a locked account ignores every event;
* a success resets both counters;
* a failure with a zero counter, or strictly after window start + window,
  starts a new window with count 1;
* any other failure adds one, and locks the account when the counter already
  stood at the limit. The counter that failed keeps the final count.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

COUNTERS = ("password", "passwordAnswer")

STATE = (
    "struct<locked:boolean,locked_at:timestamp_ntz,password_count:int,password_start:timestamp_ntz,"
    "answer_count:int,answer_start:timestamp_ntz,locked_by:bigint>"
)
WINDOW = "struct<locks:boolean,count:int,start:timestamp_ntz>"


def clean_state() -> Column:
    none = F.lit(None).cast("timestamp_ntz")
    return F.struct(
        F.lit(False).alias("locked"), none.alias("locked_at"),
        F.lit(0).alias("password_count"), none.alias("password_start"),
        F.lit(0).alias("answer_count"), none.alias("answer_start"), F.lit(None).alias("locked_by"),
    ).cast(STATE)


def clean_window() -> Column:
    return F.struct(
        F.lit(False).alias("locks"), F.lit(0).alias("count"), F.lit(None).cast("timestamp_ntz").alias("start")
    ).cast(WINDOW)


def checked_counter(counter: Column) -> Column:
    """The counter name; any other name fails the job."""
    return F.when(counter.isin(*COUNTERS), counter).otherwise(
        F.raise_error(F.concat(F.lit("unknown failure counter: "), F.coalesce(counter, F.lit("NULL")))).cast("string")
    )


def _failure(count: Column, start: Column, ts: Column, limit: int, window: Column) -> tuple[Column, Column, Column]:
    """(locks, count, start) of one counter after a failure."""
    fresh = (count == 0) | (ts > start + window)
    return (
        ~fresh & (count >= limit),
        F.when(fresh, 1).otherwise(count + 1),
        F.when(fresh, ts).otherwise(start),
    )


def fold(state: Column, events: Column, limit: int, window: Column) -> Column:
    """State after events (ts, event_id, ok, is_password), already in order; ``locked_by`` is the event that locked."""

    def step(s: Column, e: Column) -> Column:
        mine = e["is_password"]
        locks, count, start = _failure(
            F.when(mine, s["password_count"]).otherwise(s["answer_count"]),
            F.when(mine, s["password_start"]).otherwise(s["answer_start"]),
            e["ts"], limit, window,
        )
        failed = F.struct(
            locks.alias("locked"),
            F.when(locks, e["ts"]).alias("locked_at"),
            F.when(mine, count).otherwise(s["password_count"]).alias("password_count"),
            F.when(mine, start).otherwise(s["password_start"]).alias("password_start"),
            F.when(mine, s["answer_count"]).otherwise(count).alias("answer_count"),
            F.when(mine, s["answer_start"]).otherwise(start).alias("answer_start"),
            F.when(locks, e["event_id"]).alias("locked_by"),
        ).cast(STATE)
        return F.when(s["locked"], s).when(e["ok"], clean_state()).otherwise(failed)

    return F.aggregate(events, state, step)


def fold_failures(state: Column, times: Column, limit: int, window: Column) -> Column:
    """One counter's window after failures at ``times``; stops at a lock."""

    def step(s: Column, ts: Column) -> Column:
        locks, count, start = _failure(s["count"], s["start"], ts, limit, window)
        return F.when(s["locks"], s).otherwise(
            F.struct(locks.alias("locks"), count.alias("count"), start.alias("start")).cast(WINDOW)
        )

    return F.aggregate(times, state, step)


def window_outcomes(times: Column, first: Column, limit: int, window: Column) -> Column:
    """What a block's failures of one counter do to any window carried in.

    A carried window started no later than ``first``, the block's first event,
    so it can absorb only failures up to first + window, and fewer than
    ``limit`` of them or it locks. The failures in its reach and the one after
    them, each with the outcome of starting anew there, tell everything:
    (ts, end) per candidate start.
    """
    n = F.size(times)
    reach = F.size(F.filter(F.slice(times, 1, limit + 1), lambda ts: ts <= first + window))
    candidates = F.least(n, reach + 1)
    return F.when(
        n > 0,
        F.transform(
            F.sequence(F.lit(1), candidates),
            lambda j: F.struct(
                F.get(times, j - 1).alias("ts"),
                fold_failures(clean_window(), F.slice(times, j, n), limit, window).alias("end"),
            ),
        ),
    ).otherwise(F.array().cast(f"array<struct<ts:timestamp_ntz,end:{WINDOW}>>"))


def carry(
    count: Column, start: Column, failures: Column, outcomes: Column, limit: int, window: Column
) -> Column:
    """Window after a block, from the carried one and the block's outcomes.

    ``failures`` is how many the block holds of this counter.
    """
    kept = F.struct(F.lit(False).alias("locks"), count.alias("count"), start.alias("start")).cast(WINDOW)
    inside = F.size(F.filter(outcomes, lambda o: o["ts"] <= start + window))
    locked = F.struct(F.lit(True).alias("locks"), count.alias("count"), start.alias("start")).cast(WINDOW)
    absorbed = F.struct(
        F.lit(False).alias("locks"), (count + inside).alias("count"), start.alias("start")
    ).cast(WINDOW)
    return (
        F.when(failures == 0, kept)
        .when(count == 0, F.get(outcomes, F.lit(0))["end"])
        .when(count + inside > limit, locked)
        .when(inside == failures, absorbed)
        .otherwise(F.get(outcomes, inside)["end"])
    )
