"""Account lockout over a stream of login attempts.

Attempts wait in keyed state until the watermark has passed them and are then
applied in time order, so the result is that of the batch operator on the same
attempts, in whatever order they arrive within the allowed delay. Unlocks come
in the same stream and take effect in the same order; a stream may start from
stored accounts.

State is kept by group of accounts, packed: a batch costs a call for each group
it touches, not for each account. A group's accounts are written again when one
of them changes.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tillbook.functions.times import micros, wall_clock

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

OUTPUT = (
    "user_id bigint, is_locked_out boolean, last_lockout_us bigint, password_count int, password_start_us bigint, "
    "answer_count int, answer_start_us bigint, applied bigint"
)
# Groups that accounts are dealt to. It is part of a stream's state and must stay as it is.
GROUPS = 1024
# Packed rows of a group's attempts and of its accounts; no time is NONE.
PENDING = np.dtype([("user_id", "i8"), ("us", "i8"), ("event_id", "i8"), ("kind", "i1"), ("ok", "?")])
ACCOUNT = np.dtype([
    ("user_id", "i8"), ("locked", "?"), ("locked_us", "i8"), ("password_count", "i4"), ("password_start", "i8"),
    ("answer_count", "i4"), ("answer_start", "i8"), ("applied", "i8"),
])
NONE = int(np.iinfo("i8").min)
ANSWER_KIND, PASSWORD_KIND, UNLOCK_KIND = 0, 1, 2
UNLOCK = "unlock"
# The stored columns of an account, in the stream and in the batch operator's result.
ACCOUNT_COLUMNS = ("is_locked_out", "last_lockout_us", "password_count", "password_start_us", "answer_count", "answer_start_us")
BATCH_COLUMNS = (
    "is_locked_out", "last_lockout", "password_count", "password_window_start", "answer_count", "answer_window_start",
)
TIMES = ("last_lockout", "password_window_start", "answer_window_start")
FRESH = (False, None, 0, None, 0, None, 0)

# Ship the processor itself, so that workers need not have this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def apply_attempt(state: tuple, us: int, ok: bool, is_password: bool, limit: int, window_us: int) -> tuple:
    """The account after one attempt."""
    locked, locked_us, password, password_start, answer, answer_start, applied = state
    if locked:
        return state
    if ok:
        return (*FRESH[:6], applied + 1)
    count, start = (password, password_start) if is_password else (answer, answer_start)
    if count == 0 or us > start + window_us:
        count, start = 1, us
    else:
        locked, count = count >= limit, count + 1
    if is_password:
        password, password_start = count, start
    else:
        answer, answer_start = count, start
    return locked, us if locked else None, password, password_start, answer, answer_start, applied + 1


def unlocked(state: tuple) -> tuple:
    """The account after an unlock: both counters and windows are cleared, the time of the lock stays."""
    return (False, state[1], 0, None, 0, None, state[6] + 1)


def _account(row: tuple) -> tuple:
    """The state in a packed row."""
    return tuple(None if value == NONE else value for value in row[1:])


def _packed(accounts: dict[int, tuple]) -> bytes:
    rows = [(user, *(NONE if value is None else value for value in state)) for user, state in accounts.items()]
    return np.array(rows, ACCOUNT).tobytes()


class LockoutProcessor(StatefulProcessor):
    def __init__(self, limit: int, window_minutes: int, unlocks: bool = False):
        self.limit = limit
        self.window_us = window_minutes * 60_000_000
        self.unlocks = unlocks

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.pending = handle.getListState("pending", "rows binary")
        self.accounts = handle.getValueState("accounts", "rows binary")

    def _accounts(self) -> np.ndarray:
        return np.frombuffer(self.accounts.get()[0] if self.accounts.exists() else b"", ACCOUNT)

    def _wake(self, rows: np.ndarray) -> None:
        """For the earliest of the rows. A timer fires once the watermark has passed it: round up."""
        self.handle.registerTimer(int(rows["us"].min()) // 1000 + 1)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        # Without unlocks a locked account ignores whatever comes later, so nothing is kept for it.
        closed = None
        if not self.unlocks:
            accounts = self._accounts()
            closed = accounts["user_id"][accounts["locked"]]
        for batch in rows:
            packed = np.empty(len(batch), PENDING)
            for name in PENDING.names:
                packed[name] = batch[name].to_numpy()
            if closed is not None and len(closed):
                packed = packed[~np.isin(packed["user_id"], closed)]
            if len(packed):
                self.pending.appendValue((packed.tobytes(),))
                self._wake(packed)
        return iter(())

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        # Stored accounts may come in several parts.
        accounts = {row[0]: _account(row) for row in self._accounts().tolist()}
        stored = initialState.astype(object).where(initialState.notna(), None)
        for user, locked, *numbers in stored[["user_id", *ACCOUNT_COLUMNS]].itertuples(index=False, name=None):
            accounts[int(user)] = (bool(locked), *(None if n is None else int(n) for n in numbers), 0)
        if accounts:
            self.accounts.update((_packed(accounts),))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        waiting = np.frombuffer(b"".join(rows for rows, in self.pending.get()) if self.pending.exists() else b"", PENDING)
        due = waiting["us"] <= passed
        if not due.any():
            return
        ready, later = waiting[due], waiting[~due]
        if len(later):
            self.pending.put([(later.tobytes(),)])
            self._wake(later)
        else:
            self.pending.clear()
        unlock = ready["kind"] == UNLOCK_KIND
        # Of one time and number: failures, successes, unlocks.
        ready = ready[np.lexsort((ready["kind"], ready["ok"], unlock, ready["event_id"], ready["us"], ready["user_id"]))]
        accounts = {row[0]: _account(row) for row in self._accounts().tolist()}
        before = {user: accounts.get(user) for user in np.unique(ready["user_id"]).tolist()}
        for user, us, _, kind, ok in ready.tolist():
            if kind != UNLOCK_KIND:
                state = accounts.get(user, FRESH)
                accounts[user] = apply_attempt(state, us, ok, kind == PASSWORD_KIND, self.limit, self.window_us)
            elif user in accounts:  # an unlock makes no account
                accounts[user] = unlocked(accounts[user])
        # A locked account that saw attempts only is as it was.
        changed = [(user, *accounts[user]) for user, state in before.items() if user in accounts and accounts[user] != state]
        if changed:
            self.accounts.update((_packed(accounts),))
            yield pd.DataFrame(changed, columns=[c.split()[0] for c in OUTPUT.split(", ")], dtype=object)

    def close(self) -> None:
        pass


def lockout_updates(
    attempts: DataFrame,
    max_failures: int,
    window_minutes: int,
    delay: str,
    accounts: DataFrame | None = None,
    unlocks: bool = False,
) -> DataFrame:
    """Stream of account states, one row per account whenever it changes.

    ``attempts`` streams user_id, event_id, ts, ok and counter. A row without
    user_id is no attempt, but its time moves the watermark on.

    With ``unlocks`` a row whose counter is ``unlock`` unlocks its account at its
    place in the order (ts, event_id); an account without a state is not made
    by it. What a locked account keeps is then bounded by ``delay``: attempts
    wait for an unlock that may still arrive before them.

    ``accounts`` is a stored result of the batch operator (one row per user_id)
    from which a new stream starts; a restarted one goes on from its own state.
    """
    spark = attempts.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    counter = F.col("counter")
    kind = F.when(counter == "password", PASSWORD_KIND).when(counter == "passwordAnswer", ANSWER_KIND)
    if unlocks:
        kind = kind.when(counter == UNLOCK, UNLOCK_KIND)
    kind = kind.otherwise(F.raise_error(F.lit("unknown failure counter")).cast("int"))
    place = F.pmod(F.xxhash64(F.col("user_id").cast("bigint")), F.lit(GROUPS)).cast("int").alias("place")
    events = attempts.select(
        place, F.col("user_id").cast("bigint").alias("user_id"), micros("ts").alias("us"),
        # As in a sort, no number comes first.
        F.coalesce(F.col("event_id").cast("bigint"), F.lit(NONE)).alias("event_id"),
        kind.alias("kind"), F.coalesce("ok", F.lit(False)).alias("ok"),
    )
    initial = None
    if accounts is not None:
        values = [
            micros(c) if c in TIMES else F.col(c).cast("int" if c.endswith("count") else "boolean")
            for c in BATCH_COLUMNS
        ]
        named = [v.alias(c) for v, c in zip(values, ACCOUNT_COLUMNS)]
        initial = accounts.where(F.col("user_id").isNotNull()).select(place, "user_id", *named).groupBy("place")
    return (
        events.withColumn("event_time", F.timestamp_micros("us"))
        .withWatermark("event_time", delay)
        # Naming the time keeps this test behind the watermark, where rows without an account have counted.
        .where(F.when(F.col("event_time").isNotNull(), F.col("user_id")).isNotNull())
        .groupBy("place")
        .transformWithStateInPandas(
            statefulProcessor=LockoutProcessor(max_failures, window_minutes, unlocks),
            outputStructType=OUTPUT,
            outputMode="Append",
            timeMode="EventTime",
            initialState=initial,
        )
    )


def current_state(updates: DataFrame, accounts: DataFrame | None = None) -> DataFrame:
    """The last state written for each account, in the batch operator's shape.

    ``accounts`` are those the stream started from; the unchanged ones follow as they were.
    """
    rest = [c for c in updates.columns if c != "user_id"]
    last = updates.groupBy("user_id").agg(F.max_by(F.struct(*rest), "applied").alias("s"))
    flat = last.select("user_id", "s.*")
    found = flat.select(
        "user_id",
        *[(wall_clock(F.col(c)) if b in TIMES else F.col(c)).alias(b) for c, b in zip(ACCOUNT_COLUMNS, BATCH_COLUMNS)],
    )
    if accounts is None:
        return found
    same = accounts.join(found.select("user_id"), "user_id", "left_anti")
    return found.unionByName(same.select(*found.columns))
