"""The lockout rules: by hand, against a plain walk, and across blocks."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tillbook.functions import lockout as rules
from tillbook.operators import lockout
from tillbook.streaming import lockout as stream_lockout
from tillbook.streaming import sinks
from tillbook.session import work_path, written

START = dt.datetime(2024, 1, 1)
SCHEMA = "user_id bigint, event_id bigint, ts timestamp_ntz, ok boolean, counter string"
MINUTES = 10


def attempts(spark, rows):
    """Rows of (user, minute, ok, counter)."""
    data = [(u, i, START + dt.timedelta(minutes=m), ok, c) for i, (u, m, ok, c) in enumerate(rows)]
    return spark.createDataFrame(data, SCHEMA)


def walk(rows, limit, minutes):
    """The rules applied one attempt at a time."""
    state = {}
    window = dt.timedelta(minutes=minutes)
    for user, event_id, ts, ok, counter in sorted(rows, key=lambda r: (r[2], r[1])):
        s = state.setdefault(user, {"locked": None, "password": (0, None), "passwordAnswer": (0, None)})
        if s["locked"]:
            continue
        if ok:
            s["password"] = s["passwordAnswer"] = (0, None)
            continue
        count, start = s[counter]
        if count == 0 or ts > start + window:
            s[counter] = (1, ts)
        else:
            s[counter] = (count + 1, start)
            if count >= limit:
                s["locked"] = ts
    return {
        u: (s["locked"] is not None, s["locked"], *s["password"], *s["passwordAnswer"]) for u, s in state.items()
    }


def results(frame):
    return {r[0]: tuple(r[1:]) for r in frame.collect()}


def test_locks_on_the_failure_after_the_limit(spark):
    rows = [(1, m, False, "password") for m in range(4)]
    got = results(lockout.lockout_state(attempts(spark, rows), 3, MINUTES))[1]
    assert got == (True, START + dt.timedelta(minutes=3), 4, START, 0, None)


def test_window_is_anchored_and_its_end_inclusive(spark):
    rows = [(1, 0, False, "password"), (1, 10, False, "password"), (2, 0, False, "password"), (2, 11, False, "password")]
    got = results(lockout.lockout_state(attempts(spark, rows), 3, MINUTES))
    assert got[1][2:4] == (2, START)
    assert got[2][2:4] == (1, START + dt.timedelta(minutes=11))


def test_success_resets_both_and_a_lock_ignores_everything(spark):
    rows = [(1, 0, False, "password"), (1, 1, False, "passwordAnswer"), (1, 2, True, "password")]
    rows += [(2, m, False, "password") for m in range(4)] + [(2, 5, True, "password"), (2, 6, False, "password")]
    got = results(lockout.lockout_state(attempts(spark, rows), 3, MINUTES))
    assert got[1] == (False, None, 0, None, 0, None)
    assert got[2] == (True, START + dt.timedelta(minutes=3), 4, START, 0, None)


def test_an_answer_lock_keeps_the_answer_counter(spark):
    """The counter that failed holds the final count, not the password counter."""
    rows = [(1, m, False, "passwordAnswer") for m in range(4)]
    got = results(lockout.lockout_state(attempts(spark, rows), 3, MINUTES))[1]
    assert got == (True, START + dt.timedelta(minutes=3), 0, None, 4, START)


def test_default_limits(spark):
    rows = [(1, m / 10, False, "password") for m in range(50)]
    rows += [(2, m / 10, False, "password") for m in range(51)]
    got = results(lockout.lockout_state(attempts(spark, rows)))
    assert (got[1][0], got[1][2]) == (False, 50)
    assert (got[2][0], got[2][2]) == (True, 51)


def test_unknown_counter_is_an_error(spark):
    with pytest.raises(Exception, match="unknown failure counter"):
        lockout.lockout_state(attempts(spark, [(1, 0, False, "pin")]), 3, MINUTES).collect()


def random_rows(seed, users, events, span, success):
    rng = random.Random(seed)
    rows = []
    for i in range(events):
        # User 0 makes about half of all attempts.
        user = 0 if rng.random() < 0.5 else rng.randrange(users)
        rows.append(
            (user, i, START + dt.timedelta(minutes=rng.randrange(span)), rng.random() < success, rng.choice(rules.COUNTERS))
        )
    return rows


@pytest.mark.parametrize("seed", range(8))
def test_agrees_with_a_plain_walk_across_blocks(spark, seed):
    """The hot account spans most blocks, with rare and frequent successes."""
    rng = random.Random(seed)
    limit, minutes = rng.choice([1, 2, 3, 6]), rng.choice([3, 10, 60])
    rows = random_rows(seed, 6, 400, rng.choice([300, 3000, 30000]), rng.choice([0.0, 0.02, 0.2]))
    frame = spark.createDataFrame(rows, SCHEMA)
    spans = lockout._runs(frame, 8).groupBy("user_id").count().agg(F.max("count")).first()[0]
    assert spans > 2
    assert results(lockout.lockout_state(frame, limit, minutes, blocks=8)) == walk(rows, limit, minutes)


def test_stream_agrees_with_batch_when_attempts_arrive_in_any_order(spark):
    rows = random_rows(99, 12, 600, 6000, 0.15)
    random.Random(7).shuffle(rows)
    path, out, state = work_path(spark, "in"), work_path(spark, "out"), work_path(spark, "state")
    clock = [(-1, -1, START + dt.timedelta(days=30), True, "password")]
    # Two runs of the same stream: state carries over from the first.
    for part in (rows[:300], rows[300:] + clock):
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(path)
        stream = spark.readStream.schema(SCHEMA).parquet(path)
        updates = stream_lockout.lockout_updates(stream, 3, 60, "10 days")
        sinks.write_appends(updates, out, state).awaitTermination()
    got = results(stream_lockout.current_state(spark.read.parquet(out)).where("user_id >= 0"))
    assert got == walk(rows, 3, 60)
    assert got == results(lockout.lockout_state(spark.createDataFrame(rows, SCHEMA), 3, 60))


def test_stream_keeps_nothing_for_a_locked_account_and_drops_late_attempts(spark):
    path, out, state = work_path(spark, "in"), work_path(spark, "out"), work_path(spark, "state")

    def at(minute):
        return START + dt.timedelta(minutes=minute)

    first = [(1, i, at(i), False, "password") for i in range(4)] + [(2, 10, at(1), False, "password")]
    first.append((-1, -1, at(10_000), True, "password"))
    second = [(1, 20 + i, at(10_010 + i), i % 2 == 0, "password") for i in range(6)]
    second += [(2, 30, at(10_010), False, "password"), (3, 40, at(5), False, "password")]
    second.append((-1, -2, at(20_000), True, "password"))
    for part in (first, second):
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(path)
        stream = spark.readStream.schema(SCHEMA).parquet(path)
        query = sinks.write_appends(stream_lockout.lockout_updates(stream, 3, 60, "1 minute"), out, state)
        query.awaitTermination()
    got = results(stream_lockout.current_state(spark.read.parquet(out)).where("user_id >= 0"))
    assert got[1] == (True, at(3), 4, at(0), 0, None)
    assert got[2] == (False, None, 1, at(10_010), 0, None)
    # Account 3 made its only attempt long before the watermark.
    assert 3 not in got
    # The locked account was written once and not touched again.
    assert spark.read.parquet(out).where("user_id = 1").count() == 1


@pytest.mark.parametrize("seed", range(3))
def test_a_stored_state_and_later_attempts_equal_the_whole_history(spark, seed):
    """Locked accounts stay, untouched ones are kept, and a hot account spans blocks in both halves."""
    rng = random.Random(seed)
    users = [1] * 300 + [rng.randrange(2, 30) for _ in range(200)]
    rows = [(u, rng.randrange(400), rng.random() < 0.1, rng.choice(["password", "passwordAnswer"])) for u in users]
    frame = attempts(spark, rows)
    cut = F.lit(START + dt.timedelta(minutes=200)).cast("timestamp_ntz")
    first = lockout.lockout_state(frame.where(F.col("ts") < cut), 3, MINUTES, blocks=6)
    both = lockout.lockout_state(frame.where(F.col("ts") >= cut), 3, MINUTES, blocks=6, accounts=first)
    assert results(both) == results(lockout.lockout_state(frame, 3, MINUTES))


def walk_with_unlocks(rows, limit, minutes, stored=()):
    """One event at a time, from stored states."""
    states = {user: stream_lockout.FRESH if s is None else s for user, s in dict(stored).items()}
    for user, event, ts, ok, counter in sorted(rows, key=lambda r: (r[2], r[1])):
        us = (ts - dt.datetime(1970, 1, 1)) // dt.timedelta(microseconds=1)
        if counter == "unlock":
            if user in states:
                states[user] = stream_lockout.unlocked(states[user])
        else:
            before = states.get(user, stream_lockout.FRESH)
            states[user] = stream_lockout.apply_attempt(before, us, ok, counter == "password", limit, minutes * 60_000_000)
    moment = lambda us: None if us is None else dt.datetime(1970, 1, 1) + dt.timedelta(microseconds=us)
    return {u: (s[0], moment(s[1]), s[2], moment(s[3]), s[4], moment(s[5])) for u, s in states.items()}


def with_unlocks(seed, users, n, span, success):
    """Attempts and unlocks, several at one time, of accounts without attempts too."""
    rng = random.Random(seed)
    rows = random_rows(seed, users, n, span, success)
    return rows + [
        (rng.randrange(users + 3), n + i, START + dt.timedelta(minutes=rng.randrange(span)), None, "unlock") for i in range(n // 10)
    ]


@pytest.mark.parametrize("seed", range(4))
def test_unlocks_take_effect_in_order(spark, seed):
    rng = random.Random(seed)
    limit, span = rng.choice([1, 2, 4]), rng.choice([40, 400, 4000])
    rows = with_unlocks(seed, 8, 300, span, rng.choice([0.0, 0.1]))
    frame = spark.createDataFrame(rows, SCHEMA)
    tried, asked = frame.where("counter <> 'unlock'"), frame.where("counter = 'unlock'")
    got = lockout.lockout_with_unlocks(tried, asked, limit, 30, blocks=4)
    assert results(got) == walk_with_unlocks(rows, limit, 30)
    # The same from a stored first half.
    cut = START + dt.timedelta(minutes=span // 2)
    stored = lockout.lockout_with_unlocks(tried.where(F.col("ts") < cut), asked.where(F.col("ts") < cut), limit, 30)
    got = lockout.lockout_with_unlocks(tried.where(F.col("ts") >= cut), asked.where(F.col("ts") >= cut), limit, 30, accounts=stored)
    assert results(got) == walk_with_unlocks(rows, limit, 30)


def test_unlocks_of_empty_tables(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert lockout.lockout_with_unlocks(none, none).count() == 0
    asked = spark.createDataFrame([(1, 1, START, None, "unlock"), (None, 2, START, None, "unlock")], SCHEMA)
    assert lockout.lockout_with_unlocks(none, asked).count() == 0


def test_a_stream_from_stored_accounts_with_unlocks_equals_the_batch(spark):
    rows = with_unlocks(5, 12, 600, 6000, 0.05)
    frame = spark.createDataFrame(rows, SCHEMA)
    cut = START + dt.timedelta(minutes=3000)
    early = frame.where(F.col("ts") < cut)
    stored = lockout.lockout_with_unlocks(early.where("counter <> 'unlock'"), early.where("counter = 'unlock'"), 3, 60)
    # An account that the stream never names stays as it was stored.
    quiet = spark.createDataFrame([(77, 0, START + dt.timedelta(minutes=i), False, "password") for i in range(5)], SCHEMA)
    stored = written(stored.unionByName(lockout.lockout_state(quiet, 3, 60)), "accounts")
    path, out, state = work_path(spark, "in"), work_path(spark, "out"), work_path(spark, "state")
    later = [r for r in rows if r[2] >= cut]
    random.Random(3).shuffle(later)
    clock = [(-1, -1, START + dt.timedelta(days=30), True, "password")]
    # The second run restarts from the stream's own state, the stored accounts are taken once.
    for part in (later[:150], later[150:] + clock):
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(path)
        stream = spark.readStream.schema(SCHEMA).parquet(path)
        updates = stream_lockout.lockout_updates(stream, 3, 60, "10 days", accounts=stored, unlocks=True)
        sinks.write_appends(updates, out, state).awaitTermination()
    got = results(stream_lockout.current_state(spark.read.parquet(out), stored).where("user_id >= 0"))
    want = walk_with_unlocks(rows, 3, 60)
    want[77] = (True, START + dt.timedelta(minutes=3), 4, START, 0, None)
    assert got == want
    assert any(s[0] for s in want.values())


def test_stream_state_is_kept_by_group_not_by_account(spark, monkeypatch):
    """A call for each of a few groups; accounts, unlocks and ties in one group stay apart."""
    monkeypatch.setattr(stream_lockout, "GROUPS", 4, raising=False)
    rows = with_unlocks(11, 900, 4000, 6000, 0.05)
    # Of one time and number: a failure, a success, then an unlock.
    tie = START + dt.timedelta(minutes=1)
    rows += [(5000, -5, tie, None, "unlock"), (5000, -5, tie, True, "password"), (5000, -5, tie, False, "passwordAnswer")]
    rows += [(5001, -5, tie, True, "password"), (5001, -5, tie, False, "password"), (5002, -5, tie, None, "unlock")]
    path, out, state = work_path(spark, "in"), work_path(spark, "out"), work_path(spark, "state")
    clock = [(None, -1, START + dt.timedelta(days=30), True, "password")]
    for part in (rows[:2500], rows[2500:] + clock):
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(path)
        updates = stream_lockout.lockout_updates(spark.readStream.schema(SCHEMA).parquet(path), 3, 60, "10 days", unlocks=True)
        query = sinks.write_appends(updates, out, state)
        query.awaitTermination()
        assert all(p.stateOperators[0].numRowsTotal < 100 for p in query.recentProgress)
    got = results(stream_lockout.current_state(spark.read.parquet(out)))
    plain = sorted(rows, key=lambda r: (r[2], r[1], r[4] == "unlock", bool(r[3]), r[4] == "password"))
    assert got == walk_with_unlocks(plain, 3, 60)
    assert got[5000][:3] == (False, None, 0) and got[5001][2] == 0 and 5002 not in got
