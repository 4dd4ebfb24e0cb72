"""Sign-in as one job, against one attempt at a time."""

import datetime as dt

from pyspark.sql import functions as F

from tillbook.functions.credentials import salted_digest
from tillbook.operators import sign_in

START = dt.datetime(2024, 1, 1)


def accounts(spark):
    rows = [(1, "ann", True, False, START), (2, "bob", False, None, START), (3, "cid", None, True, START), (4, "dee", True, None, None)]
    users = spark.createDataFrame(rows, "UserId bigint, LoweredUsername string, IsApproved boolean, IsLockedOut boolean, LastLoginDate timestamp_ntz")
    salt = F.base64(F.encode("LoweredUsername", "UTF-8"))
    return users.select(
        "*", F.lit(0).alias("ApplicationId"), salt.alias("PasswordSalt"), salted_digest(F.lit("Right-1"), salt).alias("Password"),
        salted_digest(F.lit("blue"), salt).alias("PasswordAnswer"),
    )


def test_outcomes_states_and_dates(spark):
    tries = [
        ("Ann", "Right-1", "password"), ("ANN", "wrong", "password"), ("ann", "BLUE", "passwordAnswer"), ("bob", "Right-1", "password"),
        ("cid", "Right-1", "password"), ("nobody", "x", "password"), ("dee", "no", "password"), ("dee", "no", "password"),
        ("dee", None, "password"), ("dee", "Right-1", "password"), ("ann", "right-1", "password"),
    ]
    rows = [(i, START + dt.timedelta(minutes=i), 0, n, s, c) for i, (n, s, c) in enumerate(tries)]
    frame = spark.createDataFrame(rows, "event_id bigint, ts timestamp_ntz, ApplicationId int, Username string, Secret string, counter string")
    users = accounts(spark)
    outcomes, state = sign_in.validated_logins(frame, users, max_failures=2, window_minutes=60)
    assert "Secret" not in outcomes.columns
    assert [r.outcome for r in outcomes.orderBy("event_id").collect()] == [
        "valid", "wrong_secret", "valid", "not_approved", "locked_out", "unknown_user", "wrong_secret", "wrong_secret",
        "wrong_secret", "locked_out", "wrong_secret",
    ]
    assert {r.user_id: (r.is_locked_out, r.password_count) for r in state.collect()} == {1: (False, 1), 4: (True, 3)}
    dates = {r.UserId: r.LastLoginDate for r in sign_in.after_logins(users, outcomes).collect()}
    assert dates == {1: START + dt.timedelta(minutes=2), 2: START, 3: START, 4: None}


def test_a_stored_lock_turns_the_next_batch_away(spark):
    schema = "event_id bigint, ts timestamp_ntz, ApplicationId int, Username string, Secret string, counter string"
    bad = [(i, START + dt.timedelta(minutes=i), 0, "dee", "no", "password") for i in range(3)]
    _, state = sign_in.validated_logins(spark.createDataFrame(bad, schema), accounts(spark), 2, 60)
    later = spark.createDataFrame([(9, START + dt.timedelta(days=1), 0, "dee", "Right-1", "password")], schema)
    outcomes, _ = sign_in.validated_logins(later, accounts(spark), 2, 60, accounts=state)
    assert outcomes.first().outcome == "locked_out"


def test_attempts_at_one_time_go_in_the_order_of_their_numbers(spark):
    """The third failure locks; the right secret at the same time comes too late and leaves no date."""
    schema = "event_id bigint, ts timestamp_ntz, ApplicationId int, Username string, Secret string, counter string"
    tries = [(i, START, 0, "dee", "no", "password") for i in range(1, 5)] + [(5, START, 0, "dee", "Right-1", "password")]
    users = accounts(spark)
    outcomes, state = sign_in.validated_logins(spark.createDataFrame(tries[::-1], schema), users, max_failures=2, window_minutes=60)
    assert [r.outcome for r in outcomes.orderBy("event_id").collect()] == ["wrong_secret"] * 3 + ["locked_out"] * 2
    assert state.columns == ["user_id", "is_locked_out", "last_lockout", "password_count", "password_window_start", "answer_count", "answer_window_start"]
    assert {r.UserId: r.LastLoginDate for r in sign_in.after_logins(users, outcomes).collect()}[4] is None
