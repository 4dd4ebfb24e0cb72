"""Sign-in attempts checked as one job: account, flags, secret, lockout, dates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillbook.functions.credentials import salted_digest
from tillbook.operators.lockout import lockout_state
from tillbook.session import written


def checked_secrets(attempts: DataFrame, users: DataFrame, algorithm: str = "sha256") -> DataFrame:
    """Add UserId and ``outcome`` by the stored account alone.

    Attempts carry ApplicationId, Username, Secret and counter, which says
    whether the secret is the password or the answer; the secret is not
    returned. Users carry both as salted digests, IsApproved and IsLockedOut; a
    NULL flag is approved and not locked.
    """
    account = users.select(
        "ApplicationId", "LoweredUsername", "UserId", "PasswordSalt", F.col("Password").alias("_password"),
        F.col("PasswordAnswer").alias("_answer"), F.coalesce("IsApproved", F.lit(True)).alias("_approved"),
        F.coalesce("IsLockedOut", F.lit(False)).alias("_locked"),
    )
    is_password = F.col("counter") == "password"
    given = F.when(is_password, F.col("Secret")).otherwise(F.lower("Secret"))
    stored = F.when(is_password, F.col("_password")).otherwise(F.col("_answer"))
    right = F.coalesce(salted_digest(given, F.col("PasswordSalt"), algorithm) == stored, F.lit(False))
    outcome = (
        F.when(F.col("UserId").isNull(), "unknown_user")
        .when(F.col("_locked"), "locked_out")
        .when(~F.col("_approved"), "not_approved")
        .when(right, "valid")
        .otherwise("wrong_secret")
    )
    return (
        attempts.withColumn("LoweredUsername", F.lower("Username"))
        .join(account, ["ApplicationId", "LoweredUsername"], "left")
        .withColumn("outcome", outcome)
        .drop("LoweredUsername", "PasswordSalt", "Secret", "_password", "_answer", "_approved", "_locked")
    )


def validated_logins(
    attempts: DataFrame, users: DataFrame, max_failures: int = 50, window_minutes: int = 10, accounts: DataFrame | None = None
) -> tuple[DataFrame, DataFrame]:
    """(attempts with their outcome, lockout state after them).

    Only attempts that came as far as the secret count towards a lock; an
    account locked by this batch turns away its later attempts. ``accounts`` is
    the lockout state before the batch.
    """
    checked = written(checked_secrets(attempts, users), "checked")
    counted = checked.where(F.col("outcome").isin("valid", "wrong_secret"))
    tried = counted.select(F.col("UserId").alias("user_id"), "event_id", "ts", (F.col("outcome") == "valid").alias("ok"), "counter")
    state = written(lockout_state(tried, max_failures, window_minutes, accounts=accounts, with_event=True), "states")
    locked = state.where("is_locked_out").select(F.col("user_id").alias("UserId"), "last_lockout", "locked_by")
    # Attempts go in the order of time, then event_id, as in the fold; a lock from before the batch turns all away.
    same_time = (F.col("ts") == F.col("last_lockout")) & (F.col("event_id") > F.col("locked_by"))
    behind = F.col("locked_by").isNull() | (F.col("ts") > F.col("last_lockout")) | same_time
    late = F.col("outcome").isin("valid", "wrong_secret") & F.col("last_lockout").isNotNull() & behind
    outcomes = checked.join(locked, "UserId", "left").withColumn(
        "outcome", F.when(F.coalesce(late, F.lit(False)), "locked_out").otherwise(F.col("outcome"))
    )
    return outcomes.drop("last_lockout", "locked_by"), state.drop("locked_by")


def after_logins(users: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Users with the dates of their last valid attempt."""
    last = outcomes.where("outcome = 'valid'").groupBy("UserId").agg(F.max("ts").alias("_login"))

    def later(column: str) -> Column:
        return F.greatest(F.col(column), F.col("_login"))

    dates = [c for c in ("LastLoginDate", "LastActivityDate") if c in users.columns]
    return users.join(last, "UserId", "left").withColumns({c: later(c) for c in dates}).drop("_login")
