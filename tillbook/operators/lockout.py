"""Account lockout over a whole history of login attempts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillbook.functions import lockout as rules
from tillbook.session import written

# State fields and the columns they have in a result.
STORED = {
    "locked": "is_locked_out", "locked_at": "last_lockout", "password_count": "password_count",
    "password_start": "password_window_start", "answer_count": "answer_count", "answer_start": "answer_window_start",
}


def _runs(attempts: DataFrame, blocks: int | None = None) -> DataFrame:
    """Each account's attempts as sorted arrays, one per block of the table.

    The table is range-partitioned by account and time, so an account holding
    a third of all attempts spans many blocks and no array outgrows one block.
    """
    # An attempt without an account changes none.
    events = attempts.where(F.col("user_id").isNotNull()).select(
        "user_id", "ts", "event_id", "ok", (rules.checked_counter(F.col("counter")) == "password").alias("is_password")
    )
    keys = ["user_id", "ts", "event_id"]
    ranged = events.repartitionByRange(blocks, *keys) if blocks else events.repartitionByRange(*keys)
    return written(
        ranged.withColumn("block", F.spark_partition_id()).groupBy("user_id", "block").agg(
            F.sort_array(F.collect_list(F.struct("ts", "event_id", "ok", "is_password"))).alias("events")
        ),
        "attempt-runs",
    )


def _summarised(runs: DataFrame, limit: int, window: Column) -> DataFrame:
    """What each block does to any state carried into it.

    Before the block's first success only failures arrive, and each counter
    goes its own way; from the success on nothing carried in matters.
    """
    success = F.array_position(F.transform("events", lambda e: e["ok"]), F.lit(True)).cast("int")
    head = F.when(F.col("success") > 0, F.slice("events", F.lit(1), F.col("success") - 1)).otherwise(F.col("events"))

    def failures(is_password: bool) -> Column:
        mine = F.filter("head", lambda e: e["is_password"] == is_password)
        return F.transform(mine, lambda e: e["ts"])

    return (
        runs.withColumn("success", success)
        .withColumn("head", head)
        .withColumn("password_times", failures(True))
        .withColumn("answer_times", failures(False))
        .select(
            "user_id",
            "block",
            F.when(
                F.col("success") > 0,
                rules.fold(
                    rules.clean_state(), F.slice("events", F.col("success"), F.size("events")), limit, window
                ),
            ).alias("tail"),
            F.size("password_times").alias("password_failures"),
            rules.window_outcomes(F.col("password_times"), F.col("events")[0]["ts"], limit, window).alias("password"),
            F.size("answer_times").alias("answer_failures"),
            rules.window_outcomes(F.col("answer_times"), F.col("events")[0]["ts"], limit, window).alias("answer"),
        )
    )


def _after_block(state: Column, block: Column, limit: int, window: Column) -> Column:
    """State after a block; on a lock only the flag is meaningful."""
    password = rules.carry(
        state["password_count"], state["password_start"], block["password_failures"], block["password"], limit, window
    )
    answer = rules.carry(
        state["answer_count"], state["answer_start"], block["answer_failures"], block["answer"], limit, window
    )
    locks = password["locks"] | answer["locks"]
    open_end = F.struct(
        F.lit(False).alias("locked"), F.lit(None).cast("timestamp_ntz").alias("locked_at"),
        password["count"].alias("password_count"), password["start"].alias("password_start"),
        answer["count"].alias("answer_count"), answer["start"].alias("answer_start"), F.lit(None).alias("locked_by"),
    ).cast(rules.STATE)
    locked = F.struct(
        F.lit(True).alias("locked"), F.lit(None).cast("timestamp_ntz").alias("locked_at"),
        F.lit(0).alias("password_count"), F.lit(None).cast("timestamp_ntz").alias("password_start"),
        F.lit(0).alias("answer_count"), F.lit(None).cast("timestamp_ntz").alias("answer_start"), F.lit(None).alias("locked_by"),
    ).cast(rules.STATE)
    return F.when(locks, locked).otherwise(F.coalesce(block["tail"], open_end))


def _carried(rows: DataFrame, stored: DataFrame | None) -> DataFrame:
    """Add ``carried``: the account's stored state, else a clean one."""
    if stored is None:
        return rows.withColumn("carried", rules.clean_state())
    return rows.join(stored, "user_id", "left").withColumn("carried", F.coalesce("_stored", rules.clean_state())).drop("_stored")


def _deciding_blocks(summaries: DataFrame, stored: DataFrame | None, limit: int, window: Column) -> DataFrame:
    """For accounts in several blocks: the block that decides, and the state
    carried into it: the block of the lock, else the last one."""
    summary = F.struct("block", "tail", "password_failures", "password", "answer_failures", "answer")
    ordered = _carried(summaries.groupBy("user_id").agg(F.sort_array(F.collect_list(summary)).alias("blocks")), stored)
    # Until a block locks, each step remembers the state it started from.
    start = F.struct(F.lit(-1).alias("block"), F.col("carried"), F.col("carried").alias("state")).cast(f"struct<block:int,carried:{rules.STATE},state:{rules.STATE}>")

    def step(s: Column, b: Column) -> Column:
        return F.when(s["state"]["locked"], s).otherwise(
            F.struct(
                b["block"].alias("block"),
                s["state"].alias("carried"),
                _after_block(s["state"], b, limit, window).alias("state"),
            ).cast(f"struct<block:int,carried:{rules.STATE},state:{rules.STATE}>")
        )

    return ordered.withColumn("d", F.aggregate("blocks", start, step)).select(
        "user_id", F.col("d.block").alias("block"), F.col("d.carried").alias("carried")
    )


def lockout_state(
    attempts: DataFrame,
    max_failures: int = 50,
    window_minutes: int = 10,
    blocks: int | None = None,
    accounts: DataFrame | None = None,
    with_event: bool = False,
) -> DataFrame:
    """Final lockout state of every account with an attempt or a stored state.

    ``attempts`` has user_id, event_id, ts, ok and counter. Most accounts lie
    in one block and are folded there. Of the others there are fewer than
    blocks; their blocks are summarised side by side, the short lists of
    summaries are walked in order, and only the deciding block of each is
    folded again. ``blocks`` sets the number of blocks; the session's shuffle
    partitions decide otherwise.

    ``accounts`` is an earlier result of this function, or of unlocking it, and
    ``attempts`` then those made since; the history is not folded again.
    ``with_event`` adds ``locked_by``, the event_id of the failure that locked; a
    lock from ``accounts`` has none.
    """
    window = F.make_dt_interval(mins=F.lit(window_minutes))
    stored = None
    if accounts is not None:
        # A locked account ignores every attempt.
        attempts = attempts.join(accounts.where("is_locked_out").select("user_id"), "user_id", "left_anti")
        stored = accounts.select("user_id", F.struct(*[F.col(c).alias(f) for f, c in STORED.items()], F.lit(None).alias("locked_by")).cast(rules.STATE).alias("_stored"))
    runs = _runs(attempts, blocks)
    # Fewer rows than blocks, written first: joins with it are planned on its size.
    several = written(
        runs.groupBy("user_id").agg(F.count("*").alias("n")).where(F.col("n") > 1).select("user_id"), "split-accounts"
    )
    whole = _carried(runs.join(several, "user_id", "left_anti"), stored)
    split = runs.join(several, "user_id", "left_semi")
    deciding = _deciding_blocks(_summarised(split, max_failures, window), stored, max_failures, window)
    last = split.join(deciding, ["user_id", "block"])
    state = rules.fold(F.col("carried"), F.col("events"), max_failures, window)
    columns = ["user_id", "events", "carried"]
    folded = whole.select(*columns).unionByName(last.select(*columns)).select("user_id", state.alias("s"))
    event = [F.col("s.locked_by")] if with_event else []
    found = folded.select("user_id", *[F.col(f"s.{f}").alias(c) for f, c in STORED.items()], *event)
    if accounts is None:
        return found
    unchanged = accounts.join(runs.select("user_id").distinct(), "user_id", "left_anti")
    if with_event:
        unchanged = unchanged.withColumn("locked_by", F.lit(None).cast("long"))
    return found.unionByName(unchanged.select(*found.columns))


def lockout_with_unlocks(
    attempts: DataFrame,
    unlocks: DataFrame,
    max_failures: int = 50,
    window_minutes: int = 10,
    blocks: int | None = None,
    accounts: DataFrame | None = None,
) -> DataFrame:
    """``lockout_state`` where ``unlocks`` (user_id, ts, event_id) take effect in the order of the attempts.

    An unlock clears counters and windows whatever came before, so only the
    attempts behind the last unlock that still has an attempt behind it are
    folded. An unlock behind all attempts clears the folded state and leaves
    the time of the lock. An account without attempt or stored state is not made.
    """
    at = F.struct("ts", "event_id")
    asked = unlocks.where(F.col("user_id").isNotNull()).select("user_id", at.alias("at"))
    # Maxima combine before the shuffle; one row per account with an unlock is left.
    last = attempts.join(asked.select("user_id").distinct(), "user_id", "left_semi").groupBy("user_id").agg(F.max(at).alias("last_attempt"))
    resets = written(
        asked.join(last, "user_id", "left").groupBy("user_id").agg(
            F.max(F.when(F.col("at") < F.col("last_attempt"), F.col("at"))).alias("start"),
            F.bool_or(F.coalesce(F.col("at") >= F.col("last_attempt"), F.lit(True))).alias("cleared"),
        ),
        "unlocked-accounts",
    )
    starts = resets.where("start IS NOT NULL").select("user_id", "start")
    behind = attempts.join(starts, "user_id", "left").where(F.col("start").isNull() | (at > F.col("start"))).drop("start")
    if accounts is not None:
        accounts = accounts.join(starts, "user_id", "left_anti")
    state = lockout_state(behind, max_failures, window_minutes, blocks, accounts)
    cleared = F.coalesce("cleared", F.lit(False))
    clean = {
        "is_locked_out": F.lit(False), "password_count": F.lit(0), "answer_count": F.lit(0),
        "password_window_start": F.lit(None), "answer_window_start": F.lit(None),
    }
    return (
        state.join(resets.select("user_id", "cleared"), "user_id", "left")
        .withColumns({c: F.when(cleared, v).otherwise(F.col(c)) for c, v in clean.items()})
        .drop("cleared")
    )
