"""Last activity and users online, from a stream of events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillbook.functions.times import instant, wall_clock
from tillbook.operators import activity


def last_activity(events: DataFrame, login_types: list[str]) -> DataFrame:
    """Changed users in each batch; run in update mode."""
    return activity.last_activity(events, login_types)


def online_over_time(events: DataFrame, size: str, slide: str, delay: str, error: float = 0.02) -> DataFrame:
    """Approximate distinct users per sliding window, once it is complete.

    A sketch per window keeps the state independent of the number of users.
    """
    counted = _windowed(events, size, slide, delay).groupBy("w").agg(
        F.approx_count_distinct("user_id", error).alias("users_online")
    )
    return _flat(counted)


def online_from_panes(events: DataFrame, size: str, slide: str, delay: str, error: float = 0.02) -> DataFrame:
    """The estimates from one sketch a slide: an event enters the state once, however many windows it lies in.

    The panes feed the windows once they are complete, so a window comes when the watermark has passed its end.
    """
    timed = events.withColumn("event_time", instant("ts")).withWatermark("event_time", delay)
    counted = activity.online_from_panes(timed, size, slide, error, "event_time")
    bounds = [wall_clock(F.unix_micros(b)).alias(b) for b in ("window_start", "window_end")]
    return counted.select(*bounds, "users_online")


def exact_online_over_time(events: DataFrame, size: str, slide: str, delay: str) -> DataFrame:
    """The exact counts, for state of one row per user and open window."""
    once = _windowed(events, size, slide, delay).dropDuplicates(["w", "user_id"])
    counted = once.groupBy("w").agg(F.count("user_id").alias("users_online"))
    return _flat(counted)


def _flat(counted: DataFrame) -> DataFrame:
    bounds = [wall_clock(F.unix_micros(f"w.{side}")).alias(f"window_{side}") for side in ("start", "end")]
    return counted.select(*bounds, "users_online")


def _windowed(events: DataFrame, size: str, slide: str, delay: str) -> DataFrame:
    timed = events.withColumn("event_time", instant("ts")).withWatermark("event_time", delay)
    return timed.select(F.window("event_time", size, slide).alias("w"), "user_id")
