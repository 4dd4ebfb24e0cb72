"""Last activity and users online, from an event table."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def last_activity(events: DataFrame, login_types: list[str]) -> DataFrame:
    """Last event of any kind and last login of each user."""
    login = F.when(F.col("event_type").isin(*login_types), F.col("ts"))
    return events.groupBy("user_id").agg(F.max("ts").alias("last_activity"), F.max(login).alias("last_login"))


def online_over_time(events: DataFrame, size: str, slide: str) -> DataFrame:
    """Distinct users active in each sliding window.

    Users are first reduced to one row per window, so the count never sees
    more rows than users times windows, and no window is gathered in one task.
    """
    windows = events.select("user_id", F.window("ts", size, slide).alias("w")).distinct()
    return windows.groupBy("w").agg(F.count("user_id").alias("users_online")).select(
        F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "users_online"
    )


def online_from_panes(events: DataFrame, size: str, slide: str, error: float = 0.02, time: str = "ts") -> DataFrame:
    """Estimated distinct users of each sliding window: one sketch a slide, merged by window.

    Every event is counted once, in the pane of its slide; only the sketches
    (2**k bytes at most) are copied into the windows they lie in. ``error`` is the
    relative standard error. The size must be a multiple of the slide. A window
    whose events all lack a user has none online.
    """
    if error <= 0:
        raise ValueError("the error must be above 0")
    # A sketch of 2**k cells errs by about 1.04 / sqrt(2**k); the library takes 4 to 21.
    k = min(21, max(4, math.ceil(2 * math.log2(1.04 / error))))
    panes = events.groupBy(F.window(time, slide).alias("pane")).agg(F.hll_sketch_agg("user_id", F.lit(k)).alias("sketch"))
    windows = panes.groupBy(F.window(F.window_time("pane"), size, slide).alias("w"))
    counted = windows.agg(F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("users_online"))
    return counted.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "users_online")
