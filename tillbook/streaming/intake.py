"""Product comments as they arrive: checked, escaped, once each."""

from __future__ import annotations

import json
import sys
from collections.abc import Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tillbook.functions.text import html_escape, parameter_error, trimmed
from tillbook.streaming.lockout import ROCKSDB

# Ship the processor itself, so that workers need not have this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Largest sizes of a comment's fields.
RULES = {
    "productCode": {"no_commas": True, "max_size": 15},
    "email": {"no_commas": True, "max_size": 100},
    "comment": {},
}


def _error(comments: DataFrame):
    return F.coalesce(*[parameter_error(F.col(c).cast("string"), **rule) for c, rule in RULES.items()])


def accepted(comments: DataFrame, key: str, arrived: str, delay: str) -> DataFrame:
    """Valid comments with escaped text, repeated deliveries left out.

    A repeat is recognised while it arrives within ``delay`` of the first.
    """
    valid = comments.where(_error(comments).isNull())
    clean = valid.withColumns({c: html_escape(trimmed(F.col(c))) for c in ("email", "comment")})
    return clean.withWatermark(arrived, delay).dropDuplicatesWithinWatermark([key])


def rejected(comments: DataFrame) -> DataFrame:
    """Invalid comments with the first rule each breaks, without their text."""
    return comments.withColumn("error", _error(comments)).where(F.col("error").isNotNull()).drop("comment")


# --- every delivery with its outcome ---------------------------------------

ACCEPTED, REJECTED, REPEAT, LATE = "accepted", "rejected", "repeat", "late"
JUDGED = "row string, error string, outcome string"
# Groups that rows are dealt to, by their key. It is part of a stream's state and must stay as it is.
GROUPS = 1024
# RocksDB reserves 4 MB a store for its logs, more than the keys of most take.
NO_RESERVE = "spark.sql.streaming.stateStore.rocksdb.allowFAllocate"
# Pieces of a group's state that are read before they are joined into one.
PIECES = 16
# Micros survive; the formats of both directions.
AS_TEXT = {
    "ignoreNullFields": "false",
    "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX",
    "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS",
}


class IntakeProcessor(StatefulProcessor):
    """Remembers a key from its first valid delivery until the watermark is ``delay`` past it.

    A call holds a group of keys, whose state is read and added to once, however
    many rows it has: pieces of JSON, from key to the micros of its first delivery.
    """

    def __init__(self, delay_us: int):
        self.delay_us = delay_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.first = handle.getListState("first", "keys string")

    def _remembered(self, passed: int) -> tuple[dict[str, int], bool]:
        """The group's keys, and whether its state holds more than them."""
        pieces = [json.loads(keys) for keys, in self.first.get()] if self.first.exists() else []
        known = {key: us for piece in pieces for key, us in piece.items() if us + self.delay_us >= passed}
        return known, len(known) < sum(map(len, pieces)) or len(pieces) > PIECES

    def _wake(self, us: int) -> None:
        # A timer fires once the watermark has passed it: round up.
        self.handle.registerTimer((us + self.delay_us) // 1000 + 1)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        known, stale = self._remembered(passed)
        new = {}
        for batch in rows:
            outcomes = []
            for name, us, error in zip(batch["name"].tolist(), batch["us"].tolist(), batch["error"].tolist()):
                if isinstance(error, str):
                    outcomes.append(REJECTED)
                elif us < passed:
                    outcomes.append(LATE)
                elif name in known or name in new:
                    outcomes.append(REPEAT)
                else:
                    outcomes.append(ACCEPTED)
                    new[name] = us
            yield batch.drop(columns=["place", "name", "us"]).assign(outcome=outcomes)
        if stale:
            self.first.put([(json.dumps(known | new),)])
        elif new:
            self.first.appendValue((json.dumps(new),))
        if new:
            self._wake(min(new.values()))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        known, stale = self._remembered(timerValues.getCurrentWatermarkInMs() * 1000)
        if not known:
            self.first.clear()
            return iter(())
        if stale:
            self.first.put([(json.dumps(known),)])
        # The rest goes with its last, or when rows come.
        self._wake(max(known.values()))
        return iter(())

    def close(self) -> None:
        pass


def outcomes(comments: DataFrame, key: str, arrived: str, delay_seconds: int) -> DataFrame:
    """Every delivered row once, with ``outcome`` and the ``error`` of a rejected one.

    ``rejected``: breaks a rule, or has no key or time ("null"); its comment is
    left out. ``late``: valid, but behind the watermark, whether delivered
    before or not. ``repeat``: its key was accepted and is still remembered.
    ``accepted``: the first of its key; only here the texts are escaped. Of
    several in one batch any one is the first. Rejected rows need no state and
    spread over the groups.
    """
    comments.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    comments.sparkSession.conf.set(NO_RESERVE, "false")
    schema = comments.schema
    missing = F.col(key).isNull() | F.col(arrived).isNull()
    # A column of its own: the rules read the whole text, once.
    found, error = F.when(missing, "null").otherwise(_error(comments)), F.col("_error")
    name = F.when(error.isNull(), F.col(key).cast("string"))
    place = F.when(error.isNull(), F.pmod(F.xxhash64(name), F.lit(GROUPS))).otherwise(F.floor(F.rand() * GROUPS)).cast("int")
    # Texts travel as they are, all other columns as one text: they must come back as they were, nulls beside
    # large numbers too. Without the watermarked column among them late rows are not dropped on the way.
    texts = [c for c, kind in comments.dtypes if kind == "string"]
    rest = T.StructType([f for f in schema if f.name not in texts])
    sent = {c: F.when(error.isNull(), F.col(c)) if c == "comment" else F.col(c) for c in texts}
    judged = (
        comments.withWatermark(arrived, f"{delay_seconds} seconds")
        .withColumn("_error", found)
        .select(
            place.alias("place"), name.alias("name"), F.coalesce(F.unix_micros(arrived), F.lit(0)).alias("us"),
            F.to_json(F.struct(*rest.names), AS_TEXT).alias("row"), error.alias("error"),
            *[value.alias(f"text_{at}") for at, value in enumerate(sent.values())],
        )
        .groupBy("place")
        .transformWithStateInPandas(
            statefulProcessor=IntakeProcessor(delay_seconds * 1_000_000),
            outputStructType=", ".join([JUDGED, *[f"text_{at} string" for at in range(len(texts))]]),
            outputMode="Append",
            timeMode="EventTime",
        )
    )
    place_of = {c: F.col(f"text_{at}") for at, c in enumerate(texts)}
    parsed = judged.withColumn("row", F.from_json("row", rest, AS_TEXT))
    rows = parsed.select(*[place_of.get(c, F.col("row")[c]).alias(c) for c in schema.names], "error", "outcome")
    accepted_row = F.col("outcome") == ACCEPTED
    escaped = {c: F.when(accepted_row, html_escape(trimmed(F.col(c)))).otherwise(F.col(c)) for c in ("email", "comment")}
    return rows.withColumns(escaped)
