"""Login attempts out of application log lines.

Lines look like ``INFO  2024-01-01 10:00:00,123  45ms Login   Click - User x
attempted to log in with password y``. The password is cut off while parsing
and is in no column.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tillbook.session import written

# Ship the functions themselves, so that workers need not have this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

LINE = r"^(\w+)\s+(\d{4}-\d\d-\d\d \d\d:\d\d:\d\d,\d{3})\s+(\d+)ms\s+(\S+)\s+(\S+)\s+- (.*)$"
# The first such phrase ends the name: a later one is part of the password.
ATTEMPT = r"^User (.*?) attempted to log in with password"


def login_attempts(lines: DataFrame, column: str = "value") -> DataFrame:
    """(ts, level, logger, method, email) of the lines that report an attempt."""
    message = F.regexp_extract(column, LINE, 6)
    return lines.where(message.rlike(ATTEMPT)).select(
        F.to_timestamp_ntz(F.replace(F.regexp_extract(column, LINE, 2), F.lit(","), F.lit("."))).alias("ts"),
        F.regexp_extract(column, LINE, 1).alias("level"),
        F.regexp_extract(column, LINE, 4).alias("logger"),
        F.regexp_extract(column, LINE, 5).alias("method"),
        F.regexp_extract(message, ATTEMPT, 1).alias("email"),
    )


def read_log(spark: SparkSession, path: str) -> DataFrame:
    return login_attempts(spark.read.text(path))


def read_log_stream(spark: SparkSession, path: str) -> DataFrame:
    """The same rows as the log's files arrive."""
    return login_attempts(spark.readStream.text(path))


# --- records of several lines, logs of several files ------------------------

HEAD = r"^\w+\s+\d{4}-\d\d-\d\d \d\d:\d\d:\d\d,\d{3}\s+\d+ms\s+\S+\s+\S+\s+- "
# A rolled file's number follows the log's name; the higher, the older.
ROLLED = r"\.(\d+)(?:\.gz)?$"
SECRET = r"(?s)^(User .*? attempted to log in with password).*$"


PIECE = "path string, start long, record long, text string"


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(path, start, record, text) of the records that lie in a split, numbered from 1 along it.

    Lines before the split's first head are record 0. The lines of a split follow each other.
    """
    split, record, text = None, 0, []
    for batch in batches:
        done = []
        starts, values = batch["start"].to_pylist(), batch["value"].to_pylist()
        for path, start, value, head in zip(batch["path"].to_pylist(), starts, values, batch["head"].to_pylist()):
            if head or split != (path, start):
                if text:
                    done.append((*split, record, "\n".join(text)))
                record = (record if split == (path, start) else 0) + head
                split, text = (path, start), []
            text.append(value)
        if done:
            yield _as_batch(done)
    if text:
        yield _as_batch([(*split, record, "\n".join(text))])


def _as_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = {"path": pa.string(), "start": pa.int64(), "record": pa.int64(), "text": pa.string()}
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds.values())], names=list(kinds))


def read_records(spark: SparkSession, path: str, rolled: str = ROLLED) -> DataFrame:
    """(log, ts, level, logger, method, message) of each record, however many lines it has.

    A line that does not look like a record's first continues the record before
    it, across the splits of a file and from an older rolled file into the next;
    ``rolled`` finds the number of a rolled file in its path, what is left of the
    path is the log. Files of one number follow each other by name. The message
    keeps its line ends and loses a password, whatever lines that spans. Lines
    before a log's first record belong to none and are left out. A record is one
    value and must fit a row.

    Each split is cut into records as it is read, without a sort of its lines. What one
    leaves open is found from a row per split, and only the lines at a split's
    start move to another record.
    """
    lines = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("path"),
        F.col("_metadata.file_name").alias("file"),
        F.col("_metadata.file_block_start").alias("start"),
        F.col("value"),
        F.col("value").rlike(HEAD).alias("head"),
    )
    log = F.regexp_replace("path", rolled, "").alias("log")
    # Older first.
    number = F.nullif(F.regexp_extract("path", rolled, 1), F.lit("")).cast("long")
    roll = (-F.coalesce(number, F.lit(0))).alias("roll")
    heads = lines.groupBy("path", "file", "start").agg(F.sum(F.col("head").cast("int")).alias("heads"))
    splits = written(heads.select("path", log, roll, "file", "start", "heads"), "log-splits")
    last = F.when(F.col("heads") > 0, F.struct("roll", "file", "start", F.col("heads").alias("record")))
    before = Window.partitionBy("log").orderBy("roll", "file", "start").rowsBetween(Window.unboundedPreceding, -1)
    carried = splits.withColumn("_open", F.last(last, ignorenulls=True).over(before)).select("path", "log", "roll", "file", "start", "_open")
    pieces = lines.drop("file").mapInArrow(_pieces, PIECE).join(carried, ["path", "start"])
    # At most one piece a split has no head of its own.
    own = F.struct("roll", "file", "start", "record")
    record = F.when(F.col("record") > 0, own).otherwise(F.col("_open"))
    placed = pieces.select("log", record.alias("_record"), F.struct("roll", "file", "start", "text").alias("_piece"))
    # Nearly every record is one piece: nothing would combine before the shuffle.
    dealt = placed.where("_record IS NOT NULL").repartition("log", "_record")
    whole = dealt.groupBy("log", "_record").agg(F.array_sort(F.collect_list("_piece")).alias("_pieces"))
    value = F.array_join(F.transform("_pieces", lambda s: s["text"]), "\n")
    part = r"(?s)" + LINE
    return whole.select("log", value.alias("value")).select(
        "log",
        F.to_timestamp_ntz(F.replace(F.regexp_extract("value", part, 2), F.lit(","), F.lit("."))).alias("ts"),
        F.regexp_extract("value", part, 1).alias("level"),
        F.regexp_extract("value", part, 4).alias("logger"),
        F.regexp_extract("value", part, 5).alias("method"),
        F.regexp_replace(F.regexp_extract("value", part, 6), SECRET, "$1").alias("message"),
    )


def record_attempts(records: DataFrame) -> DataFrame:
    """(ts, level, logger, method, email) of the records that report an attempt; a name may hold line ends."""
    attempt = r"(?s)" + ATTEMPT
    tried = records.where(F.col("message").rlike(attempt))
    return tried.select("ts", "level", "logger", "method", F.regexp_extract("message", attempt, 1).alias("email"))
