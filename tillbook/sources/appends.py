"""Append-only tables: comments, mailing list, postings."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tillbook.operators.ordering import number_rows
from tillbook.session import Scratch
from tillbook.streaming.sinks import write_appends

# Columns of each append-only table.
APPEND_TABLES = {
    "comments": ["productCode", "email", "comment"],
    "mailing_list": ["FirstName", "LastName", "Email"],
    "postings": ["Title", "Email", "Message"],
}


def append(rows: DataFrame, table: str, path: str) -> None:
    """Append the table's columns; other columns are an error."""
    columns = APPEND_TABLES[table]
    if sorted(rows.columns) != sorted(columns):
        raise ValueError(f"{table} takes {columns}, not {rows.columns}")
    rows.select(*columns).write.mode("append").parquet(path)


def append_stream(rows: DataFrame, table: str, path: str, checkpoint: str) -> StreamingQuery:
    """Append as rows arrive; exactly once through the file sink's log."""
    return write_appends(rows.select(*APPEND_TABLES[table]), path, checkpoint)


def numbered(rows: DataFrame, number: str, order: Sequence[str], after: int = 0) -> DataFrame:
    """Number rows from ``after`` + 1 in ``order``, without sorting them in one task."""
    told = rows.withColumn("_tie", F.monotonically_increasing_id())
    placed = number_rows(told, [], [*order, "_tie"])
    return placed.withColumn(number, F.col("row_no") + after).drop("row_no", "total", "_tie")


def append_numbered(rows: DataFrame, table: str, path: str, number: str, order: Sequence[str]) -> None:
    """Append a batch whose numbers follow those already stored.

    One writer at a time, as for any key that counts up.
    """
    columns = APPEND_TABLES[table]
    try:
        stored = rows.sparkSession.read.parquet(path)
        last = stored.agg(F.max(number)).first()[0] or 0
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        last = 0
    numbered(rows.select(*columns), number, order, last).select(number, *columns).write.mode("append").parquet(path)


# --- numbered as rows arrive -----------------------------------------------

RANGE = "first long, rows long"


class NumberedStream:
    """A numbered table that a stream appends to: rows by batch, and beside them the range of numbers each batch took.

    A batch's range is stored before its rows. It begins behind that of the
    batch before, the only one that is read, so allotting costs the same after
    any number of batches. A batch delivered again finds its range and puts its
    rows in place of those it had written: numbers stay without gaps and
    repeats. With every column in ``order`` each row also gets the number it had.
    The table belongs to one stream and its checkpoint; ``after`` is the last
    number given before it.
    """

    def __init__(self, spark: SparkSession, table: str, path: str, number: str, order: Sequence[str], after: int = 0):
        self.spark, self.path, self.number, self.order, self.after = spark, path.rstrip("/"), number, list(order), after
        self.columns = APPEND_TABLES[table]

    def read(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/rows").select(self.number, *self.columns)

    def start(self, rows: DataFrame, checkpoint: str) -> StreamingQuery:
        """Take what is available and stop."""
        writer = rows.select(*self.columns).writeStream.foreachBatch(self.save)
        return writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

    def save(self, batch: DataFrame, at: int) -> None:
        spark = batch.sparkSession
        scratch = Scratch(spark, "numbered-batch")
        batch = scratch.written(batch, "rows")
        taken = self._range(spark, at)
        if taken is None:
            before = self._range(spark, at - 1)
            taken = (self.after if before is None else sum(before), batch.count())
            spark.createDataFrame([taken], RANGE).coalesce(1).write.mode("overwrite").parquet(f"{self.path}/ranges/{at}")
        placed = numbered(batch, self.number, self.order, taken[0])
        placed.select(self.number, *self.columns).write.mode("overwrite").parquet(f"{self.path}/rows/batch={at}")
        scratch.drop()

    def _range(self, spark: SparkSession, at: int) -> tuple[int, int] | None:
        """Last number before a batch and how many it took; none if it has no range that was written to its end."""
        try:
            found = spark.read.schema(RANGE).parquet(f"{self.path}/ranges/{at}").first()
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            found = None
        return found and (found["first"], found["rows"])
