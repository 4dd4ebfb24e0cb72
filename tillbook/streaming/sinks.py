"""Running a stream over what is available, and reading what it wrote."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tillbook.operators.snapshots import BucketedTable, Merge


# Without it a batch's shuffle files stay until the driver happens to collect its garbage.
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def write_appends(stream: DataFrame, path: str, checkpoint: str, *by: str) -> StreamingQuery:
    """Final rows only, in folders of the columns ``by``; the file sink's log makes each appear once.

    The shuffle files of a batch go when it ends, so that a stream holds those of one batch.
    """
    conf = stream.sparkSession.conf
    kept = conf.get(SHUFFLE_CLEANUP)
    conf.set(SHUFFLE_CLEANUP, "true")
    try:
        # The stream runs in a copy of the session, made as it starts.
        return (
            stream.writeStream.format("parquet")
            .outputMode("append")
            .partitionBy(*by)
            .option("path", path)
            .option("compression", "zstd")
            .option("checkpointLocation", checkpoint)
            .trigger(availableNow=True)
            .start()
        )
    finally:
        conf.set(SHUFFLE_CLEANUP, kept)


def write_updates(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Changed rows of each batch under its number; a repeated batch
    overwrites itself, so a restart leaves no duplicates."""

    def save(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return (
        stream.writeStream.foreachBatch(save)
        .outputMode("update")
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def fold_updates(stream: DataFrame, table: BucketedTable, merge: Merge, checkpoint: str) -> StreamingQuery:
    """Merge each batch's changed rows into a stored table under the batch's number.

    The table is the result: reading it costs the same after any number of
    batches, and a batch repeated after a restart is applied once. The table
    belongs to this stream, whose numbers it keeps.
    """

    def save(batch: DataFrame, number: int) -> None:
        table.apply(batch, merge, batch=number)

    return (
        stream.writeStream.foreachBatch(save)
        .outputMode("update")
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def latest_updates(spark: SparkSession, path: str, keys: list[str]) -> DataFrame:
    """The last row written for each key."""
    rows = spark.read.parquet(path)
    rest = [c for c in rows.columns if c not in (*keys, "batch")]
    last = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("_last"))
    return last.select(*keys, *[F.col(f"_last.{c}").alias(c) for c in rest])
