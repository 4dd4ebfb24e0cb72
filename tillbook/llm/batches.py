"""Arrow batches of whole texts, and the few expressions that the operators share."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import shutil
import tempfile
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

# Rows of one Arrow batch. Texts can be long, so far fewer than Spark's 10,000.
BATCH_ROWS = 512

# The white space of the contracts: space, and tab to carriage return.
SPACE = " \t\n\x0b\x0c\r"


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once per application."""
    context = spark.sparkContext
    if context.applicationId not in _shipped:
        package = Path(__file__).resolve().parent.parent
        archive = f"{tempfile.mkdtemp(prefix='spark-')}/{package.name}"
        context.addPyFile(shutil.make_archive(archive, "zip", package.parent, package.name))
        _shipped.add(context.applicationId)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def text_or_empty(column: str = "text") -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def map_lists(frame: DataFrame, function: Callable[[dict[str, list]], dict[str, list]], schema: str | StructType) -> DataFrame:
    """Apply ``function`` to each Arrow batch as lists of Python values by column.

    It returns lists by column in the order of ``schema``; they may be of any
    common length. Batches are small, so a task holds few texts at a time.
    """
    ship(frame.sparkSession)
    frame.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    arrow = _arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                found = function({n: batch.column(i).to_pylist() for i, n in enumerate(batch.schema.names)})
                yield pa.RecordBatch.from_arrays([pa.array(found[f.name], f.type) for f in arrow], schema=arrow)

    return frame.mapInArrow(run, schema)


def _arrow_schema(schema: str | StructType) -> pa.Schema:
    return to_arrow_schema(StructType.fromDDL(schema) if isinstance(schema, str) else schema)


def held_out(modulus: int, remainder: int, key: str = "doc_id") -> Column:
    """Whether crc32 of the key as text leaves ``remainder``; a null key counts as the empty text."""
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")) % modulus == remainder
