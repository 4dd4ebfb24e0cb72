"""Tables as JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KEEP_NULLS = {"ignoreNullFields": "false"}


def as_objects(df: DataFrame) -> DataFrame:
    """One JSON object per row."""
    return df.select(F.to_json(F.struct("*"), KEEP_NULLS).alias("object"))


def as_documents(df: DataFrame, name: str, part: str, rows_per_document: int = 10_000) -> DataFrame:
    """Documents ``{"name": [{...}, ...]}``, one per part of the table.

    One document for a whole table would have to be built by one task. Rows are
    spread over as many documents as their count asks for, by the hash of
    ``part``, which must identify a row. A table without rows gives none.
    """
    parts = df.agg(F.ceil(F.count("*") / rows_per_document).alias("n")).scalar()
    chunk = F.pmod(F.xxhash64(part), parts)
    return df.withColumn("_part", chunk).groupBy(F.col("_part").alias("part")).agg(
        F.to_json(
            F.create_map(F.lit(name), F.sort_array(F.collect_list(F.struct(part, *[c for c in df.columns if c != part])))),
            KEEP_NULLS,
        ).alias("document")
    )


def write_objects(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("ignoreNullFields", "false").json(path)
