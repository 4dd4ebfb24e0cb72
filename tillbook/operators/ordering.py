"""Row numbers and pages without sorting a whole group in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tillbook.session import written

def ordered_blocks(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``df`` cut into contiguous runs of the key order, about equal in rows.

    Adds ``block`` (increasing with the keys) and ``position`` inside it. The
    keys must identify a row. A key value held by a third of the rows spans as
    many blocks as its share asks for. The result is written, because block
    numbers must not change between two uses.
    """
    row_id = F.monotonically_increasing_id()
    return written(
        df.repartitionByRange(*keys)
        .sortWithinPartitions(*keys)
        .select("*", F.shiftright(row_id, 33).alias("block"), row_id.bitwiseAND(F.lit((1 << 33) - 1)).alias("position")),
        "ordered-blocks",
    )


def same_group(group: Sequence[str]) -> Column:
    """Join condition on g and _g; rows without a group are a group as well."""
    same = F.lit(True)
    for g in group:
        same = same & F.col(g).eqNullSafe(F.col(f"_{g}"))
    return same


def number_rows(
    df: DataFrame, group: Sequence[str], order: Sequence[str], first: int = 0, last: int | None = None
) -> DataFrame:
    """Add ``row_no`` (from 1) within each group and ``total``, its row count.

    ``order`` must be unique within a group. Only one row per group and block
    is ranked by a window; rows learn their block's offset through a join. With
    ``first`` and ``last`` only row numbers in (first, last] come out, and of
    the blocks only those that hold any.
    """
    blocks = ordered_blocks(df, [*group, *order])
    sizes = blocks.groupBy(*group, "block").agg(F.count("*").alias("_n"), F.min("position").alias("_first"))
    whole = Window.partitionBy(*group)
    before = whole.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(
        *[F.col(g).alias(f"_{g}") for g in group],
        F.col("block").alias("_block"),
        "_first",
        "_n",
        F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"),
        F.sum("_n").over(whole).alias("total"),
    )
    wanted = F.lit(True)
    if first or last is not None:
        offsets = offsets.where(F.col("_before") + F.col("_n") > first)
        wanted = F.col("row_no") > first
    if last is not None:
        offsets = offsets.where(F.col("_before") < last)
        wanted = wanted & (F.col("row_no") <= last)
    return (
        blocks.join(offsets, same_group(group) & (F.col("block") == F.col("_block")))
        .withColumn("row_no", F.col("_before") + F.col("position") - F.col("_first") + 1)
        .where(wanted)
        .drop("block", "position", "_block", "_first", "_before", "_n", *[f"_{g}" for g in group])
    )


def check_page(index: int, size: int) -> None:
    if index < 0:
        raise ValueError("page index must not be negative")
    if size < 1:
        raise ValueError("page size must be at least 1")


def page(df: DataFrame, group: Sequence[str], order: Sequence[str], index: int, size: int) -> DataFrame:
    """Page ``index`` (from 0) of ``size`` rows of each group, with ``total``.

    At any depth a page costs the same: rows are counted by block, and of a
    group only the blocks that hold the page's rows are joined and filtered.
    ``order`` must be unique within a group.
    """
    check_page(index, size)
    first, last = index * size, (index + 1) * size
    return number_rows(df, group, order, first, last)


def single_page(df: DataFrame, order: Sequence[str], index: int, size: int) -> DataFrame:
    """One page of a table without groups, in order."""
    check_page(index, size)
    found = number_rows(df, [], order, index * size, (index + 1) * size)
    return found.orderBy("row_no").drop("row_no", "total")


def all_pages(df: DataFrame, group: Sequence[str], order: Sequence[str], size: int) -> DataFrame:
    """Every row with its page number (from 0), for any depth of paging."""
    check_page(0, size)
    return number_rows(df, group, order).withColumn("page", F.floor((F.col("row_no") - 1) / size))


# Folder names of a saved order.
ROWS, BOUNDS, EMPTY = "rows", "bounds", "empty"


class SavedOrder:
    """An order saved once, from which any page reads only the blocks that hold its rows.

    ``folder``/rows holds the rows by block, ``folder``/bounds the first key and
    the number of rows of each block, per group, one folder for each state of the
    order. Appended rows go to the blocks whose bounds they lie between, so
    that nothing already saved is read or written again; a block grows by what
    is appended to it, until the order is saved anew. Keys must identify a row;
    a null sorts before every value.
    """

    def __init__(self, spark: SparkSession, folder: str, group: Sequence[str], order: Sequence[str]):
        self.spark, self.folder, self.group, self.order = spark, folder.rstrip("/"), list(group), list(order)

    @classmethod
    def save(cls, df: DataFrame, folder: str, group: Sequence[str], order: Sequence[str], blocks: int | None = None) -> SavedOrder:
        saved = cls(df.sparkSession, folder, group, order)
        keys = [*saved.group, *saved.order]
        ranged = df.repartitionByRange(blocks, *keys) if blocks else df.repartitionByRange(*keys)
        df.limit(0).write.parquet(f"{saved.folder}/{EMPTY}")
        saved._append(ranged.withColumn("block", F.spark_partition_id()), 0)
        return saved

    def _rows(self) -> DataFrame:
        schema = self.spark.read.parquet(f"{self.folder}/{EMPTY}").schema
        return self.spark.read.schema(schema.add("state", "integer").add("block", "integer")).parquet(f"{self.folder}/{ROWS}")

    def _append(self, placed: DataFrame, state: int) -> None:
        """Rows with their block as a further state of the order."""
        placed.write.partitionBy("block").parquet(f"{self.folder}/{ROWS}/state={state}")
        found = self._rows().where(F.col("state") == state)
        key = F.struct(*self.group, *self.order)
        found.groupBy(*self.group, "block").agg(F.count("*").alias("n"), F.min(key).alias("low")).write.parquet(
            f"{self.folder}/{BOUNDS}/state={state}"
        )

    def bounds(self) -> DataFrame:
        """Rows and first key of every block and group, over all states."""
        every = self.spark.read.parquet(f"{self.folder}/{BOUNDS}")
        return every.groupBy(*self.group, "block").agg(F.sum("n").alias("n"), F.min("low").alias("low"), F.max("state").alias("state"))

    def append(self, df: DataFrame) -> None:
        """Add rows: each to the last block that begins at or before its key, or to the first one."""
        bounds = written(self.bounds(), "bounds")
        state = bounds.agg(F.coalesce(F.max("state"), F.lit(0))).first()[0] + 1
        # Blocks in order; one number for each, whatever groups it holds.
        starts = bounds.groupBy("block").agg(F.min("low").alias("low"))
        key = F.struct(*self.group, *self.order)
        marks = starts.select(F.col("low").alias("_key"), F.col("block").alias("_block"), F.lit(None).cast("long").alias("_row"))
        rows = written(df.withColumn("_row", F.monotonically_increasing_id()), "appended")
        asked = rows.select(key.alias("_key"), F.lit(None).cast("int").alias("_block"), "_row")
        # Merged in key order over ranges; a range without a block of its own takes the last one before it.
        merged = marks.unionByName(asked).repartitionByRange("_key", F.col("_row").asc_nulls_first())
        merged = written(merged.withColumn("_part", F.spark_partition_id()), "merged")
        lasts = merged.groupBy("_part").agg(F.max("_block").alias("_last"))
        before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each partition
        lasts = lasts.withColumn("_carried", F.max("_last").over(before)).select("_part", "_carried")
        within = Window.partitionBy("_part").orderBy("_key", F.col("_row").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0)
        placed = merged.withColumn("_own", F.max("_block").over(within)).join(lasts, "_part")
        first = starts.agg(F.min("block")).first()[0] or 0
        numbers = placed.where("_row IS NOT NULL").select("_row", F.coalesce("_own", "_carried", F.lit(first)).alias("block"))
        self._append(rows.join(numbers, "_row").drop("_row"), state)

    def _numbered(self, first: int | None, last: int | None) -> DataFrame:
        whole = Window.partitionBy(*self.group)
        before = whole.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
        offsets = self.bounds().select(
            *[F.col(g).alias(f"_{g}") for g in self.group], F.col("block").alias("_block"), "n",
            F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_before"), F.sum("n").over(whole).alias("total"),
        )
        wanted = F.lit(True)
        if first is not None:
            offsets = offsets.where((F.col("_before") + F.col("n") > first) & (F.col("_before") < last))
            wanted = (F.col("row_no") > first) & (F.col("row_no") <= last)
        rows = self._rows().drop("state")
        if first is not None:
            # At most the blocks of the order, whatever the number of groups; they name the folders that are read.
            rows = rows.where(F.col("block").isin([r["_block"] for r in offsets.select("_block").distinct().collect()]))
        held = rows.join(offsets.drop("n"), same_group(self.group) & (F.col("block") == F.col("_block")))
        place = F.row_number().over(Window.partitionBy(*self.group, "block").orderBy(*self.order))
        numbered = held.withColumn("row_no", F.col("_before") + place).where(wanted)
        return numbered.drop("block", "_block", "_before", *[f"_{g}" for g in self.group])

    def page(self, index: int, size: int) -> DataFrame:
        """Page ``index`` (from 0) of each group with ``row_no`` and ``total``; nothing is written."""
        check_page(index, size)
        return self._numbered(index * size, (index + 1) * size)

    def all_pages(self, size: int) -> DataFrame:
        """Every row with its page number (from 0)."""
        check_page(0, size)
        return self._numbered(None, None).withColumn("page", F.floor((F.col("row_no") - 1) / size))
