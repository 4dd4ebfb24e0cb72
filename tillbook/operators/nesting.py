"""Parent rows with their children as arrays of bounded size.

The shape is the same at every size: a parent comes as rows (key, ``chunk``,
``total``, array). The arrays follow the children's order from chunk to chunk,
each holds about ``max_bytes`` of text at most (a larger single child stands
alone), and ``total`` is the number of the parent's children, so a reader can
tell that all chunks are there. A childless parent has one empty chunk.

Children are cut into blocks of their order, so a parent's children spread over
as many tasks as their share asks for, equal ones too.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tillbook.operators.ordering import ordered_blocks, same_group

MAX_BYTES = 4 << 20


def item_bytes(item: Sequence[str]) -> Column:
    """Bytes of a child's values as text, one more for each."""
    size = F.lit(0).cast("bigint")
    for column in item:
        size = size + F.coalesce(F.octet_length(F.col(column).cast("string")), F.lit(0)) + 1
    return size


def collect_in_chunks(
    rows: DataFrame, key: str | Sequence[str], item: Sequence[str], name: str, max_bytes: int = MAX_BYTES
) -> DataFrame:
    """Rows (key, chunk, total, ``name``): arrays of the ``item`` columns in their order.

    A child is in the chunk that the bytes of the children before it have
    reached, so chunk numbers rise but skip one behind a child above the limit.
    """
    keys = [key] if isinstance(key, str) else list(key)
    # Equal children are told apart, else they could not be in different blocks.
    told = rows.select(*keys, *item).withColumn("_copy", F.monotonically_increasing_id())
    blocks = ordered_blocks(told, [*keys, *item, "_copy"]).withColumn("_size", item_bytes(item))
    sizes = blocks.groupBy(*keys, "block").agg(F.sum("_size").alias("_bytes"), F.count("*").alias("_n"))
    whole = Window.partitionBy(*keys)
    earlier = whole.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(
        *[F.col(k).alias(f"_{k}") for k in keys],
        F.col("block").alias("_block"),
        F.coalesce(F.sum("_bytes").over(earlier), F.lit(0)).alias("_before"),
        F.sum("_n").over(whole).alias("total"),
    )
    # A window never spans more than one block.
    inside = Window.partitionBy(*keys, "block").orderBy("position").rowsBetween(Window.unboundedPreceding, -1)
    placed = blocks.withColumn("_inside", F.coalesce(F.sum("_size").over(inside), F.lit(0)))
    value = F.col(item[0]) if len(item) == 1 else F.struct(*item)
    ordered = F.array_sort(F.collect_list(F.struct("block", "position", value.alias("_item"))))
    return (
        placed.join(offsets, same_group(keys) & (F.col("block") == F.col("_block")))
        .withColumn("chunk", F.floor((F.col("_before") + F.col("_inside")) / max_bytes))
        .groupBy(*keys, "chunk", "total")
        .agg(F.transform(ordered, lambda x: x["_item"]).alias(name))
    )


def nest(
    parents: DataFrame, children: DataFrame, key: str, item: Sequence[str], name: str, max_bytes: int = MAX_BYTES
) -> DataFrame:
    """Parents with their children; a childless parent has an empty array.

    An inner join, in which the chunks of a large parent can be split over
    tasks, and apart from it the parents without any chunk.
    """
    own = children.where(F.col(key).isNotNull()).select(key, *item)
    chunks = collect_in_chunks(own, key, item, name, max_bytes)
    having = own.select(key).distinct().withColumn("_has", F.lit(True))
    childless = parents.join(having, key, "left").where(F.col("_has").isNull()).select(
        *parents.columns,
        F.lit(0).cast("bigint").alias("chunk"),
        F.lit(0).cast("bigint").alias("total"),
        F.array().cast(chunks.schema[name].dataType).alias(name),
    )
    return parents.join(chunks, key).select(*parents.columns, "chunk", "total", name).unionByName(childless)


def nest_requested(
    requested: DataFrame,
    parents: DataFrame,
    children: DataFrame,
    key: str,
    item: Sequence[str],
    name: str,
    default_key=None,
    max_bytes: int = MAX_BYTES,
) -> DataFrame:
    """Nested parents for a table of requested keys.

    A NULL request falls back to ``default_key``; an unknown one gives no row.
    """
    wanted = requested.select(F.coalesce(F.col(key), F.lit(default_key)).alias(key)).distinct()
    chosen, own = (t.join(wanted, key, "left_semi") for t in (parents, children))
    return nest(chosen, own, key, item, name, max_bytes)
