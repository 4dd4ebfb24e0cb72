"""Connected components of a link table, each named by its smallest node."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillbook.session import written


def components(links: DataFrame, written: Callable[[DataFrame, str], DataFrame] = written) -> DataFrame:
    """Node and root of every node that occurs in ``links`` (columns ``a``, ``b``).

    Rounds of large and small stars: every node passes its smallest neighbour on
    to its larger, then to its smaller neighbours, until all links are stars.
    The number of rounds grows with the logarithm of the longest path. Each
    round is written, so lost executors never replay earlier rounds. A link with a
    null end, or of a node with itself, counts for nothing; repeated links count
    once; a table without links has no nodes.
    """
    edges = written(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "star")
    mark = _mark(edges)
    while True:
        both = edges.union(edges.select("v", "u"))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("low"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("low").alias("v"))
        large = written(large.distinct(), "star")
        low = large.groupBy("u").agg(F.min("v").alias("low"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("low").alias("v")).where("u <> v")
        edges = written(small.union(low).distinct(), "star")
        last, mark = mark, _mark(edges)
        if last == mark:
            break
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(edges.select("v", "v").distinct())


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
