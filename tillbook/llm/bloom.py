"""Bloom filters as small tables: words of 64 cells, tested in the scan that reads the rows.

A filter of at most ``MAX_BITS`` may be broadcast whatever the number of rows.
Null keys are keys like any other. An empty table makes an empty filter, which
no row passes.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HASHES = 2
BITS_PER_ROW = 16
# 2**26 bits are at most 2**20 words of 64 bits, about 32 MB as a hashed relation.
MAX_BITS = 1 << 26


def wanted_bits(rows: int) -> int:
    return 1 << max(10, math.ceil(math.log2(BITS_PER_ROW * max(rows, 1))))


def filter_bits(rows: int, max_bits: int = MAX_BITS) -> int:
    return min(max_bits, wanted_bits(rows))


def _cells(key: str, bits: int) -> list[Column]:
    return [F.pmod(F.xxhash64(F.col(key), F.lit(i)), F.lit(bits)) for i in range(HASHES)]


def _words(keys: DataFrame, bits: int, key: str, least: int) -> DataFrame:
    cells = keys.select(F.explode(F.array(*_cells(key, bits))).alias("cell"))
    hit = cells.groupBy("cell").count().where(F.col("count") >= least)
    return hit.groupBy(F.expr("cell div 64").alias("word")).agg(
        F.bit_or(F.expr("shiftleft(1L, cast(cell % 64 as int))")).alias("mask")
    )


def repeated_cells(keys: DataFrame, bits: int, key: str) -> DataFrame:
    """The filter of keys that may occur again: cells where at least two rows fell."""
    return _words(keys, bits, key, 2)


def set_cells(keys: DataFrame, bits: int, key: str) -> DataFrame:
    """The filter of the keys themselves: cells where any row fell."""
    return _words(keys, bits, key, 1)


def split_by_filter(frame: DataFrame, words: DataFrame, bits: int, key: str, max_bits: int = MAX_BITS) -> tuple[DataFrame, DataFrame]:
    """Rows whose key is surely not in the filter, and rows whose key may be.

    A filter above ``max_bits`` is no broadcast: its words are joined like any
    table, which shuffles the rows by word, so these should be narrow.
    """
    own = frame.columns
    for i, cell in enumerate(_cells(key, bits)):
        side = words.select(F.col("word").alias(f"_bloom_word{i}"), F.col("mask").alias(f"_bloom_mask{i}"))
        side = F.broadcast(side) if bits <= max_bits else side
        frame = frame.withColumn(f"_bloom_cell{i}", cell)
        frame = frame.join(side, F.expr(f"_bloom_cell{i} div 64 = _bloom_word{i}"), "left")
    tests = [
        f"coalesce(shiftrightunsigned(_bloom_mask{i}, cast(_bloom_cell{i} % 64 as int)) & 1L, 0L) = 1L" for i in range(HASHES)
    ]
    maybe = F.expr(" AND ".join(tests))
    return frame.where(~maybe).select(*own), frame.where(maybe).select(*own)
