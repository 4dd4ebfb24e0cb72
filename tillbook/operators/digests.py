"""Collisions of the weak text digest.

A word's digest is one printable character: the sum of the low bytes of its
UTF-16 units, modulo 94, plus 33. A text's digest is one such character per
space-separated token.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _low_bytes(char: Column) -> Column:
    """Low bytes of the UTF-16 units of one character, added up."""
    code = F.ascii(char)
    pair = F.shiftright(code - 0x10000, 10).bitwiseAND(F.lit(255)) + code.bitwiseAND(F.lit(255))
    return F.when(code < 0x10000, code.bitwiseAND(F.lit(255))).otherwise(pair)


def word_digest(word: Column) -> Column:
    total = F.aggregate(F.split(word, ""), F.lit(0), lambda sum_, c: sum_ + _low_bytes(c))
    return F.char(total % 94 + 33)


def text_digest(text: Column) -> Column:
    return F.array_join(F.transform(F.split(text, " "), word_digest), "")


def distinct_words(documents: DataFrame, column: str) -> DataFrame:
    return documents.select(F.explode(F.split(column, " ")).alias("word")).distinct()


def word_collisions(documents: DataFrame, column: str) -> DataFrame:
    """Words behind each digest shared by several: how many, first and last.

    There are 94 digests, so words are only ever counted, never gathered.
    """
    words = distinct_words(documents, column).withColumn("digest", word_digest(F.col("word")))
    return (
        words.groupBy("digest")
        .agg(F.count("*").alias("words"), F.min("word").alias("first_word"), F.max("word").alias("last_word"))
        .where(F.col("words") > 1)
    )


def text_collisions(documents: DataFrame, key: str, column: str) -> DataFrame:
    """Digests shared by several texts, keyed by a strong hash of the digest.

    A digest is as long as its text has words; the hash keeps the shuffle small.
    """
    hashed = documents.select(key, F.sha2(text_digest(F.col(column)), 256).alias("digest_hash"))
    return hashed.groupBy("digest_hash").agg(F.count("*").alias("texts"), F.min(key).alias("first_key")).where(
        F.col("texts") > 1
    )
