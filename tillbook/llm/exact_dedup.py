"""Exact duplicates behind a Bloom filter of possibly repeated texts.

The first pass hashes every text to two cells of a fixed bit array and counts
rows by cell. Cells hit at least twice are the filter: a text whose two cells
are not both in it occurs once and passes straight through. Only the other rows
are shuffled by their digest, so a false positive costs a shuffled row, never a
wrong result. The filter has 16 bits for each row. Up to ``max_bits`` it is
broadcast; a larger one is joined, by its words, to rows of a digest and two
numbers. Texts themselves are read where they lie: rows that go are told by a
second filter, of those rows, and only what passes it is joined.

Rules for odd input: a null text is empty, all empty texts are one group. A
null doc_id sorts before every number. Rows repeated with one doc_id share its
fate, unless ``deduplicate`` is asked for one row of each text. Columns besides
doc_id and text are carried, whatever their names. An empty table gives an empty
result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillbook.llm.batches import text_or_empty
from tillbook.llm.bloom import MAX_BITS, repeated_cells, split_by_filter, wanted_bits
from tillbook.llm.rows import without
from tillbook.session import written

def text_digest(text: Column) -> Column:
    """SHA-256 of the text without white space."""
    return F.sha2(F.regexp_replace(text, r"[\x20\x09-\x0D]+", "").cast("binary"), 256)


def _digests(docs: DataFrame) -> DataFrame:
    text = text_or_empty()
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_digest(text).alias("text_sha256"), F.char_length(text).cast("long").alias("n_points"))


def _groups(repeated: DataFrame) -> DataFrame:
    """Digests that do occur again, with the row that stays and the number of rows."""
    best = F.min_by("doc_id", F.struct(-F.col("n_points"), F.col("doc_id")))
    groups = repeated.groupBy("text_sha256").agg(best.alias("keep_id"), F.count("*").alias("group_size"))
    return groups.where("group_size >= 2")


def _passes(docs: DataFrame, max_bits: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """All narrow rows, those whose text occurs once, and those whose text may occur again."""
    digests = written(_digests(docs), "digests")
    bits = wanted_bits(digests.count())
    words = written(repeated_cells(digests, bits, "text_sha256"), "filter")
    return digests, *split_by_filter(digests, words, bits, "text_sha256", max_bits)


def exact_groups(docs: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256."""
    _, once, maybe = _passes(docs, max_bits)
    # Written, so that the hot digests of the left side can be split in the join.
    groups = written(_groups(maybe), "groups")
    shared = maybe.join(groups, "text_sha256", "left").select(
        "doc_id",
        F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"),
        "text_sha256",
    )
    alone = once.select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), "text_sha256")
    kept = F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept")
    return shared.unionByName(alone).select("doc_id", "keep_id", "group_size", kept, "text_sha256")


def deduplicate(docs: DataFrame, max_bits: int = MAX_BITS, by_row: bool = False) -> DataFrame:
    """The documents that stay, with all their columns; those that surely stay are not shuffled.

    With ``by_row`` exactly one row of each text stays, also where rows share
    the doc_id that stays, null included: the longest, or one of those.
    """
    maybe = _passes(docs, max_bits)[2]
    groups = written(_groups(maybe), "groups")
    names = ["doc_id", "text_sha256", "n_points"]
    kinds = written(maybe.groupBy(*names).agg(F.count("*").alias("rows")).join(groups, "text_sha256"), "kinds")
    stays = F.col("doc_id").eqNullSafe(F.col("keep_id"))
    if by_row:
        most = kinds.where(stays).groupBy("text_sha256").agg(F.max("n_points").alias("most"))
        kinds, stays = kinds.join(most, "text_sha256"), stays & (F.col("n_points") == F.col("most"))
    text = text_or_empty()
    own = dict(zip(names, (F.col("doc_id").cast("long"), text_digest(text), F.char_length(text).cast("long")), strict=True))
    return without(docs, kinds.withColumn("stays", stays), own, repeats=not by_row)
