"""Rows named by what they hold, so that null and shared ids name no row but their own.

A row is known by its doc_id and the digest of its text. Rows equal in both are
copies of each other and counted, never told apart.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillbook.llm.batches import text_or_empty
from tillbook.llm.bloom import filter_bits, set_cells, split_by_filter
from tillbook.session import written


def text_key(column: str = "text") -> Column:
    """SHA-256 of the whole text, 32 bytes; a null text is empty."""
    return F.unhex(F.sha2(text_or_empty(column).cast("binary"), 256))


def whole(docs: DataFrame, keys: dict[str, Column]) -> DataFrame:
    """Rows as one column ``row``, so that keys beside it clash with no name inside; ``select("row.*")`` undoes it."""
    return docs.select(F.struct("*").alias("row"), *[c.alias(n) for n, c in keys.items()])


def near_keys(rows: DataFrame, keys: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Rows whose ``key`` is surely not among ``keys``, and the others, which alone need a join.

    A Bloom filter of the keys is tested where the rows are read, so wide rows
    that match nothing are not shuffled. Its size is bounded; beyond that more
    rows pass to the join, with the same result.
    """
    bits = filter_bits(keys.count())
    return split_by_filter(rows, written(set_cells(keys, bits, key), "key-filter"), bits, key)


def without(docs: DataFrame, kinds: DataFrame, keys: dict[str, Column], repeats: bool = False) -> DataFrame:
    """The documents without the rows that go by ``kinds`` (columns of ``keys``, ``stays`` and ``rows``, how many are equal).

    Of equal rows that stay one does, with ``repeats`` all. Rows not in ``kinds``
    stay. Only rows that may have to go are shuffled.
    """
    names = list(keys)
    hit = kinds.where("NOT stays" if repeats else "NOT stays OR rows > 1")
    hit = written(hit.select(*[F.col(n).alias(f"own_{n}") for n in names], "stays", F.xxhash64(*names).alias("row_key")), "marked")
    keyed = whole(docs, keys).withColumn("row_key", F.xxhash64(*names))
    alone, others = near_keys(keyed, hit, "row_key")
    same = [F.col(n).eqNullSafe(F.col(f"own_{n}")) for n in names]
    others = others.join(hit.drop("row_key"), same, "left")
    out = alone.select("row.*").union(others.where("stays IS NULL").select("row.*"))
    return out if repeats else out.union(others.where("stays").dropDuplicates(names).select("row.*"))


def one_row_each(docs: DataFrame, grouped: DataFrame, repeats: bool = False) -> DataFrame:
    """The documents without all rows but one of each group of ``grouped`` (doc_id, text_key, group).

    The row with the smallest doc_id stays, a null one last, then that with the
    smallest text_key; with ``repeats`` its equals in both stay with it. Documents in
    no group stay as they are, and are not shuffled.
    """
    kinds = written(grouped.groupBy("doc_id", "text_key", "group").agg(F.count("*").alias("rows")), "kinds")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_key"))
    kept = written(kinds.groupBy("group").agg(first.alias("kept")), "kept")
    stays = F.col("doc_id").eqNullSafe(F.col("kept.doc_id")) & (F.col("text_key") == F.col("kept.text_key"))
    marked = kinds.join(kept, "group").withColumn("stays", stays)
    return without(docs, marked, {"doc_id": F.col("doc_id").cast("long"), "text_key": text_key()}, repeats)
