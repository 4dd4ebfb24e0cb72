"""Token counts through a cache of digests.

A text's digest and the digest of the tokenizer's file name a stored count.
Texts without one are encoded, each distinct text once, and their counts are
appended to the cache. A hit costs a narrow join of digests; its text stays
where it is read, behind a Bloom filter of the missing digests. Copies of a text
are reduced inside each task before the shuffle, so a text on a third of all
rows reaches the other side a few times only.

The normalised content is the text as it is, in UTF-8: this tokenizer has no
normaliser, so any change could change the count. A null text is empty.

Rules for odd input: empty texts count zero tokens. Repeated rows each give a
row. A null doc_id is carried. Extra columns are ignored. An empty table gives
an empty result. Runs that append the same digest at the same time store equal
counts, of which a reader takes one.
"""

from __future__ import annotations

import hashlib
from pathlib import Path

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillbook.llm import tokens
from tillbook.llm.batches import map_lists, text_or_empty
from tillbook.llm.rows import near_keys
from tillbook.session import written

LIMIT = 1024
CACHE = "digest binary, version string, n_tokens long"


def tokenizer_version(path: str) -> str:
    return hashlib.sha256(Path(path).read_bytes()).hexdigest()


def read_cache(spark: SparkSession, folder: str, version: str) -> DataFrame:
    """Stored counts of one tokenizer version; none if there is no cache yet."""
    try:
        stored = spark.read.schema(CACHE).parquet(folder)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        stored = spark.createDataFrame([], CACHE)
    counts = stored.where(F.col("version") == version)
    return counts.groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))


def missing_texts(keyed: DataFrame, digests: DataFrame, stored: DataFrame) -> DataFrame:
    """Each distinct text without a stored count, once.

    What is missing is found on digests alone. Texts that are surely stored are
    left out where they are read; the others are reduced to one a digest inside
    each task, then shuffled.
    """
    missing = written(digests.select("digest").distinct().join(stored, "digest", "left_anti"), "missing")
    maybe = near_keys(keyed.select("digest", "content"), missing, "digest")[1]
    return maybe.groupBy("digest").agg(F.first("content").alias("content")).join(missing, "digest", "left_semi")


def encode(texts: DataFrame, path: str) -> DataFrame:
    version = tokenizer_version(path)

    def run(columns: dict[str, list]) -> dict[str, list]:
        counter = tokens.spaced_counter(path)
        counts = [counter.count(t) for t in columns["content"]]
        return {"digest": columns["digest"], "version": [version] * len(counts), "n_tokens": counts}

    return map_lists(texts.select("digest", "content"), run, CACHE)


def token_counts(docs: DataFrame, path: str, cache: str, limit: int = LIMIT) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_tokens, over_limit; the cache folder grows by the misses."""
    spark, version = docs.sparkSession, tokenizer_version(path)
    text = text_or_empty()
    digest = F.unhex(F.sha2(text.cast("binary"), 256)).alias("digest")
    keyed = docs.select("doc_id", text.alias("content"), digest)
    narrow = written(docs.select("doc_id", digest, F.octet_length(text).cast("long").alias("n_bytes")), "digests")
    encode(missing_texts(keyed, narrow, read_cache(spark, cache, version)), path).write.mode("append").parquet(cache)
    # Written, so that a digest on many rows can be split in the last join.
    stored = written(read_cache(spark, cache, version).join(narrow.select("digest").distinct(), "digest", "left_semi"), "counts")
    counted = narrow.join(stored, "digest")
    return counted.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
