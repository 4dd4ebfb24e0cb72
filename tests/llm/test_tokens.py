from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tillbook.llm import token_counts, tokens
from tillbook.llm.queries import QUERIES
from tillbook.llm.rows import near_keys
from tillbook.session import work_path, written

from .conftest import ODD

BYTES = tokens.tokenizer_path("byte_bpe_50k.json")
WORDS = tokens.tokenizer_path("word_bpe_49k.json")
TEXTS = st.lists(
    st.sampled_from(["a", "The", " ", "  ", "\n", "\t", "'s", "12", "é", "é", "́", "\x1c", "\xa0", "日", "ΑΣ", "<|endoftext|>", "!!", "\r\n", "👍"]),
    max_size=12,
).map("".join)


@given(TEXTS)
@settings(max_examples=500, deadline=None)
def test_words_one_by_one_equal_the_whole_text(text):
    counter, encoder = tokens.spaced_counter(BYTES), tokens.word_encoder(WORDS)
    assert counter.count(text) == counter.whole(text)
    assert encoder.ids(text) == encoder.whole(text)


def check(rows, found):
    library = Tokenizer.from_file(BYTES)
    expected = [(i, len((t or "").encode()), len(library.encode(t or "", add_special_tokens=False).ids)) for i, t in rows]
    assert sorted(((r.doc_id, r.n_bytes, r.n_tokens) for r in found), key=repr) == sorted(expected, key=repr)
    assert all(r.over_limit == (r.n_tokens > 1024) for r in found)


def test_query_and_odd_rows(spark, sf_dir, odd, frame):
    check(ODD, token_counts.token_counts(odd, BYTES, work_path(spark, "cache")).collect())
    assert token_counts.token_counts(frame([]), BYTES, work_path(spark, "cache")).count() == 0
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    check(rows, QUERIES["op4_cached_token_counts"](spark, sf_dir).collect())


def test_only_misses_are_encoded_and_appended(spark, frame):
    cache = work_path(spark, "cache")
    first = frame([(1, "a b"), (2, "a b"), (3, "c")])
    token_counts.token_counts(first, BYTES, cache).collect()
    assert spark.read.parquet(cache).count() == 2
    # A planted count shows that stored texts are looked up, not encoded again.
    stored = spark.read.parquet(cache).collect()
    planted = work_path(spark, "cache")
    spark.createDataFrame([(r.digest, r.version, 99) for r in stored], token_counts.CACHE).write.parquet(planted)
    found = token_counts.token_counts(frame([(1, "a b"), (4, "new text")]), BYTES, planted).collect()
    assert {r.doc_id: r.n_tokens for r in found} == {1: 99, 4: 2}
    assert spark.read.parquet(planted).count() == 3
    other = token_counts.token_counts(frame([(1, "a b")]), WORDS, planted).collect()
    assert other[0].n_tokens == 2, "another tokenizer's counts are not taken"


def test_stored_texts_are_not_shuffled(spark, frame):
    """With all texts stored no row reaches the shuffle, and missing ones alone do otherwise."""
    cache, text = work_path(spark, "cache"), F.col("text")
    rows = [(i, f"text {i} " * 50) for i in range(400)]
    token_counts.token_counts(frame(rows), BYTES, cache).collect()
    stored = token_counts.read_cache(spark, cache, token_counts.tokenizer_version(BYTES))

    def passing(rows):
        digest = F.unhex(F.sha2(text.cast("binary"), 256)).alias("digest")
        keyed = frame(rows).select("doc_id", text.alias("content"), digest)
        missing = written(keyed.select("digest").distinct().join(stored, "digest", "left_anti"), "missing")
        return near_keys(keyed, missing, "digest")[1].count(), token_counts.missing_texts(keyed, keyed, stored).count()

    assert passing(rows) == (0, 0)
    some, found = passing(rows + [(900 + i, f"new {i % 3}") for i in range(9)])
    assert found == 3 and 9 <= some <= 30


def test_memory_is_bounded(monkeypatch):
    monkeypatch.setattr(tokens, "MEMORY_WORDS", 10)
    encoder = tokens.WordEncoder(WORDS)
    text = " ".join(f"word{i}" for i in range(200))
    assert encoder.ids(text) == encoder.whole(text)
    assert len(encoder.memory) <= 10
