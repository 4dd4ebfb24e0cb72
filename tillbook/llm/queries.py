"""Registered queries of the operators, each over the whole of its table."""

from __future__ import annotations

from pyspark.sql import functions as F

from tillbook.llm import (
    exact_dedup, hard_negatives, language_id, lexical_search, packing, pii, quality_classifier, quality_rules, repeated_passages,
    sentencepiece_scan, simhash_dedup, token_counts, warc,
)
from tillbook.llm.batches import table
from tillbook.llm.tokens import tokenizer_path
from tillbook.session import work_path


def op1_random_indexing_quality(spark, sf_dir):
    return quality_classifier.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_bootstrapped_pii(spark, sf_dir):
    return pii.find(table(spark, sf_dir, "documents"))


def op3_vector_packing(spark, sf_dir):
    return packing.packed(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))


def op4_cached_token_counts(spark, sf_dir):
    # Each run fills a cache of its own; a standing one is a folder named by its user.
    docs = table(spark, sf_dir, "documents")
    return token_counts.token_counts(docs, tokenizer_path("byte_bpe_50k.json"), work_path(spark, "token-cache"))


def op5_simhash_bktree(spark, sf_dir):
    return simhash_dedup.near_duplicates(table(spark, sf_dir, "documents"))


def op6_language_bitmask(spark, sf_dir):
    return language_id.identify(table(spark, sf_dir, "documents"))


def op7_content_addressed_warc(spark, sf_dir):
    return warc.archive_pages(table(spark, sf_dir, "pages"), work_path(spark, "archive"))


def op8_weak_supervision(spark, sf_dir):
    return quality_rules.quality(table(spark, sf_dir, "documents"))


def op9_sentencepiece_scan(spark, sf_dir):
    encoded = sentencepiece_scan.encode(table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"), keep_ids=False)
    return sentencepiece_scan.summary(encoded)


def op10_bloom_exact_dedup(spark, sf_dir):
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents"))


def op11_reversed_search(spark, sf_dir):
    return lexical_search.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_threshold_negatives(spark, sf_dir):
    vec_id, label = F.col("vec_id"), F.col("label")
    moved = F.when(vec_id % 7 == 0, (label + 1) % 10).otherwise(label)
    return hard_negatives.mine(table(spark, sf_dir, "embeddings"), vec_id % 50 == 0, moved)


def op13_prefix_doubling(spark, sf_dir):
    found = repeated_passages.remove_repeats(table(spark, sf_dir, "documents"))
    total = F.aggregate("removed", F.lit(0).cast("long"), lambda n, run: n + run["size"])
    return found.select(
        "doc_id", "n_bytes", total.alias("n_removed"), F.size("removed").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


QUERIES = {
    "op1_random_indexing_quality": op1_random_indexing_quality,
    "op2_bootstrapped_pii": op2_bootstrapped_pii,
    "op3_vector_packing": op3_vector_packing,
    "op4_cached_token_counts": op4_cached_token_counts,
    "op5_simhash_bktree": op5_simhash_bktree,
    "op6_language_bitmask": op6_language_bitmask,
    "op7_content_addressed_warc": op7_content_addressed_warc,
    "op8_weak_supervision": op8_weak_supervision,
    "op9_sentencepiece_scan": op9_sentencepiece_scan,
    "op10_bloom_exact_dedup": op10_bloom_exact_dedup,
    "op11_reversed_search": op11_reversed_search,
    "op12_threshold_negatives": op12_threshold_negatives,
    "op13_prefix_doubling": op13_prefix_doubling,
}

ORACLES = {
    "op7_content_addressed_warc": """
        WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
        h AS (SELECT page_id, octet_length(b) AS payload_bytes, sha1(b) AS payload_digest, sha256(b) AS k FROM p),
        g AS (SELECT *, max(page_id) OVER (PARTITION BY k) AS last FROM h),
        r AS (SELECT *, payload_bytes >= 1000 AND page_id <> last AS again FROM g)
        SELECT page_id, payload_bytes, payload_digest, CASE WHEN again THEN 'revisit' ELSE 'response' END AS record_type,
            CASE WHEN again THEN last END AS refers_to
        FROM r
    """,
    "op10_bloom_exact_dedup": r"""
        WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
        h AS (SELECT doc_id, length(t) AS n, sha256(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS text_sha256 FROM d),
        g AS (SELECT text_sha256, arg_min(doc_id, (-n, doc_id)) AS keep_id, count(*) AS group_size FROM h GROUP BY 1)
        SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM h JOIN g USING (text_sha256)
    """,
    "op11_reversed_search": r"""
        WITH d AS (
            SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS t FROM documents),
        i AS (
            SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS t FROM benchmark),
        c AS (SELECT doc_id, t, count(*) AS tf FROM d GROUP BY ALL),
        q AS (SELECT item_id, t, count(*) AS times FROM i GROUP BY ALL),
        s AS (SELECT doc_id, sum(tf)::BIGINT AS n FROM c GROUP BY 1),
        a AS (SELECT count(*) AS docs, sum(n)::BIGINT AS l FROM s),
        w AS (SELECT t, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM c, a WHERE t IN (SELECT t FROM q) GROUP BY t, docs),
        m AS (SELECT doc_id, 25 + (75 * n * docs) // l AS m FROM s, a),
        r AS (
            SELECT item_id, doc_id, sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * m)))::BIGINT AS score
            FROM q JOIN w USING (t) JOIN c USING (t) JOIN m USING (doc_id) GROUP BY 1, 2 HAVING score > 0)
        SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank, doc_id, score
        FROM r QUALIFY rank <= 10
    """,
    "op12_threshold_negatives": """
        WITH v AS (
            SELECT vec_id, (CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END)::BIGINT AS label,
                [floor(256 * x::DOUBLE) FOR x IN embedding] AS v
            FROM embeddings
            WHERE label IS NOT NULL AND embedding IS NOT NULL
                AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
        s AS (
            SELECT a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS same, list_dot_product(a.v, c.v)::BIGINT AS score
            FROM v a, v c WHERE a.vec_id % 50 = 0 AND a.vec_id <> c.vec_id),
        p AS (
            SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
            QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
        SELECT anchor_id, positive_id, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id)::INTEGER AS rank,
            vec_id AS negative_id, positive_score, score AS negative_score
        FROM p JOIN s USING (anchor_id)
        WHERE NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
        QUALIFY rank <= 3
    """,
}
