import zlib

import numpy as np
import pytest

from tillbook.llm import quality_classifier as C
from tillbook.llm.queries import QUERIES

from .conftest import ODD


def test_query_on_rows_held_out(spark, sf_dir):
    sf_dir = sf_dir.replace("sf0.001", "sf0.01")
    found = {r.doc_id: r for r in QUERIES["op1_random_indexing_quality"](spark, sf_dir).collect()}
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    assert len(found) == docs.count()
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    for i, r in found.items():
        assert r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3)
    apart = [(found[i].score, q) for i, q in labels.items() if found[i].held_out]
    good, bad = [s for s, q in apart if q == 1], [s for s, q in apart if q == 0]
    assert np.mean([(g > b) + 0.5 * (g == b) for g in good for b in bad]) > 0.9
    assert np.mean([s >= 0.3 for s in good]) > 0.97


def test_odd_rows(odd, frame, spark):
    labels = spark.createDataFrame([(1, 1), (2, 0), (4, 1), (5, None), (7, 1), (8, 0), (None, 1), (7, 1)], "doc_id long, quality int")
    found = C.classify(odd, labels).collect()
    assert len(found) == len(ODD) and all(0 <= r.score <= 1 for r in found)
    assert C.classify(frame([]), labels).count() == 0
    none = C.classify(odd, labels.where("quality > 5")).collect()
    assert {r.score for r in none} == {0.5}
    one = C.classify(odd, labels.where("quality = 1")).collect()
    assert len({r.score for r in one}) == 1 and one[0].predicted == 1


def test_labels_reach_the_fit_from_rows_not_held_out_only(odd, spark):
    labels = spark.createDataFrame([(i, 1) for i in range(1, 13)], "doc_id long, quality int")
    rows = C.fitting_rows(odd, labels, 5, 0, 20_000).collect()
    assert rows and all(zlib.crc32(str(r.doc_id).encode()) % 5 for r in rows)
    assert len({r.doc_id for r in C.fitting_rows(odd, labels, 5, 0, 3).collect()}) <= 3


def test_context_sums_equal_a_plain_walk():
    texts = ["The cat sat.", None, "", "ONE two two two", "é 日本 12 12"]
    places, signs = C.index_vectors()
    expected = np.zeros((C.BUCKETS, C.DIMENSIONS))
    for text in texts:
        ids = C.text_tokens(text)
        for a, b in zip(ids, ids[1:]):
            for word, near in ((a, b), (b, a)):
                expected[word, places[near]] += signs[near]
    assert np.allclose(C.context_sums(texts).reshape(expected.shape), expected)


def test_pooling_is_the_mean_and_memory_is_bounded(monkeypatch):
    vectors = C.word_vectors(C.context_sums(["a b c d", "B B !"]))
    text = " ".join(f"w{i} w{i}" for i in range(500)) + " Some! text"
    mean = vectors[C.text_tokens(text)].mean(0)
    assert np.allclose(C.Pooler(vectors).pooled(text), mean, atol=1e-4)
    monkeypatch.setattr(C, "MEMORY_WORDS", 10)
    assert np.allclose(C.Pooler(vectors).pooled(text), mean, atol=1e-4)
    assert not C.Pooler(vectors).pooled(None).any()


def test_temperature_makes_overconfident_scores_honest():
    random = np.random.default_rng(1)
    true = random.normal(0, 1.5, 20_000)
    y = (random.random(20_000) < 1 / (1 + np.exp(-true))).astype(float)
    assert C.fit_temperature(true * 4, y) == pytest.approx(4, rel=0.1)
