import re
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tillbook.llm import quality_rules as Q
from tillbook.llm.queries import QUERIES

from .conftest import ODD


def plain_counts(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    times = Counter(windows)
    inside = {i + k for i, w in enumerate(windows) if times[w] > 1 for k in range(3)}
    return (
        len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)),
        sum(x in lines[:i] for i, x in enumerate(lines)), len(inside),
    )


@given(st.text(alphabet=" \n\tab#|é\x0b\x1c", max_size=80))
@settings(max_examples=300, deadline=None)
def test_counts(text):
    assert tuple(Q.votes(text)[0].values()) == plain_counts(text)


def test_odd_rows(odd, frame):
    found = {r.doc_id: r for r in Q.quality(odd).collect()}
    for i, t in ODD:
        r = found[i]
        n, chars, symbols, lines, repeats = plain_counts(t)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (n, chars, symbols, lines, repeats)
        assert r.base_failed == (n < 50 or 100 * repeats > 50 * n)
        assert not (r.kept and r.base_failed)
    assert Q.quality(odd).count() == len(ODD)
    assert Q.quality(frame([])).count() == 0
    assert Q.keep_good(frame([])).count() == 0


def test_query_and_filter_agree_with_the_labels(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = {r.doc_id: r for r in QUERIES["op8_weak_supervision"](spark, sf_dir).collect()}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    judged = [(q, found[i].kept) for i, q in labels.items() if q is not None and not found[i].base_failed]
    right = sum(kept == (q == 1) for q, kept in judged)
    assert right >= 0.9 * len(judged)
    kept = Q.keep_good(docs)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {i for i, r in found.items() if r.kept}


def test_estimation_finds_planted_rates():
    """Patterns drawn from known rates give a model that separates them."""
    import numpy as np

    random = np.random.default_rng(5)
    names, truth = [], []
    for _ in range(4000):
        good = random.random() < 0.8
        rates = [(0.02, 0.9) if r.good else (0.01, 0.0) for r in Q.RULES] if good else [(0.5, 0.2) if r.good else (0.4, 0.0) for r in Q.RULES]
        names.append("".join("-" if (u := random.random()) < low else "+" if u < low + high else "0" for low, high in rates))
        truth.append(good)
    model = Q.estimate(Counter(names))
    right = sum((model.posterior(p) >= 0.5) == t for p, t in zip(names, truth, strict=True))
    assert right > 0.95 * len(names)
    assert model.good_share == pytest.approx(0.8, abs=0.05)
    assert Q.estimate({}).good_share == Q.START_SHARE
