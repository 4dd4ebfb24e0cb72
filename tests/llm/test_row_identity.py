"""Null doc_ids and ids on two texts: every row is judged by itself."""

import random

import corpus_pipeline
import pytest

from tillbook.llm import near_copies, pii, simhash_dedup


def text(seed, changed=False):
    words = [f"w{seed}x{i}" for i in range(300)]
    if changed:
        words[150] = "new"
    return " ".join(words)


# Without id: a copy of 5, a clean text, and two alike. The id 8: a copy of 5 and a clean text.
NEAR = [
    (5, text(1)), (None, text(1, True)), (None, text(2)), (None, text(3)), (None, text(3, True)), (8, text(1, True)), (8, text(4)),
]


@pytest.mark.parametrize("dedup", [near_copies.deduplicate, lambda d: simhash_dedup.deduplicate(d, count=8)])
def test_near_dedup_drops_no_unlinked_row(frame, dedup):
    kept = {(r.doc_id, r.text) for r in dedup(frame(NEAR)).collect()}
    assert {(5, text(1)), (None, text(2)), (8, text(4))} <= kept
    assert len(kept) == 4 and len(kept & {(None, text(3)), (None, text(3, True))}) == 1


def test_one_row_stays_of_rows_equal_in_id_and_text(spark, frame):
    rows = [(None, text(1)), (None, text(1)), (3, text(2)), (3, text(2)), (3, text(2) + " "), (None, text(5)), (4, text(6)), (4, text(7))]
    for stage in (corpus_pipeline.drop_copies, corpus_pipeline.drop_near_copies):
        found = [(r.doc_id, r.text.strip()) for r in stage(spark, frame(rows), "").collect()]
        assert sorted(found, key=repr) == sorted({(i, t.strip()) for i, t in rows}, key=repr)
    assert (3, text(2) + " ") in [(r.doc_id, r.text) for r in corpus_pipeline.drop_copies(spark, frame(rows), "").collect()]


def test_added_spans_stay_with_their_own_text(frame):
    rows = [(i, f"words contact=user{i}@mail.example.com more words {i}") for i in range(30)]
    pick = random.Random(1)
    for i in (None, 100):
        rows += [(i, "words contact=handle_4711x more"), (i, "a clean text with nothing to be found in it"), (i, "")]
    pick.shuffle(rows)
    spans = {(r.doc_id, r.spans) for r in pii.find(frame(rows)).collect() if r.doc_id in (None, 100)}
    assert spans == {(None, "id:14:26"), (None, ""), (100, "id:14:26"), (100, "")}
    assert sum(r.n_id for r in pii.find(frame(rows)).collect()) == 2
    texts = [r.text for r in pii.mask(frame(rows)).collect() if r.doc_id in (None, 100)]
    assert sorted(texts) == sorted(["words contact=[ID] more", "a clean text with nothing to be found in it", ""] * 2)
