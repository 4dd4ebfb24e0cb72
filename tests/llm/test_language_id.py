import zlib

import numpy as np

from tillbook.llm import language_id as L
from tillbook.llm.queries import QUERIES

from .conftest import ODD

SENTENCES = {
    "en": "the quick brown fox jumps over the lazy dog while we watch with wonder",
    "de": "der schnelle braune fuchs springt über den faulen hund und wir schauen zu",
    "es": "el rápido zorro marrón salta sobre el perro perezoso mientras miramos",
}


def test_query_on_rows_held_out(spark, sf_dir):
    sf_dir = sf_dir.replace("sf0.001", "sf0.01")
    found = QUERIES["op6_language_bitmask"](spark, sf_dir)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang")
    rows = found.join(docs, "doc_id").collect()
    assert len(rows) == docs.count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in rows)
    apart = [r.lang == r.lang_pred for r in rows if r.held_out]
    assert sum(apart) >= 0.97 * len(apart)


def test_odd_rows(frame, odd):
    found = L.identify(odd).collect()
    assert len(found) == len(ODD) and {(r.lang_pred, r.score) for r in found} == {("und", 0.0)}
    assert L.identify(frame([])).count() == 0
    rows = [(i, SENTENCES[k] + f" {k}{i}") for i, k in enumerate(list(SENTENCES) * 10)]
    langs = [t.split()[-1][:2] for _, t in rows]
    extra = [(1000, None), (1001, ""), (1002, "123 !!"), (1003, "the dog"), (1004, "日本"), (None, "der hund"), (1003, "the dog")]
    found = L.identify(frame(rows + extra, langs + [None] * len(extra))).collect()
    by_id = {r.doc_id: r for r in found}
    assert len(found) == len(rows) + len(extra)
    assert [by_id[i].lang_pred for i in (1000, 1001, 1002)] == ["und"] * 3
    assert by_id[1003].lang_pred == "en" and by_id[None].lang_pred == "de"
    assert by_id[1004].score == 0 and by_id[1004].lang_pred in SENTENCES


def test_masks_hold_what_the_counts_say(frame):
    """Bits equal a plain count of documents by cell, for more languages than one mask holds."""
    names = [f"l{i:03d}" for i in range(70)]
    rows = [(i, f"shared word{chr(97 + i % 26)}{chr(97 + i // 26)} text") for i in range(140)]
    langs = [names[i % 70] for i in range(140)]
    model = L.train(frame(rows, langs))
    assert model.languages == names and len(model.masks) == 2
    share = np.zeros((70, L.CELLS))
    for (_, text), lang in zip(rows, langs, strict=True):
        share[names.index(lang), np.unique(np.concatenate(L.cells_of(text)))] += 0.5
    best = share.max(0)
    for number in range(70):
        bits = (model.masks[number // L.PLANE] >> np.int64(number % L.PLANE)) & 1
        assert np.array_equal(bits == 1, (share[number] >= L.LEAST_SHARE) & (share[number] >= L.RELATIVE_SHARE * best))
    assert model.predict(rows[3][1])[0] == langs[3]


def test_numbers_that_patterns_take_for_letters_are_none(spark, frame):
    rows = [(1, "\u00bd \u00b2"), (2, "\u2460"), (3, "\u2167"), (4, "12 34 _ !"), (5, None), (6, "the \u00bd"), (8, "the words"), (9, "the words")]
    found = {r.doc_id: (r.lang_pred, r.score) for r in L.identify(frame(rows, ["en"] * len(rows))).collect()}
    assert all(found[i] == ("und", 0.0) for i in (1, 2, 3, 4, 5))
    assert found[6][0] == found[8][0] == "en"
