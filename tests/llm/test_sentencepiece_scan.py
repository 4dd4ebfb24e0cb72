import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tillbook.llm import sentencepiece_scan as S
from tillbook.llm import tokens
from tillbook.llm.queries import QUERIES

from .conftest import ODD

PATH = tokens.tokenizer_path("piece_bpe_32k.model")
TEXTS = st.lists(st.sampled_from(["the", "thing", "a", "é", " ", "  ", "\n", "▁", "日本", "👍", "1", "ing", "zzz", "<s>", "<0x0A>"]), max_size=25).map("".join)


@given(TEXTS, st.integers(2, 30))
@settings(max_examples=200, deadline=None)
def test_any_cut_gives_the_library_s_ids(text, size):
    model = S.pieces(PATH)
    whole = model.lib.normalize(text)
    if not whole:
        assert model.lib.encode(text) == []
        return
    count, chunks = -(-len(whole) // size), []
    for number in range(count):
        low, high = number * size, min(len(whole), (number + 1) * size)
        left = max(0, low - model.longest - 1)
        chunks.append(S.Chunk(model, whole[left : high + model.longest], low - left, high - left, number == count - 1))
    path = S.states_between([c.matrix() for c in chunks], S.START, S.STOP)
    ids = np.concatenate([c.backtrace(a, b) for c, a, b in zip(chunks, path, path[1:])])
    assert ids.tolist() == model.lib.encode(text)
    assert model.spell(ids) == whole.encode()


def test_product_is_associative():
    a = {(0, 1): {(0, 2): -1.0, (1, 3): -2.0}}
    b = {(0, 2): {(0, 5): -4.0}, (1, 3): {(0, 5): -1.0, (2, 5): 0.0}}
    c = {(0, 5): {S.STOP: -1.0}, (2, 5): {S.STOP: -7.0}}
    assert S.multiply(S.multiply(a, b), c) == S.multiply(a, S.multiply(b, c)) == {(0, 1): {S.STOP: -4.0}}
    assert S.states_between([a, b, c], (0, 1), S.STOP) == [(0, 1), (1, 3), (0, 5), S.STOP]


def check(rows, encoded):
    library = S.pieces(PATH).lib
    expected = []
    for i, t in rows:
        ids = library.encode(t or "")
        expected.append((i, len(ids), sum(ids), sum(k * x for k, x in enumerate(ids, 1)), True))
    found = [(r.doc_id, r.n_tokens, r.id_sum, r.id_place_sum, r.decoded) for r in S.summary(encoded).collect()]
    assert sorted(found, key=repr) == sorted(expected, key=repr)


@pytest.mark.parametrize("chunk", [64, S.CHUNK])
def test_odd_rows(frame, chunk):
    rows = ODD + [(50, "thething" * 500), (51, "日本語" * 300), (50, "thething" * 500)]
    encoded = S.encode(frame(rows), PATH, chunk)
    check(rows, encoded)
    joined = {}
    for r in sorted(encoded.collect(), key=lambda r: (r.row, r.chunk)):
        joined[r.row] = joined.get(r.row, b"") + bytes(r.ids)
    library = S.pieces(PATH).lib
    expected = sorted(np.array(library.encode(t or ""), "<i4").tobytes() for _, t in rows)
    assert sorted(joined.values()) == expected
    assert S.summary(S.encode(frame([]), PATH, chunk)).count() == 0


def test_query(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    library = S.pieces(PATH).lib
    found = {r.doc_id: r for r in QUERIES["op9_sentencepiece_scan"](spark, sf_dir).collect()}
    assert len(found) == len(rows)
    for i, t in rows:
        ids = library.encode(t or "")
        assert (found[i].n_tokens, found[i].id_sum) == (len(ids), sum(ids)) and found[i].decoded


def test_decode_gives_the_texts_of_the_library(frame):
    """Chunks of a few characters, so that one character's bytes lie in two of them."""
    texts = ["plain words here", "  two  spaces ", "日本語 \U0001F44D \u00e9 x" * 9, "a" * 300, "", None, "\n tab\t", "\U00010348" * 20, "one"]
    docs = frame(list(enumerate(texts)))
    lib = S.pieces(PATH).lib
    for chunk in (7, S.CHUNK):
        found = {r.doc_id: r.text for r in S.decode(S.encode(docs, PATH, chunk)).collect()}
        assert found == {i: lib.decode(lib.encode(t or "")) for i, t in enumerate(texts)}


def test_words_in_one_call_are_those_of_single_calls():
    model = S.pieces(PATH)
    words = ["alpha", "beta", "\u00bd", "\u65e5\u672c", "x" * 50, "\U0001F44D", "..", "a-b"]
    assert model.encoded(words) == [np.array(model.lib.encode(w), "<i4").tobytes() for w in words]


def test_a_long_normalised_text_of_a_short_one_is_one_chunk(spark, frame, monkeypatch):
    """Texts are parted by their own length, so what the normaliser adds makes no second chunk."""
    found = S.encode(frame([(1, "a b " * 4), (2, "a b " * 5), (3, "abcdefg" * 40)]), PATH, 17).collect()
    assert {(r.doc_id, r.chunks) for r in found} == {(1, 1), (2, 2), (3, 17)}
    assert len({r.row for r in found}) == 3
