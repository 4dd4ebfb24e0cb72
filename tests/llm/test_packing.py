import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from tillbook.llm import packing, tokens
from tillbook.llm.queries import QUERIES

from .conftest import ODD

PATH = tokens.tokenizer_path("word_bpe_49k.json")


def check(rows, found, length=2048):
    """Every piece is that of the library, and sequences are gapless and within bounds."""
    library = Tokenizer.from_file(PATH)
    expected = []
    for i, t in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids + [0]
        for piece, at in enumerate(range(0, len(ids), length)):
            part = ids[at : at + length]
            expected.append((i, piece, at, len(part), zlib.crc32(np.array(part, "<u4").tobytes())))
    cut = [(r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in found]
    assert sorted(cut, key=repr) == sorted(expected, key=repr)
    sequences = {}
    for r in found:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in sequences.values():
        at = 0
        for offset, size in sorted(parts):
            assert offset == at
            at += size
        assert at <= length
    return len(sequences), sum(r.length for r in found)


def test_query(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    sequences, total = check(rows, QUERIES["op3_vector_packing"](spark, sf_dir).collect())
    assert sequences <= 1.03 * total / 2048 + 1


def test_odd_rows_in_small_groups(odd, frame):
    check(ODD, packing.packed(odd, PATH, group=4).collect())
    tight = packing.packed(odd, PATH, packing.Capacity(2048, 2, 1000 * 1000)).collect()
    assert max(r.length for r in tight) == 1000
    assert packing.packed(frame([]), PATH).count() == 0


@pytest.mark.parametrize("rule", ["norm", "dot"])
def test_every_constraint_holds(rule):
    random = np.random.default_rng(3)
    lengths = np.sort(random.integers(1, 900, 3000))[::-1]
    capacity = packing.Capacity(1000, 5, 820_000)
    sequence, offset = packing.best_fit(lengths, capacity, rule)
    for s in set(sequence.tolist()):
        own = lengths[sequence == s]
        assert own.sum() <= 1000 and len(own) <= 5 and (own**2).sum() <= 820_000
    assert len(set(sequence.tolist())) < 1.25 * max(lengths.sum() / 1000, len(lengths) / 5, (lengths**2).sum() / 820_000)


def test_too_long_a_piece_is_an_error():
    with pytest.raises(ValueError, match="exceeds"):
        packing.best_fit(np.array([950]), packing.Capacity(1000, 5, 820_000))


def test_best_fit_takes_the_tightest_place():
    sequence, offset = packing.best_fit(np.array([7, 6, 4, 3]), packing.Capacity(10, 10, 100))
    assert sequence.tolist() == [0, 1, 1, 0] and offset.tolist() == [0, 0, 6, 7]


def test_large_ids_beside_a_null_one(spark, frame):
    """An id beyond a double's reach stays what it is, in the operator and in the pipeline's last stage."""
    import corpus_pipeline

    rows = [((1 << 60) + 1, "one two"), ((1 << 60) + 3, "three"), (None, "four"), (None, None), (-(1 << 62) - 1, "five " * 3000)]
    for found in (packing.packed(frame(rows), PATH), corpus_pipeline.pack(spark, frame(rows), "")):
        check(rows, found.collect())


def plain_fit(lengths, capacity, rule, weights):
    """Best fit piece by piece over a list of open sequences, straight from the rule."""
    full, scale = capacity.vector(), [w / c**2 for w, c in zip(weights, capacity.vector(), strict=True)]
    left, places = [], []
    for length in lengths:
        need = (length, 1, length**2)
        best = None
        for at, now in enumerate(left):
            if all(a >= b for a, b in zip(now, need, strict=True)):
                by = [(a - b) ** 2 if rule == "norm" else a * b for a, b in zip(now, need, strict=True)]
                cost = sum(s * x for s, x in zip(scale, by, strict=True))
                if best is None or cost < best[0] * (1 - 1e-12):
                    best = cost, at
        if best is None:
            left.append(list(full))
            best = 0, len(left) - 1
        places.append((best[1], full[0] - left[best[1]][0]))
        left[best[1]] = [a - b for a, b in zip(left[best[1]], need, strict=True)]
    return places, len(left)


@pytest.mark.parametrize("rule", ["norm", "dot"])
def test_choices_equal_a_plain_best_fit(rule):
    """Under three binding capacities; sequences of equal cost may change places."""
    random = np.random.default_rng(8)
    lengths = np.sort(random.integers(1, 400, 120))[::-1]
    capacity = packing.Capacity(1000, 6, 300_000)
    sequence, offset = packing.best_fit(lengths, capacity, rule)
    places, count = plain_fit(lengths.tolist(), capacity, rule, packing.WEIGHTS)
    loads = lambda names: sorted(sorted(int(n) for n, s in zip(lengths, names, strict=True) if s == own) for own in set(names))
    assert loads([p for p, _ in places]) == loads(sequence.tolist())
    assert len(set(sequence.tolist())) == count
