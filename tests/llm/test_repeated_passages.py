import hashlib
import random

import numpy as np
import pytest

from tillbook.llm import repeated_passages
from tillbook.llm.queries import QUERIES

from .conftest import ODD


def order(row):
    return row[0] is None, row[0] or 0


def plain(rows, length=100):
    """Every string of every text in order against all before it; ids are unique, or their texts equal."""
    seen, found = set(), []
    for doc_id, text in sorted(rows, key=order):
        data = (text or "").encode()
        gone = bytearray(len(data))
        for at in range(len(data) - length + 1):
            string = data[at : at + length]
            if string in seen:
                gone[at : at + length] = b"\1" * length
            seen.add(string)
        kept = bytes(b for b, g in zip(data, gone, strict=True) if not g)
        runs = sum(1 for i, g in enumerate(gone) if g and (not i or not gone[i - 1]))
        found.append((doc_id, len(data), sum(gone), runs, hashlib.sha256(kept).hexdigest()))
    return sorted(found, key=repr)


def result(found):
    rows = []
    for r in found.collect():
        runs = [(x.start, x.size) for x in r.removed]
        assert runs == sorted(runs) and all(b[0] > a[0] + a[1] for a, b in zip(runs, runs[1:], strict=False))
        assert len(r.kept) == r.n_bytes - sum(s for _, s in runs)
        rows.append((r.doc_id, r.n_bytes, sum(s for _, s in runs), len(runs), hashlib.sha256(r.kept).hexdigest()))
    return sorted(rows, key=repr)


def corpus(seed, count=120):
    """Texts of shared passages, small edits, runs of one letter and short periods."""
    draw = random.Random(seed)
    words = ["alpha", "beta", "gamma", "delta", "é", "日本", "zz", "and", "the", "of"]
    passages = [" ".join(draw.choices(words, k=draw.randint(3, 60))) for _ in range(12)]
    rows = []
    for i in range(count):
        parts = draw.choices(passages, k=draw.randint(0, 3)) + [" ".join(draw.choices(words, k=draw.randint(0, 40)))]
        if i % 9 == 0:
            parts.append(draw.choice("ab") * draw.randint(50, 300))
        if i % 11 == 0:
            parts.append("xyz" * draw.randint(10, 90))
        draw.shuffle(parts)
        text = list(" ".join(parts))
        for _ in range(draw.randint(0, 2) if text else 0):
            text[draw.randrange(len(text))] = draw.choice("qvw")
        rows.append((i, "".join(text)))
    draw.shuffle(rows)
    return rows


@pytest.mark.parametrize(("length", "first", "seed"), [(100, 32, 1), (100, 32, 2), (100, 8, 3), (40, 8, 4), (24, 16, 5), (30, 32, 6), (100, 64, 7)])
def test_removed_bytes_equal_a_plain_scan(spark, frame, many_blocks, length, first, seed):
    """With one round and with several, in partitions smaller than a group of equal ranks."""
    rows = corpus(seed)
    found = repeated_passages.remove_repeats(frame(rows).repartition(5), length, first)
    assert result(found) == plain(rows, length)


def test_one_passage_in_a_third_of_the_rows(spark, frame, many_blocks):
    """A rank and a span that fill many partitions, alone and between other texts."""
    passage = "this very common passage is in every third document of the whole corpus and has more than a hundred bytes "
    rows = [(i, f"{i * i} {passage}{i} tail" if i % 3 else passage) for i in range(900)] + [(1000 + i, f"{i:04d}" + "license text of sixty bytes that many hold " + f"{i * 7919}") for i in range(600)]
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    found = result(repeated_passages.remove_repeats(frame(rows).repartition(20)))
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    assert found == plain(rows)


def test_odd_rows(odd):
    assert result(repeated_passages.remove_repeats(odd)) == plain(ODD)


def test_shared_and_absent_ids(frame):
    """Equal rows are told apart by number only, one of them is first; a null id comes last."""
    text, other = "some words that are long enough to count " * 5, "quite another text with enough bytes in it " * 4
    rows = [(None, text), (None, text), (3, text), (3, text), (3, text), ((1 << 60) + 1, other), ((1 << 60) + 3, other), (9, text[50:])]
    assert result(repeated_passages.remove_repeats(frame(rows))) == plain(rows)


def test_a_text_of_several_megabytes(frame, monkeypatch):
    draw = random.Random(5)
    long = "".join(draw.choices("abcdefghij ", k=5_000_000))
    rows = [(1, long), (2, long[4_194_200:4_194_500] + "!"), (3, "-" * 2_000_000), (4, "x" + long[:99])]
    found = {r[0]: r[1:4] for r in result(repeated_passages.remove_repeats(frame(rows)))}
    assert found == {1: (5_000_000, 0, 0), 2: (301, 300, 1), 3: (2_000_000, 1_999_999, 1), 4: (100, 0, 0)}


def test_texts_longer_than_a_buffer_are_cut(frame, monkeypatch):
    """Cuts repeat enough bytes that no string is lost."""
    import pyarrow as pa

    monkeypatch.setattr(repeated_passages, "BUFFER", 256)
    data = [bytes(random.Random(i).choices(range(256), k=n)) for i, n in enumerate([900, 100, 99, 356, 355, 1])]
    names = ["earlier", "tie", "start", "data"]
    batch = pa.RecordBatch.from_arrays([pa.array(range(6), pa.int64()), pa.array([0] * 6, pa.int64()), pa.array([7] * 6, pa.int64()), pa.array(data, pa.binary())], names=names)
    strings = []
    for text, starts, ends, keys in repeated_passages._buffers(iter([batch]), 100):
        owner, place, count, _, _ = repeated_passages.spans(text, starts, ends, 32, 100)
        for o, p, n in zip(owner, place, count, strict=True):
            strings += [(int(keys[o][0]), int(keys[o][2] + p - starts[o] + i)) for i in range(n)]
    assert sorted(strings) == [(i, 7 + at) for i, d in enumerate(data) for at in range(len(d) - 99)]


def test_ranks_are_equal_for_equal_prefixes_only():
    data = bytes(random.Random(1).choices(b"ab", k=3000))
    for size in (8, 12, 32, 50, 100):
        rank = repeated_passages.ranks(data, size)
        assert len(rank) == len(data) - size + 1
        prefixes = [data[i : i + size] for i in range(len(rank))]
        assert len(set(zip(prefixes, rank.tolist(), strict=True))) == len(set(prefixes)) == len(np.unique(rank))


def test_empty_table(frame):
    assert repeated_passages.remove_repeats(frame([])).count() == 0


def test_query_equals_a_plain_scan(spark, sf_dir):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    found = QUERIES["op13_prefix_doubling"](spark, sf_dir)
    assert found.columns == ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    assert sorted((tuple(r) for r in found.collect()), key=repr) == plain(rows)
