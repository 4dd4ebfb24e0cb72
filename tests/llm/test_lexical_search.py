import math
import re
from collections import Counter

import pytest

from tillbook.llm import lexical_search
from tillbook.llm.queries import ORACLES, QUERIES
from tillbook.plans.compare import compare

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return TERM.findall((text or "").translate(LOWER))


def plain(docs, items, k=10):
    """The ranking straight from the formula."""
    held = [(i, Counter(terms(t))) for i, t in docs]
    sizes = [sum(c.values()) for _, c in held]
    documents, length = sum(s > 0 for s in sizes), sum(sizes)
    df = Counter(t for _, c in held for t in c)
    found = []
    for item, text in items:
        ranked = []
        for (doc, c), n in zip(held, sizes, strict=True):
            if not n:
                continue
            m, score = 25 + 75 * n * documents // length, 0
            for t in terms(text):
                if c[t]:
                    score += math.floor(1000 * math.log((2 * documents + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m))
            if score > 0:
                ranked.append((-score, doc is None, doc or 0))
        for rank, (score, no_id, doc) in enumerate(sorted(ranked)[:k], 1):
            found.append((item, rank, None if no_id else doc, -score))
    return sorted(found, key=repr)


DOCS = [
    (1, "Red apples and green apples"), (2, "green pears"), (3, "red"), (4, "red"), (4, "red"), (None, "red"), (5, None), (6, ""),
    (7, "... !!!"), (8, "Äpfel über alles ÄPFEL"), (9, "日本 日本 red"), (10, "apples " * 3000), (11, "and " * 200 + "pears"), (12, "x1 y2 x1"),
]
ITEMS = [(1, "red apples"), (2, "red red pears"), (3, None), (4, ""), (5, "nothing here"), (2, "pears"), (None, "and and x1"), (7, "Äpfel äpfel 日本")]


def rows(frame):
    return sorted((tuple(r) for r in frame.collect()), key=repr)


@pytest.mark.parametrize("block_postings", [lexical_search.BLOCK_POSTINGS, 4])
def test_ranking_equals_the_formula(spark, frame, block_postings):
    """Also when the items lie in several blocks."""
    docs = frame(DOCS + [(100 + i, f"red w{i % 7} w{i % 11} pears") for i in range(300)])
    items = spark.createDataFrame([(i, t, "z", 3) for i, t in ITEMS], "item_id long, text string, item string, rank int")
    found = lexical_search.search(docs.repartition(5), items, block_postings=block_postings)
    assert found.columns == ["item_id", "rank", "doc_id", "score"]
    assert rows(found) == plain(DOCS + [(100 + i, f"red w{i % 7} w{i % 11} pears") for i in range(300)], ITEMS)


def test_a_text_of_several_megabytes(spark, frame):
    long = [(1, "alpha beta " * 300_000), (2, "z" * 3_000_000 + " alpha"), (3, "alpha")]
    items = spark.createDataFrame([(1, "alpha beta")], "item_id long, text string")
    assert rows(lexical_search.search(frame(long), items)) == plain(long, [(1, "alpha beta")])


def test_empty_tables(spark, frame):
    items = spark.createDataFrame([(1, "red")], "item_id long, text string")
    assert lexical_search.search(frame([]), items).count() == 0
    assert lexical_search.search(frame(DOCS), items.where("false")).count() == 0
    assert lexical_search.search(frame([(1, None), (2, "..")]), items).count() == 0


def test_heaps_keep_the_smaller_of_equal_documents():
    import numpy as np

    heaps = lexical_search.Heaps(1, 2)
    heaps.update([9, None, 3], np.array([[5], [5], [5]]))
    heaps.update([4, 1], np.array([[5], [4]]))
    assert sorted(heaps.rows().to_pydict()["doc_id"]) == [3, 4]


def test_query_equals_its_sql(spark, sf_dir):
    name = "op11_reversed_search"
    assert compare(QUERIES[name](spark, sf_dir), ORACLES[name], sf_dir) is None
