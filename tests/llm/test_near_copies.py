import random
from itertools import combinations

import numpy as np
import pytest

import corpus_pipeline
from tillbook.llm import near_copies as N

from .conftest import ODD


def plain_set(text):
    words = (text or "").encode().lower().split()
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4)))


def jaccard(a, b):
    return len(a & b) / len(a | b)


def plain_groups(rows):
    """Groups of row places by brute force."""
    sets, root = [plain_set(t) for _, t in rows], list(range(len(rows)))

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for a, b in combinations(range(len(rows)), 2):
        both = len(sets[a] & sets[b])
        if 5 * both >= 4 * (len(sets[a]) + len(sets[b]) - both):
            root[find(a)] = find(b)
    found = {}
    for a in range(len(rows)):
        found.setdefault(find(a), []).append(a)
    return sorted(found.values())


def plain_kept(rows):
    order = lambda r: (r[0] is None, r[0] or 0)
    return sorted((min((rows[a] for a in g), key=order)[0] for g in plain_groups(rows)), key=repr)


def changed_copies(pairs, seed=5):
    """Pairs of random texts and copies with words changed, from the same text to below the threshold."""
    pick, rows = random.Random(seed), []
    for length, changes in ((1000, 20), (300, 0), (300, 1), (300, 3), (300, 5), (300, 6), (300, 9), (100, 1), (100, 2), (60, 1), (60, 2)):
        for _ in range(pairs):
            text = [f"w{pick.randrange(5000)}" for _ in range(length)]
            copy = list(text)
            for at in pick.sample(range(length), changes):
                copy[at] = f"new{pick.randrange(5000)}"
            rows += [(len(rows), " ".join(text)), (len(rows) + 1, " ".join(copy))]
    return rows


def ids(frame):
    return sorted((r.doc_id for r in frame.collect()), key=repr)


def test_the_stage_equals_brute_force_on_copies_of_any_similarity(spark, frame):
    rows = changed_copies(40)
    assert ids(corpus_pipeline.drop_near_copies(spark, frame(rows), "")) == plain_kept(rows)


@pytest.mark.parametrize(("tree_size", "tree_shingles"), [(7, 1 << 21), (1024, 1000), (1024, 1 << 21)])
def test_a_large_group_in_many_trees_equals_brute_force(frame, tree_size, tree_shingles):
    """Copies of one text, many of them alike only by way of others."""
    pick = random.Random(6)
    base = [f"w{i}" for i in range(200)]
    rows = []
    for i in range(150):
        copy = list(base)
        for at in pick.sample(range(200), pick.choice((0, 1, 2, 4, 6))):
            copy[at] = f"x{pick.randrange(9)}"
        rows.append((i, " ".join(copy)))
    found = N.deduplicate(frame(rows), tree_size, tree_shingles)
    assert ids(found) == plain_kept(rows)


def test_similar_is_exact_at_the_threshold():
    a = np.arange(9, dtype=np.uint64)
    assert N.similar(a, a[:8]) and N.similar(a[:4], a[:5])
    assert not N.similar(a[:4], a[:6]) and not N.similar(a[:7], a[2:])
    assert N.similar(np.arange(0, 90, dtype=np.uint64), np.arange(10, 100, dtype=np.uint64))
    assert not N.similar(np.arange(0, 89, dtype=np.uint64), np.arange(10, 100, dtype=np.uint64))


def test_odd_and_empty_tables(odd, frame):
    kept = N.deduplicate(odd)
    assert kept.columns == odd.columns
    assert ids(kept) == plain_kept(ODD)
    assert N.deduplicate(frame([])).count() == 0
