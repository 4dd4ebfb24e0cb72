import hashlib
import re
from collections import defaultdict

import pytest

from tillbook.llm import exact_dedup, near_copies, pii
from tillbook.llm.queries import ORACLES, QUERIES
from tillbook.plans.compare import compare

from .conftest import ODD


def plain(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[re.sub(r"[ \t-\r]", "", t or "")].append((i, t or ""))
    found = []
    for text, members in groups.items():
        low = lambda m: (-len(m[1]), m[0] is not None, m[0] or 0)
        keep = min(members, key=low)[0]
        sha = hashlib.sha256(text.encode()).hexdigest()
        found += [(i, keep, len(members), i == keep, sha) for i, _ in members]
    return sorted(found, key=repr)


@pytest.mark.parametrize("max_bits", [1 << 10, exact_dedup.MAX_BITS])
def test_groups_equal_a_plain_count(frame, max_bits):
    """Also with a filter so full that most rows pass it."""
    rows = ODD + [(100 + i, f"text {i % 400}" + " " * (i % 3)) for i in range(1000)]
    found = exact_dedup.exact_groups(frame(rows), max_bits)
    assert sorted((tuple(r) for r in found.collect()), key=repr) == plain(rows)


def test_empty_table(frame):
    assert exact_dedup.exact_groups(frame([])).count() == 0
    assert exact_dedup.deduplicate(frame([])).count() == 0


def test_deduplicate_keeps_columns_and_one_of_each(odd):
    kept = exact_dedup.deduplicate(odd)
    assert kept.columns == odd.columns
    expected = sorted((r[0] for r in plain(ODD) if r[3]), key=repr)
    assert sorted((r.doc_id for r in kept.collect()), key=repr) == expected
    assert {r.text_sha256 for r in kept.collect()} == {"x"}


def test_unrepeated_rows_are_not_shuffled(odd):
    plan = exact_dedup.deduplicate(odd)._jdf.queryExecution().optimizedPlan().toString()
    assert "Union" in plan and "Python" not in plan and "Arrow" not in plan


def test_query_equals_its_sql(spark, sf_dir):
    name = "op10_bloom_exact_dedup"
    assert compare(QUERIES[name](spark, sf_dir), ORACLES[name], sf_dir) is None


def test_columns_with_the_operators_own_names_are_kept(spark):
    """Names of keys, filters and marks inside the operators are free for a user."""
    names = ["doc_id", "text", "_bloom_sha", "_bloom_word0", "_group_sha", "row", "row_key", "text_sha256", "n_points", "stays", "own_doc_id", "_text_key", "_own_id", "_more", "more"]
    rows = [(i, f"a text with words to count {i // 2}", *[f"{n}{i}" for n in names[2:]]) for i in range(8)]
    docs = spark.createDataFrame(rows, names)
    for stage in (exact_dedup.deduplicate, lambda d: exact_dedup.deduplicate(d, by_row=True), near_copies.deduplicate):
        found = stage(docs)
        assert found.columns == names
        assert sorted(tuple(r) for r in found.collect()) == rows[::2]
    assert sorted(tuple(r) for r in pii.mask(docs).collect()) == rows


def test_a_filter_above_its_bound_is_no_broadcast(frame):
    """Beyond it the words are joined to narrow rows; texts still do not move."""
    rows = [(i, f"text {i % 50}") for i in range(100)]
    assert sorted(r.doc_id for r in exact_dedup.deduplicate(frame(rows), 64).collect()) == list(range(50))
    found = exact_dedup.exact_groups(frame(rows), 64)
    assert "broadcast" not in found._jdf.queryExecution().logical().toString().lower()
    assert sorted((tuple(r) for r in found.collect()), key=repr) == plain(rows)
