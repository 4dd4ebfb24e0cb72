import random
import re

import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from tillbook.llm import simhash_dedup as S
from tillbook.llm.components import components
from tillbook.llm.queries import QUERIES

from .conftest import ODD


def plain_fingerprint(text):
    lower = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lower)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(rows):
    codes = [plain_fingerprint(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for a in range(len(rows)):
        for b in range(a):
            if (codes[a] ^ codes[b]).bit_count() <= 2:
                root[find(a)] = find(b)
    ids = {}
    for a, (i, _) in enumerate(rows):
        if i is not None:
            ids[find(a)] = min(ids.get(find(a), i), i)
    return sorted(((i, f"{codes[a]:016x}", ids.get(find(a))) for a, (i, _) in enumerate(rows)), key=repr)


def near_copies(count, seed=3):
    pick = random.Random(seed)
    words = [f"w{i}" for i in range(500)]
    rows = []
    for base in range(count):
        text = [pick.choice(words) for _ in range(300)]
        for copy in range(4):
            changed = list(text)
            for _ in range(copy):
                changed[pick.randrange(len(text))] = "new"
            rows.append((1000 + base * 4 + copy, " ".join(changed)))
    return rows


@given(st.text(alphabet=" \n\tabAB\x0bé\x1cß", max_size=60))
@settings(max_examples=200, deadline=None)
def test_fingerprint(text):
    assert S.fingerprint(text) == plain_fingerprint(text)


def test_whole_result_equals_brute_force(frame):
    rows = ODD + near_copies(40)
    found = sorted((tuple(r) for r in S.near_duplicates(frame(rows)).collect()), key=repr)
    assert found == plain_components(rows)


def test_small_trees_lose_no_link(spark):
    """Shards cut into many trees give the same links, a dense cluster included."""
    pick = random.Random(1)
    center = pick.getrandbits(64)
    codes = {pick.getrandbits(64) for _ in range(300)}
    for _ in range(300):
        code = center
        for _ in range(pick.randrange(4)):
            code ^= 1 << pick.randrange(64)
        codes.add(code)
    signed = sorted(c - (1 << 64) if c >> 63 else c for c in codes)
    expected = {(a, b) for a in codes for b in codes if a < b and (a ^ b).bit_count() <= 2}
    # The second space holds another half of them: spaces never mix.
    frame = spark.createDataFrame([(0, c) for c in signed] + [(3, c) for c in signed[::2]], "space int, fp long")
    half = {c % (1 << 64) for c in signed[::2]}
    for size in (7, 1024):
        found = S.fingerprint_links(frame, tree_size=size).collect()
        assert {(r.a % (1 << 64), r.b % (1 << 64)) for r in found if r.space == 0} == expected
        assert {(r.a % (1 << 64), r.b % (1 << 64)) for r in found if r.space == 3} == {(a, b) for a, b in expected if {a, b} <= half}


def test_tree_follows_only_edges_within_the_radius():
    pick = random.Random(2)
    codes = [pick.getrandbits(64) for _ in range(400)]
    tree = S.BkTree(codes + codes[:5])
    assert len(tree.values) == 400
    for code in codes[:50]:
        near = code ^ 5
        assert set(tree.within(near, 2)) == {c for c in codes if (c ^ near).bit_count() <= 2}


def test_components_of_a_long_path(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, 101), (102, 101), (5, 5)]
    found = dict(map(tuple, components(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert found == {**dict.fromkeys(range(61), 0), **dict.fromkeys((100, 101, 102), 100)}


def test_one_document_of_each_group_stays(odd, frame):
    kept = S.deduplicate(odd)
    assert kept.columns == odd.columns
    expected = sorted((i for i, _, c in plain_components(ODD) if i == c), key=repr)
    assert sorted((r.doc_id for r in kept.collect()), key=repr) == expected
    assert S.near_duplicates(frame([])).count() == 0
    assert S.deduplicate(frame([])).count() == 0


def test_more_fingerprints_find_more_copies_and_join_nothing_else(frame):
    rows = near_copies(60)
    plain = {i: [S.text_fingerprints(t, 8)] for i, t in rows}
    root = {i: i for i in plain}

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for a in plain:
        for b in plain:
            if b < a and any((x ^ y).bit_count() <= 2 for x, y in zip(plain[a][0], plain[b][0], strict=True)):
                root[max(find(a), find(b))] = min(find(a), find(b))
    found = {r.doc_id: r.component_id for r in S.near_duplicates(frame(rows), count=8).collect()}
    assert found == {i: find(i) for i in plain}
    assert all((i - 1000) // 4 == (c - 1000) // 4 for i, c in found.items()), "only copies of one text are joined"
    # One or no word changed: nearly all are found.
    light = [found[i] != i for i in found if (i - 1000) % 4 == 1]
    assert sum(light) >= 0.95 * len(light)


def test_query(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    found = sorted((tuple(r) for r in QUERIES["op5_simhash_bktree"](spark, sf_dir).collect()), key=repr)
    assert found == plain_components(rows)
