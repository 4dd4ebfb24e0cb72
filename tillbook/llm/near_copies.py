"""Near copies: texts whose sets of five-word shingles have a Jaccard similarity of 0.8 or more.

Candidates come from sharded BK-trees, links from the exact similarity. A shard
is a MinHash band: two texts of similarity s share one of the 16 bands of four
values with probability 1 - (1 - s^4)^16, that is 0.9998 at 0.8 and more above.
Inside a shard fingerprints decide who is compared: SimHashes of 256 bits, of
which two texts at 0.8 differ in 39 on average and others in 128. The radius is
five standard deviations above the first and far enough below the second that a
search leaves out the branches of other groups. What is within it is compared
by all shingles, so nothing below 0.8 is ever linked.

Texts with the same shingles are one node. First every node meets the smallest
of its shard, so that a large group of copies is joined by as many comparisons
as it has members. Only shards that then still hold several components are
searched further, first by fingerprint alone, in trees of bounded size that meet
each other: a node that is near none of another component goes. What is left
meets with its shingles, and a task joins what it has linked, so it returns
fewer links than it has nodes. Fingerprints of 32 bytes are all that travels for
nodes that merely share a shard; texts and shingles are fetched for nodes near
another only, and no other text leaves the scan.

Rules for odd input: words are those of the contracts, in lower case; a text of
fewer than five words is one shingle, a null text is empty, and all texts
without words are one node. Of a group the row with the smallest doc_id stays,
one with a null doc_id only if all have none; rows that share it are ordered by
the digest of their text. Exactly one row stays, whatever ids are null or shared.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillbook.llm.batches import map_lists, ship, text_or_empty
from tillbook.llm.components import components
from tillbook.llm.rows import near_keys, one_row_each, text_key
from tillbook.llm.simhash_dedup import MASK, SEED, SLICE, BkTree, _bit_counts, _mixed
from tillbook.session import Scratch, written

SHINGLE = 5
BANDS, BAND_VALUES = 16, 4
# 64-bit words of a fingerprint.
WORDS = 4
RADIUS = 68
TREE_SIZE = 1024
# Shingles of one tree, so that long texts need no more memory.
TREE_SHINGLES = 1 << 21

_numbers = np.random.Generator(np.random.PCG64(SEED)).integers(0, MASK, (2, BANDS * BAND_VALUES), np.uint64, endpoint=True)
MASKS, FACTORS = _numbers[0], _numbers[1] | np.uint64(1)


def shingles(text: str | None) -> np.ndarray:
    """Hashes of the distinct shingles in ascending order."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    joined = b" ".join(words)
    width = min(SHINGLE, len(words))
    if not width:
        return np.array([xxhash.xxh64_intdigest(b"", SEED)], np.uint64)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts, ends = (ends - lengths).tolist(), ends.tolist()
    total, digest, parts = len(words) - width + 1, xxhash.xxh64_intdigest, []
    for low in range(0, total, SLICE):
        high = min(total, low + SLICE)
        pairs = zip(starts[low:high], ends[low + width - 1 : high + width - 1], strict=True)
        parts.append(np.array([digest(joined[a:b], SEED) for a, b in pairs], np.uint64))
    return np.unique(np.concatenate(parts))


def bands(hashes: np.ndarray) -> list[int]:
    """One signed number for each band of MinHash values."""
    lowest = np.array([((hashes ^ m) * f).min() for m, f in zip(MASKS, FACTORS, strict=True)], np.uint64)
    keys = [xxhash.xxh64_intdigest(part.tobytes(), SEED) for part in lowest.reshape(BANDS, BAND_VALUES)]
    return np.array(keys, np.uint64).view(np.int64).tolist()


def sketch(hashes: np.ndarray) -> list[int]:
    """The SimHash of a set of shingles as signed words."""
    ones = np.array([_bit_counts(_mixed(hashes, number)) for number in range(WORDS)])
    return np.packbits(ones * 2 > len(hashes), axis=1, bitorder="little").view(np.int64).ravel().tolist()


def joined_words(words: list[int]) -> int:
    """The fingerprint as one number."""
    return sum((word & MASK) << (64 * i) for i, word in enumerate(words))


def _near(a: str, b: str) -> Column:
    bits = [F.bit_count(F.col(a)[i].bitwiseXOR(F.col(b)[i])) for i in range(WORDS)]
    return sum(bits[1:], bits[0]) <= RADIUS


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether the Jaccard similarity is at least 0.8, in whole numbers: 5 * common >= 4 * union."""
    both = len(a) + len(b)
    if 9 * min(len(a), len(b)) < 4 * both:
        return False
    return 9 * len(np.intersect1d(a, b, assume_unique=True)) >= 4 * both


def _described(docs: DataFrame) -> DataFrame:
    """Every row without its text: doc_id, digest of the text, digest of the shingles, their number, bands and fingerprint."""

    def run(columns: dict[str, list]) -> dict[str, list]:
        sets = [shingles(t) for t in columns["text"]]
        return {
            "doc_id": columns["doc_id"],
            "text_key": columns["text_key"],
            "digest": [xxhash.xxh3_128_digest(s.tobytes()) for s in sets],
            "size": [len(s) for s in sets],
            "bands": [bands(s) for s in sets],
            "sketch": [sketch(s) for s in sets],
        }

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_key().alias("text_key"), "text")
    return map_lists(rows, run, "doc_id long, text_key binary, digest binary, size long, bands array<long>, sketch array<long>")


def _sets(docs: DataFrame, needed: DataFrame) -> DataFrame:
    """Node and shingles of the needed nodes (columns ``node``, ``text_key``)."""

    def run(columns: dict[str, list]) -> dict[str, list]:
        return {"node": columns["node"], "shingles": [shingles(t).tobytes() for t in columns["text"]]}

    texts = near_keys(docs.select(text_key().alias("text_key"), text_or_empty().alias("text")), needed, "text_key")[1]
    texts = texts.join(needed, "text_key").groupBy("text_key", "node").agg(F.first("text").alias("text"))
    return map_lists(texts.select("node", "text"), run, "node long, shingles binary")


MEETING = ["a", "b", "q", "t"]


def _dealt(meetings: DataFrame) -> DataFrame:
    """Rows of one (a, b, q, t) together, its members first."""
    ship(meetings.sparkSession)
    # A batch holds few sets, as they can be long.
    meetings.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "512")
    return meetings.repartition(*MEETING).sortWithinPartitions(*MEETING, F.desc("member"))


def _links(meetings: DataFrame) -> DataFrame:
    """Links found in meetings: rows of one (a, b, q, t) are compared with its members, and members of q = t among themselves."""
    rows = _dealt(meetings).select(*MEETING, "member", "node", "root", "sketch", "shingles")
    return rows.mapInArrow(_compare, "a long, b long").distinct()


class Meeting:
    """A BK-tree of members and the links among those that have met."""

    def __init__(self):
        self.tree, self.held, self.parent = BkTree([]), {}, {}

    def find(self, root: int) -> int:
        while (up := self.parent.get(root, root)) != root:
            self.parent[root] = self.parent.get(up, up)
            root = up
        return root

    def links(self, node: int, root: int, fp: int, own: np.ndarray) -> Iterator[tuple[int, int]]:
        for near in self.tree.within(fp, RADIUS):
            for other, other_root, hashes in self.held[near]:
                a, b = self.find(root), self.find(other_root)
                if a != b and similar(own, hashes):
                    self.parent[max(a, b)] = min(a, b)
                    yield node, other

    def add(self, node: int, root: int, fp: int, own: np.ndarray) -> None:
        self.tree.add(fp)
        self.held.setdefault(fp, []).append((node, root, own))


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    current, meeting = None, None
    for batch in batches:
        found: list[tuple[int, int]] = []
        for *key, member, node, root, fp, hashes in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if key != current:
                current, meeting = key, Meeting()
            row = node, root, joined_words(fp), np.frombuffer(hashes, np.uint64)
            if not member or key[2] == key[3]:
                found += meeting.links(*row)
            if member:
                meeting.add(*row)
        pairs = np.array(found, np.int64).reshape(-1, 2)
        yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])


def _near_others(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Nodes of a meeting within the radius of one of another component: (a, b, node)."""
    current, tree, held, told = None, None, {}, set()
    for batch in batches:
        found: list[tuple[int, int, int]] = []
        for *key, member, node, root, words in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if key != current:
                current, tree, held, told = key, BkTree([]), {}, set()
            print_ = joined_words(words)
            if not member or key[2] == key[3]:
                others = [n for near in tree.within(print_, RADIUS) for r, nodes in held[near].items() if r != root for n in nodes]
                fresh = {node, *others} - told if others else set()
                told |= fresh
                found += [(key[0], key[1], n) for n in fresh]
            if member:
                tree.add(print_)
                held.setdefault(print_, {}).setdefault(root, []).append(node)
        yield pa.RecordBatch.from_arrays([pa.array([f[i] for f in found], pa.int64()) for i in range(3)], names=["a", "b", "node"])


def _smallest_meets_all(pairs: DataFrame, tree_size: int, scratch: Scratch) -> DataFrame:
    """Meetings of nodes with the smallest node of their shards (``a``, ``node``), without their shingles."""
    pairs = pairs.withColumn("part", F.expr(f"cast(pmod(xxhash64(node), {tree_size}) as int)"))
    counts = scratch.written(pairs.groupBy("a").count(), "pairs")
    # Parts of at most about tree_size nodes; the smallest node goes to each.
    counts = counts.select("a", F.expr(f"cast(ceil(count / {tree_size}) as int)").alias("parts"))
    others = pairs.join(counts, "a").select("a", F.expr("cast(pmod(part, parts) as int)").alias("q"), "node", F.lit(False).alias("member"))
    lows = counts.select("a", F.explode(F.expr("sequence(0, parts - 1)")).alias("q"), F.col("a").alias("node"), F.lit(True).alias("member"))
    meetings = others.unionByName(lows)
    return meetings.select("a", F.lit(-1).cast("long").alias("b"), "q", F.lit(-1).alias("t"), "member", "node", F.col("node").alias("root"))


def _open_shards(named: DataFrame) -> DataFrame:
    """Band and key of the shards that hold several components; of shards with the same nodes, one."""
    shards = named.groupBy("band", "key").agg(
        F.count("*").alias("nodes"),
        F.min("root").alias("low"),
        F.max("root").alias("high"),
        F.bit_xor(F.xxhash64("node")).alias("x"),
        F.bit_xor(F.xxhash64("node", F.lit(1))).alias("y"),
    )
    # Both nodes of a shard of two have met.
    open_ones = shards.where("nodes > 2 AND low <> high").groupBy("nodes", "x", "y")
    return open_ones.agg(F.min(F.struct("band", "key")).alias("s")).select("s.*")


def _all_pairs(held: DataFrame, tree_size: int, tree_shingles: int | None, scratch: Scratch) -> DataFrame:
    """Meetings of all nodes of a shard (band, key, node, root, size), in trees of bounded size."""
    sizes = held.groupBy("band", "key").agg(F.count("*").alias("nodes"), F.sum("size").alias("total"))
    by_size = f"ceil(total / {tree_shingles})" if tree_shingles else "1"
    trees = F.expr(f"cast(greatest(ceil(nodes / {tree_size}), {by_size}) as int)")
    held = held.join(scratch.written(sizes.select("band", "key", trees.alias("trees")), "trees"), ["band", "key"])
    held = held.withColumn("tree", F.expr("cast(pmod(xxhash64(node), trees) as int)"))
    # Meeting (q, t): the nodes of tree t are its members, those of tree q come to it.
    meetings = F.expr("""
        transform(sequence(0, trees - 1), o -> IF(o <= tree,
            struct(o AS q, tree AS t, true AS member), struct(tree AS q, o AS t, false AS member)))""")
    dealt = held.select("key", "band", "node", "root", F.explode(meetings).alias("m"))
    return dealt.select(F.col("key").alias("a"), F.col("band").cast("long").alias("b"), "m.q", "m.t", "m.member", "node", "root")


def groups(docs: DataFrame, tree_size: int = TREE_SIZE, tree_shingles: int = TREE_SHINGLES) -> DataFrame:
    """doc_id, text_key and group (a number) of every row that is alike to another."""
    scratch = Scratch(docs.sparkSession, "near-copies")
    keep = scratch.written
    found = written(_described(docs), "described")
    nodes = found.groupBy("digest").agg(
        F.min("text_key").alias("text_key"), *[F.first(c).alias(c) for c in ("size", "bands", "sketch")], F.count("*").alias("rows")
    )
    nodes = keep(nodes.withColumn("node", F.monotonically_increasing_id()), "nodes")
    sketches = nodes.select("node", "sketch")
    placed = nodes.select("node", "size", F.posexplode("bands").alias("band", "key"))
    shards = placed.groupBy("band", "key").agg(F.count("*").alias("n"), F.min("node").alias("low"))
    shards = keep(shards.where("n >= 2").drop("n"), "shards")
    placed = keep(placed.join(shards, ["band", "key"]), "placed")

    def with_sets(meetings: DataFrame) -> DataFrame:
        met = meetings.select("node").distinct().join(nodes.select("node", "text_key"), "node")
        sets = keep(_sets(docs, keep(met, "met")), "sets")
        return meetings.join(sketches, "node").join(sets, "node")

    pairs = placed.where("node <> low").select(F.col("low").alias("a"), "node").distinct().join(sketches, "node")
    lows = sketches.select(F.col("node").alias("a"), F.col("sketch").alias("low_sketch"))
    near = keep(pairs.join(lows, "a").where(_near("sketch", "low_sketch")).select("a", "node"), "near")
    links = keep(_links(with_sets(keep(_smallest_meets_all(near, tree_size, scratch), "meetings"))), "links")
    roots = keep(components(links, keep), "roots")
    named = keep(placed.drop("low").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")), "named")
    held = keep(named.join(keep(_open_shards(named), "open"), ["band", "key"]), "held")
    searched = _dealt(_all_pairs(held, tree_size, None, scratch).join(sketches, "node"))
    rows = searched.select(*MEETING, "member", "node", "root", "sketch")
    hits = keep(rows.mapInArrow(_near_others, "a long, b long, node long").distinct(), "hits")
    held = held.join(hits.select(F.col("a").alias("key"), F.col("b").cast("int").alias("band"), "node"), ["band", "key", "node"])
    rest = keep(_all_pairs(keep(held, "rest"), tree_size, tree_shingles, scratch), "meetings")
    more = keep(_links(with_sets(rest)), "links")
    if not more.isEmpty():
        roots = keep(components(links.union(more), keep), "roots")
    alike = nodes.select("node", "digest", "rows").join(roots, "node", "left").where("rows > 1 OR root IS NOT NULL")
    alike = written(alike.select("digest", F.coalesce("root", "node").alias("group")), "named")
    scratch.drop()
    return found.select("doc_id", "text_key", "digest").join(alike, "digest").select("doc_id", "text_key", "group")


def deduplicate(docs: DataFrame, tree_size: int = TREE_SIZE, tree_shingles: int = TREE_SHINGLES) -> DataFrame:
    """One row of each group, with all its columns."""
    return one_row_each(docs, groups(docs, tree_size, tree_shingles))
