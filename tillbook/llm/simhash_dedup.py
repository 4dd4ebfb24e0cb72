"""Near duplicates by SimHash fingerprints, found with sharded BK-trees.

A fingerprint has 64 bits. Two that differ in at most two bits agree in at least
two of four blocks of 16 bits, so they share one of the six shards named by a
pair of blocks and its 32 bits. Every shard of two or more fingerprints is a
BK-tree: a child hangs on the edge of its Hamming distance to its parent, and a
search follows only the edges within the radius of its own distance. A shard
with more than ``tree_size`` fingerprints becomes several trees, and every tree
travels to every part of the shard's queries, so that no task holds an unbounded
shard and no link is lost. Trees are rows of a shuffle, not driver broadcasts:
together they hold all fingerprints, which have no size bound.

Equal fingerprints are joined to one node before any search, so a group of
copies, however large, is one query. A fingerprint has at most 2,080 others
within two bits, so the links are linear in the distinct fingerprints.

Rules for odd input: a null text is empty, a text without words has fingerprint
zero and is linked like any other. Rows repeated with one doc_id are one
document. A null doc_id never names a component unless all of its members are
null. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillbook.llm.batches import map_lists, ship
from tillbook.llm.components import components
from tillbook.llm.rows import one_row_each, text_key
from tillbook.session import written

SHINGLE = 3
SEED = 42
RADIUS = 2
BLOCKS = 4
TREE_SIZE = 1024
# Shingles counted at a time, so that a very long text needs no more memory.
SLICE = 1 << 16
MASK = (1 << 64) - 1
LOWEST = np.uint64(0x0101010101010101)


def _bit_counts(hashes: np.ndarray) -> np.ndarray:
    """How many hashes have each of the 64 bits, by sums of byte lanes that cannot overflow."""
    counts = np.empty((8, 8), np.int64)
    blocks = np.arange(0, len(hashes), 255)
    for bit in range(8):
        lanes = np.add.reduceat((hashes >> np.uint64(bit)) & LOWEST, blocks)
        counts[:, bit] = lanes.view(np.uint8).reshape(-1, 8).sum(0, dtype=np.int64)
    return counts.ravel()


def _mixed(hashes: np.ndarray, number: int) -> np.ndarray:
    """Hashes for fingerprint ``number``; those of the first are as they are."""
    if not number:
        return hashes
    mixed = hashes + np.uint64(number * 0x9E3779B97F4A7C15 & MASK)
    mixed = (mixed ^ (mixed >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    mixed = (mixed ^ (mixed >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return mixed ^ (mixed >> np.uint64(31))


def text_fingerprints(text: str | None, count: int = 1) -> list[int]:
    """SimHashes of the text's shingles as unsigned numbers, independent of each other."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return [0] * count
    joined = b" ".join(words)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts, ends = (ends - lengths).tolist(), ends.tolist()
    width = min(SHINGLE, len(words))
    total = len(words) - width + 1
    digest, ones = xxhash.xxh64_intdigest, np.zeros((count, 64), np.int64)
    for low in range(0, total, SLICE):
        high = min(total, low + SLICE)
        pairs = zip(starts[low:high], ends[low + width - 1 : high + width - 1], strict=True)
        hashes = np.array([digest(joined[a:b], SEED) for a, b in pairs], np.uint64)
        for number in range(count):
            ones[number] += _bit_counts(_mixed(hashes, number))
    return np.packbits(ones * 2 > total, axis=1, bitorder="little").view(np.uint64).ravel().tolist()


def fingerprint(text: str | None) -> int:
    return text_fingerprints(text)[0]


def fingerprints(docs: DataFrame, count: int = 1, keyed: bool = False) -> DataFrame:
    """doc_id, the fingerprint as a signed 64-bit number (``fp``), further ones (``more``) and, if ``keyed``, text_key."""
    keys = ["text_key"] if keyed else []

    def run(columns: dict[str, list]) -> dict[str, list]:
        found = [[f - (1 << 64) if f >> 63 else f for f in text_fingerprints(t, count)] for t in columns["text"]]
        return {"doc_id": columns["doc_id"], "fp": [f[0] for f in found], "more": [f[1:] for f in found]} | {k: columns[k] for k in keys}

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *[text_key().alias(k) for k in keys])
    return map_lists(rows, run, "doc_id long, fp long, more array<long>" + ", text_key binary" * keyed)


class BkTree:
    """Children keyed by their Hamming distance to the parent."""

    def __init__(self, values: list[int]):
        self.values: list[int] = []
        self.children: list[dict[int, int]] = []
        for value in values:
            self.add(value)

    def add(self, value: int) -> None:
        node = 0
        if self.values:
            while True:
                distance = (value ^ self.values[node]).bit_count()
                if not distance:
                    return
                following = self.children[node].get(distance)
                if following is None:
                    self.children[node][distance] = len(self.values)
                    break
                node = following
        self.values.append(value)
        self.children.append({})

    def within(self, value: int, radius: int) -> Iterator[int]:
        """Values at most ``radius`` bits away, itself included if present."""
        waiting = [0] if self.values else []
        while waiting:
            node = waiting.pop()
            distance = (value ^ self.values[node]).bit_count()
            if distance <= radius:
                yield self.values[node]
            children = self.children[node]
            if children:
                for edge in range(distance - radius, distance + radius + 1):
                    if edge in children:
                        waiting.append(children[edge])


def shard_keys(fp: str = "fp") -> Column:
    """One key per pair of blocks: the pair's number and the 32 bits of its blocks."""
    width = 64 // BLOCKS
    block = [f"(shiftrightunsigned({fp}, {width * i}) & {(1 << width) - 1}L)" for i in range(BLOCKS)]
    keys = [
        f"struct({n} AS pair, shiftleft({block[i]}, {width}) | {block[j]} AS bits)"
        for n, (i, j) in enumerate(combinations(range(BLOCKS), 2))
    ]
    return F.expr(f"array({', '.join(keys)})")


def fingerprint_links(distinct: DataFrame, radius: int = RADIUS, tree_size: int = TREE_SIZE) -> DataFrame:
    """Pairs (a < b) of distinct fingerprints (columns ``space``, ``fp``) of one space at most ``radius`` bits apart."""
    if radius > BLOCKS - 2:
        raise ValueError("the shards find pairs of at most two differing bits")
    keyed = distinct.select("fp", "space", F.explode(shard_keys()).alias("key"))
    keyed = keyed.select("fp", F.expr("space * 8 + key.pair").alias("pair"), "key.bits")
    sizes = written(keyed.groupBy("pair", "bits").count().where("count >= 2"), "shards")
    trees = F.expr(f"cast(ceil(count / {tree_size}) as int)")
    placed = keyed.join(sizes, ["pair", "bits"]).withColumn("trees", trees)
    placed = placed.withColumn("tree", F.expr("cast(pmod(xxhash64(fp), trees) as int)"))
    # Meeting (q, t) searches tree t for the fingerprints of tree q; q = t searches a tree for its own.
    meetings = F.expr("""
        transform(sequence(0, trees - 1), o -> IF(o <= tree,
            struct(o AS q, tree AS t, true AS member), struct(tree AS q, o AS t, false AS member)))""")
    rows = placed.select("fp", "pair", "bits", F.explode(meetings).alias("m")).select("fp", "pair", "bits", "m.*")
    ship(distinct.sparkSession)
    dealt = rows.repartition("pair", "bits", "q", "t").sortWithinPartitions("pair", "bits", "q", "t", F.desc("member"))
    return dealt.mapInArrow(_search(radius), "space int, a long, b long").distinct()


def _search(radius: int):
    schema = pa.schema([("space", pa.int32()), ("a", pa.int64()), ("b", pa.int64())])

    def own_pairs(members: list[int], space: int) -> Iterator[tuple[int, int, int]]:
        tree = BkTree(members) if len(members) > 1 else None
        for value in members if tree else ():
            for other in tree.within(value, radius):
                if value < other:
                    yield space, value, other

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, members, tree = None, [], None
        for batch in batches:
            pairs: list[tuple[int, int, int]] = []
            columns = [batch.column(n).to_pylist() for n in ("fp", "pair", "bits", "q", "t", "member")]
            for fp, pair, bits, q, t, member in zip(*columns, strict=True):
                key, value = (pair, bits, q, t), fp & MASK
                if key != current:
                    if current and current[2] == current[3]:
                        pairs += own_pairs(members, current[0] // 8)
                    current, members, tree = key, [], None
                if member:
                    members.append(value)
                else:
                    tree = tree or BkTree(members)
                    pairs += [(pair // 8, min(value, o), max(value, o)) for o in tree.within(value, radius)]
            yield _signed(pairs, schema)
        if current and current[2] == current[3]:
            yield _signed(list(own_pairs(members, current[0] // 8)), schema)

    return run


def _signed(pairs: list[tuple[int, int, int]], schema: pa.Schema) -> pa.RecordBatch:
    values = np.array(pairs, np.uint64).reshape(-1, 3).view(np.int64)
    return pa.RecordBatch.from_arrays([pa.array(values[:, i].astype(np.int32 if not i else np.int64)) for i in range(3)], schema=schema)


def node_links(found: DataFrame, radius: int, tree_size: int) -> DataFrame:
    """Pairs (a, b) of first fingerprints whose documents are linked by any of their fingerprints.

    Documents with one first fingerprint are one node. A further fingerprint
    links the nodes that hold it to the smallest of them, and that node to those
    of the fingerprints near it.
    """
    first = found.select("fp").distinct().select(F.lit(0).alias("space"), "fp", F.col("fp").alias("node"))
    others = found.select("fp", F.posexplode("more").alias("at", "value")).select(
        F.expr("at + 1").alias("space"), F.col("value").alias("fp"), F.col("fp").alias("node")
    )
    held = written(first.unionByName(others.distinct()), "held")
    values = written(held.groupBy("space", "fp").agg(F.min("node").alias("holder")), "values")
    same = held.join(values, ["space", "fp"]).where("node <> holder").select(F.col("node").alias("a"), F.col("holder").alias("b"))
    links = written(fingerprint_links(values, radius, tree_size), "links")
    for side in ("a", "b"):
        holders = values.select("space", F.col("fp").alias(side), F.col("holder").alias(f"_{side}"))
        links = links.join(holders, ["space", side])
    return same.union(links.select("_a", "_b"))


def _roots(found: DataFrame, radius: int, tree_size: int) -> DataFrame:
    """Every first fingerprint with its smallest doc_id (``first_id``) and the root of its component."""
    distinct = written(found.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "distinct")
    roots = written(components(node_links(found, radius, tree_size)), "roots")
    return distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))


def near_duplicates(docs: DataFrame, radius: int = RADIUS, tree_size: int = TREE_SIZE, count: int = 1) -> DataFrame:
    """One row per document: doc_id, fingerprint (hexadecimal), component_id."""
    found = written(fingerprints(docs, count), "fingerprints")
    named = _roots(found, radius, tree_size)
    smallest = written(named.groupBy("root").agg(F.min("first_id").alias("component_id")), "components")
    # Written, so that the join below can split a fingerprint that many documents share.
    by_fp = written(named.join(smallest, "root").select("fp", "component_id"), "named")
    code = F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint")
    return found.join(by_fp, "fp").select("doc_id", code, "component_id")


def deduplicate(docs: DataFrame, radius: int = RADIUS, tree_size: int = TREE_SIZE, count: int = 1) -> DataFrame:
    """One document of each group, that with the smallest doc_id, with all its columns.

    An edit moves each of ``count`` independent fingerprints by a number of bits
    that varies, and one that stays within the radius is enough. So more of them
    find more copies, while texts that have little in common stay apart in all.
    Rows are dropped by id and text, so a null or shared id takes no other text
    with it; rows equal in both are one document.
    """
    found = written(fingerprints(docs, count, keyed=True), "fingerprints")
    roots = written(_roots(found, radius, tree_size).select("fp", F.col("root").alias("group")), "named")
    return one_row_each(docs, found.join(roots, "fp").select("doc_id", "text_key", "group"), repeats=True)
