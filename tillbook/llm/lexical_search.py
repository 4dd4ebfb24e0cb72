"""Ranked lexical search the other way round: documents stream past an index over the items.

The items (queries) are the bounded side. Their terms make an inverted index,
term to the items that hold it and how often, which is broadcast block by block;
a block has at most about ``BLOCK_POSTINGS`` entries, so its size does not
depend on the number of items. One scan counts the indexed terms of every
document and keeps the counts; document frequencies and lengths come from them.
The counts then stream through the index: a task adds up the scores of its
documents by item and keeps a heap of the best ``k`` per item. Heaps are merged
in two steps, so no task meets the heaps of all tasks at once.

Scores are whole numbers; only a term's weight takes a logarithm in doubles.

Rules for odd input: a null text has no terms, whether of an item or a document.
Rows are items and documents by themselves, so repeated item_ids have a ranking
each and repeated documents a rank each. Equal scores go by doc_id, a null one
last. Extra columns are ignored, whatever their names. An item without a
document that scores above 0, and an empty table, give no rows.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tillbook.llm.batches import ship
from tillbook.session import written

# Index entries of one broadcast, some 100 bytes each.
BLOCK_POSTINGS = 200_000
# Documents scored at once, and bytes of a text split into terms at once.
SCORED = 128
SLICE = 1 << 20
# Groups in which the heaps of the tasks first meet.
MERGES = 64

# ASCII letters and digits are lower-cased and kept, other ASCII parts terms, all else belongs to them.
_PARTS = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else 0x20 for b in range(256)
)


def term_slices(text: str | None) -> Iterator[list[bytes]]:
    """The terms of a text in order, in lists of bounded size."""
    data = (text or "").encode("utf-8", "surrogatepass").translate(_PARTS)
    at = 0
    while at < len(data):
        end = len(data) if at + SLICE >= len(data) else data.find(b" ", at + SLICE)
        end = len(data) if end < 0 else end
        yield data[at:end].split()
        at = end


def term_counts(text: str | None) -> Counter:
    found: Counter = Counter()
    for part in term_slices(text):
        found.update(part)
    return found


def item_postings(items: DataFrame, block_postings: int = BLOCK_POSTINGS) -> tuple[DataFrame, int]:
    """(item, item_id, term, times, block) of every term of every item, and the number of blocks."""
    numbered = written(items.select("item_id", "text").withColumn("item", F.monotonically_increasing_id()), "items")
    ship(items.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for item, text in zip(batch.column("item"), batch.column("text").to_pylist(), strict=True):
                counts = term_counts(text)
                number = pa.array([item.as_py()] * len(counts), pa.int64())
                yield pa.RecordBatch.from_arrays([number, pa.array(list(counts), pa.binary()), pa.array(counts.values(), pa.int64())], names=["item", "term", "times"])

    found = written(numbered.select("item", "text").mapInArrow(run, "item long, term binary, times long"), "postings")
    blocks = max(1, -(-found.count() // block_postings))
    named = found.join(numbered.select("item", "item_id"), "item")
    return written(named.withColumn("block", F.expr(f"cast(pmod(xxhash64(item), {blocks}) as int)")), "blocks"), blocks


@dataclass
class Index:
    """An inverted index over the items of a block: of each term its items and how often each holds it."""

    terms: dict[bytes, int]
    start: np.ndarray
    item: np.ndarray
    times: np.ndarray
    items: int
    weight: np.ndarray | None = None

    @classmethod
    def of(cls, items: list[int], terms: list[bytes], times: list[int]) -> Index:
        names = {t: i for i, t in enumerate(dict.fromkeys(terms))}
        number = np.array([names[t] for t in terms], np.int64)
        order = np.argsort(number, kind="stable")
        start = np.concatenate(([0], np.cumsum(np.bincount(number, minlength=len(names)))))
        return cls(names, start, np.array(items, np.int64)[order], np.array(times, np.int64)[order], max(items, default=-1) + 1)


def counted(docs: DataFrame, terms: dict[bytes, int]) -> DataFrame:
    """doc_id, number of terms, and the numbers and counts of the indexed terms of every document."""
    shared = docs.sparkSession.sparkContext.broadcast(terms)
    ship(docs.sparkSession)
    schema = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("terms", pa.list_(pa.int32())), ("times", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = shared.value
        for batch in batches:
            totals, found, times = [], [], []
            for text in batch.column("text"):
                total, own = 0, Counter()
                for part in term_slices(text.as_py()):
                    total += len(part)
                    own.update(filter(number.__contains__, part))
                totals.append(total)
                found.append([number[t] for t in own])
                times.append(list(own.values()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(x, f.type) for x, f in zip((totals, found, times), list(schema)[1:], strict=True))], schema=schema)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n long, terms array<int>, times array<long>")


def weights(counts: DataFrame, terms: int) -> tuple[np.ndarray, int, int]:
    """Weight of every indexed term, the number of documents with a term, and the number of all their terms."""
    documents, length = counts.agg(F.count_if(F.col("n") > 0), F.coalesce(F.sum("n"), F.lit(0))).first()
    weight = np.zeros(terms, np.int64)
    # One row for each indexed term of the block.
    for term, df in counts.select(F.explode("terms").alias("t")).groupBy("t").count().collect():
        weight[term] = math.floor(1000 * math.log((2 * documents + 2) / (2 * df + 1)))
    return weight, documents, length


def scores(index: Index, documents: int, length: int, n: list[int], sizes: np.ndarray, terms: np.ndarray, times: np.ndarray) -> np.ndarray:
    """Score of every item for each of a few documents, a row for each."""
    m = np.array([25 + 75 * own * documents // length for own in n], np.int64)
    row = np.repeat(np.arange(len(n)), sizes)
    value = index.weight[terms] * (1_000_000_000 * times // (1000 * times + 8 * m[row]))
    held = index.start[terms + 1] - index.start[terms]
    # Entry j of a term's items, for all terms of all documents in one array.
    within = np.arange(held.sum()) - np.repeat(np.cumsum(held) - held, held)
    entry = np.repeat(index.start[terms], held) + within
    total = np.zeros((len(n), index.items), np.int64)
    np.add.at(total.reshape(-1), np.repeat(row, held) * index.items + index.item[entry], np.repeat(value, held) * index.times[entry])
    return total


class Heaps:
    """The best ``k`` documents of each item seen so far, equal scores by the smaller doc_id, a null one last."""

    def __init__(self, items: int, k: int):
        self.k, self.heaps = k, [[] for _ in range(items)]
        self.least = np.ones(items, np.int64)

    def update(self, doc_ids: list[int | None], total: np.ndarray) -> None:
        for at, item in zip(*np.nonzero(total >= self.least), strict=True):
            heap, doc = self.heaps[item], doc_ids[at]
            entry = int(total[at, item]), doc is not None, -(doc or 0)
            if len(heap) < self.k:
                heapq.heappush(heap, entry)
            else:
                heapq.heappushpop(heap, entry)
        for item in np.flatnonzero((total >= self.least).any(0)).tolist():
            if len(self.heaps[item]) == self.k:
                self.least[item] = max(1, self.heaps[item][0][0])

    def rows(self) -> pa.RecordBatch:
        found = [(i, -e[2] if e[1] else None, e[0]) for i, heap in enumerate(self.heaps) for e in heap]
        columns = list(zip(*found, strict=True)) or [(), (), ()]
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["number", "doc_id", "score"])


def _best_of_tasks(counts: DataFrame, index: Index, documents: int, length: int, k: int) -> DataFrame:
    """number (of the item in the block), doc_id and score: the heaps of every task."""
    shared = counts.sparkSession.sparkContext.broadcast(index)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        heaps = Heaps(index.items, k)
        for batch in batches:
            for low in range(0, batch.num_rows, SCORED):
                part = batch.slice(low, SCORED)
                terms, times = part.column("terms"), part.column("times")
                sizes = np.diff(terms.offsets.to_numpy())
                found = scores(index, documents, length, part.column("n").to_pylist(), sizes, terms.flatten().to_numpy().astype(np.int64), times.flatten().to_numpy())
                heaps.update(part.column("doc_id").to_pylist(), found)
        yield heaps.rows()

    return counts.where("size(terms) > 0").mapInArrow(run, "number long, doc_id long, score long")


def search(docs: DataFrame, items: DataFrame, k: int = 10, block_postings: int = BLOCK_POSTINGS) -> DataFrame:
    """item_id, rank, doc_id and score of the ``k`` best documents of every item (item_id, text)."""
    postings, blocks = item_postings(items, block_postings)
    results = None
    for block in range(blocks):
        # Bounded by block_postings, but for an item with more terms by itself.
        held = postings.where(F.col("block") == block).select("item", "item_id", "term", "times").toArrow().to_pydict()
        numbers = {item: i for i, item in enumerate(dict.fromkeys(held["item"]))}
        if not numbers:
            continue
        index = Index.of([numbers[i] for i in held["item"]], held["term"], held["times"])
        counts = written(counted(docs, index.terms), "term-counts")
        index.weight, documents, length = weights(counts, len(index.terms))
        names = docs.sparkSession.createDataFrame([(i, item) for item, i in numbers.items()], "number long, item long")
        found = _best_of_tasks(counts, index, documents, length, k).withColumn("part", F.pmod(F.spark_partition_id(), F.lit(MERGES)))
        found = found.join(names, "number").select("item", "part", "doc_id", "score")
        results = found if results is None else results.unionByName(found)
    if results is None:
        schema = f"item_id {items.schema['item_id'].dataType.simpleString()}, rank int, doc_id long, score long"
        return docs.sparkSession.createDataFrame([], schema)
    best = [F.desc("score"), F.asc_nulls_last("doc_id")]
    first = F.row_number().over(Window.partitionBy("item", "part").orderBy(*best))
    merged = written(results.withColumn("rank", first).where(F.col("rank") <= k), "heaps")
    last = F.row_number().over(Window.partitionBy("item").orderBy(*best))
    ranked = merged.withColumn("rank", last).where(F.col("rank") <= k)
    names = postings.select("item", "item_id").distinct()
    return ranked.join(names, "item").select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")
