"""Hard negatives by Fagin's threshold algorithm over shards of integer vectors.

The vectors are ordered by label, spread inside a label, and cut into shards of
at most ``SHARD`` rows and ``COMPONENTS`` numbers. A shard is stored once with,
for each dimension, its rows in the order of that component. An anchor reads a
dimension's list from the top where its own component is positive and from the
bottom where it is negative, a few places of all lists at a time. Rows met for the first time are
scored in full by random access. The sum of the anchor's components times the
values last read is the threshold: no row still unread can score above it. An
anchor leaves a shard once the threshold is strictly below the ``k``-th score
of each of its windows, or below the window itself; so ties are never lost.

Positives are one window without bounds over the shards that hold the anchor's
label. Negatives are one window of scores for each positive over all shards.
What an anchor has found in one shard of a task bounds its search in the next.
Anchors are broadcast in blocks of about ``COMPONENTS`` numbers; a block's
results are merged by window functions, first by task, then whole.

Rules for odd input: rows with a null label, a null vector, a null or
non-finite component take no part, nor do rows with a component beyond
``LARGEST`` after scaling, whose products would not fit a long. Vectors of
different lengths count absent components as zero. A null vec_id is no
anchor; as a candidate it comes last of equal scores. Rows are candidates by
themselves, so rows repeated with one vec_id are counted each; only the anchor's
own row is left out. Extra columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tillbook.llm.batches import ship
from tillbook.session import written

SHARD = 4096
# Numbers in the vectors of a shard or of a block of anchors.
COMPONENTS = 1 << 19
# Partitions in which the shards are built.
PARTITIONS = 10_000
SCALE = 256
LARGEST = 1 << 22
# Places of each list read at once, doubled at every step.
FIRST_DEPTH = 32
POSITIVES, NEGATIVES = 5, 3
# Groups in which the results of the tasks first meet.
MERGES = 64

NO_ID = (1 << 63) - 1


def vectors(embeddings: DataFrame, scale: int = SCALE) -> DataFrame:
    """row, vec_id, label and whole-number vector of the rows that take part."""
    scaled = F.transform("embedding", lambda x: F.floor(scale * x.cast("double")))
    sound = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double") * scale) <= LARGEST))
    kept = embeddings.where(F.col("label").isNotNull() & F.col("embedding").isNotNull()).where(sound)
    return kept.select(
        F.monotonically_increasing_id().alias("row"), F.col("vec_id").cast("long").alias("vec_id"),
        F.col("label").cast("long").alias("label"), scaled.cast("array<int>").alias("vector"),
    )


def _matrix(vectors: list[list[int]] | list[np.ndarray], width: int = 0) -> np.ndarray:
    width = max([width, *map(len, vectors)])
    matrix = np.zeros((len(vectors), width), np.int64)
    for row, vector in zip(matrix, vectors, strict=True):
        row[: len(vector)] = vector
    return matrix


class Shard:
    """Rows with a sorted list for each dimension."""

    def __init__(self, row: np.ndarray, vec_id: np.ndarray, label: np.ndarray, matrix: np.ndarray, order: np.ndarray | None = None):
        self.row, self.vec_id, self.label, self.matrix = row, vec_id, label, matrix
        # order[d]: rows by falling value of dimension d.
        self.order = np.argsort(-matrix, axis=0, kind="stable").T.astype(np.int32).copy() if order is None else order
        self.values = np.take_along_axis(matrix.T, self.order, 1)
        self.labels = set(np.unique(label).tolist())
        self.largest = int(np.abs(matrix).max(initial=0))
        self.floats = matrix.astype(float)

    def blocks(self, anchor: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, int | None]]:
        """Rows not met before, their scores, and the threshold for the rows still unread (None if there are none)."""
        count, width = self.matrix.shape
        anchor = anchor[:width]
        # Products and their sums are exact in doubles below 2**53.
        exact = len(anchor) * self.largest * int(np.abs(anchor).max(initial=0)) < 1 << 53
        matrix, own = (self.floats, anchor.astype(float)) if exact else (self.matrix, anchor)
        used = np.flatnonzero(anchor)
        up = anchor[used] > 0
        unread, low, depth = np.ones(count, bool), 0, FIRST_DEPTH
        while low < count and len(used):
            high = min(count, low + depth)
            met = np.zeros(count, bool)
            met[self.order[used[up], low:high]] = True
            met[self.order[used[~up], count - high : count - low]] = True
            new = np.flatnonzero(met & unread)
            unread[new] = False
            last = np.where(up, self.values[used, high - 1], self.values[used, count - high])
            threshold = int(anchor[used] @ last) if unread.any() else None
            yield new, (matrix[new, : len(anchor)] @ own[: len(anchor)]).astype(np.int64), threshold
            if threshold is None:
                return
            low, depth = high, depth * 2
        if unread.any():  # an anchor of zeros
            yield np.flatnonzero(unread), np.zeros(int(unread.sum()), np.int64), None


class Best:
    """The ``k`` best rows of one window of scores, ties by the smaller vec_id, then row."""

    def __init__(self, k: int, low: int | None = None, high: int | None = None):
        self.k, self.low, self.high, self.heap = k, low, high, []

    def update(self, score: np.ndarray, vec_id: np.ndarray, row: np.ndarray) -> None:
        keep = np.ones(len(score), bool)
        if self.low is not None:
            keep &= (score >= self.low) & (score <= self.high)
        if len(self.heap) == self.k:
            keep &= score >= self.heap[0][0]
        at = np.flatnonzero(keep)
        if len(at) > self.k:
            at = at[np.lexsort((row[at], vec_id[at], -score[at]))[: self.k]]
        for s, v, r in zip(score[at].tolist(), vec_id[at].tolist(), row[at].tolist(), strict=True):
            if len(self.heap) < self.k:
                heapq.heappush(self.heap, (s, -v, -r))
            else:
                heapq.heappushpop(self.heap, (s, -v, -r))

    def done(self, threshold: int) -> bool:
        """Whether no row that scores at most ``threshold`` can still count."""
        if self.low is not None and (threshold < self.low or self.low > self.high):
            return True
        return len(self.heap) == self.k and threshold < self.heap[0][0]


def search(shard: Shard, anchor: np.ndarray, allowed: np.ndarray, windows: list[Best]) -> int:
    """Read the shard's lists until no window can change; the number of rows scored."""
    scored = 0
    for new, score, threshold in shard.blocks(anchor):
        scored += len(new)
        keep = allowed[new]
        rows = new[keep]
        for window in windows:
            window.update(score[keep], shard.vec_id[rows], shard.row[rows])
        if threshold is not None and all(w.done(threshold) for w in windows):
            break
    return scored


def build_index(rows: DataFrame, shard: int, partitions: int) -> DataFrame:
    """One row per shard: its rows, ids, labels and vectors, and the sorted list of each dimension."""
    ship(rows.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            for low in range(0, batch.num_rows, shard):
                held.append(batch.slice(low, shard))
                while sum(b.num_rows for b in held) >= shard:
                    table = pa.Table.from_batches(held)
                    yield _packed(table.slice(0, shard))
                    held = table.slice(shard).to_batches()
        if sum(b.num_rows for b in held):
            yield _packed(pa.Table.from_batches(held))

    # Spread inside a label, so that a shard of it looks like any other; the row parts equal ones.
    spread = rows.withColumn("spread", F.xxhash64("row"))
    ranged = spread.repartitionByRange(partitions, "label", "spread").sortWithinPartitions("label", "spread").drop("spread")
    return ranged.mapInArrow(run, "row binary, vec_id binary, label binary, matrix binary, sorted binary, width int")


def _packed(table: pa.Table) -> pa.RecordBatch:
    matrix = _matrix(table.column("vector").to_pylist()).astype(np.int32)
    ids = [NO_ID if v is None else v for v in table.column("vec_id").to_pylist()]
    shard = Shard(*(np.array(x, np.int64) for x in (table.column("row").to_pylist(), ids, table.column("label").to_pylist())), matrix.astype(np.int64))
    parts = [shard.row, shard.vec_id, shard.label, matrix, shard.order]
    return pa.RecordBatch.from_arrays(
        [*(pa.array([p.tobytes()], pa.binary()) for p in parts), pa.array([matrix.shape[1]], pa.int32())],
        names=["row", "vec_id", "label", "matrix", "sorted", "width"],
    )


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[Shard]:
    for batch in batches:
        for i in range(batch.num_rows):
            row = {n: batch.column(n)[i].as_py() for n in batch.schema.names}
            ids = [np.frombuffer(row[n], np.int64) for n in ("row", "vec_id", "label")]
            matrix = np.frombuffer(row["matrix"], np.int32).reshape(len(ids[0]), row["width"]).astype(np.int64)
            yield Shard(*ids, matrix, np.frombuffer(row["sorted"], np.int32).reshape(row["width"], len(ids[0])))


def _search_all(index: DataFrame, anchors: list[tuple], positive: bool, k: int) -> DataFrame:
    """(anchor, window, row, vec_id, score): what each task has found for (row, label, vector, windows) of the anchors."""
    shared = index.sparkSession.sparkContext.broadcast(anchors)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors = [(row, label, np.array(vector, np.int64), [Best(k, *w) for w in windows]) for row, label, vector, windows in shared.value]
        for shard in _shards(batches):
            for row, label, vector, windows in anchors:
                if positive and label not in shard.labels or not positive and shard.labels == {label}:
                    continue
                allowed = (shard.label == label) & (shard.row != row) if positive else shard.label != label
                search(shard, vector, allowed, windows)
        found = [(a[0], w, -r, None if v == -NO_ID else -v, s) for a in anchors for w, best in enumerate(a[3]) for s, v, r in best.heap]
        columns = list(zip(*found, strict=True)) or [()] * 5
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["anchor", "window", "row", "vec_id", "score"])

    return index.mapInArrow(run, "anchor long, window long, row long, vec_id long, score long")


def _merged(found: DataFrame, k: int) -> DataFrame:
    """The ``k`` best of each anchor and window with their rank."""
    order = [F.desc("score"), F.asc_nulls_last("vec_id"), F.asc("row")]
    part = F.pmod(F.spark_partition_id(), F.lit(MERGES))
    first = F.row_number().over(Window.partitionBy("anchor", "window", "part").orderBy(*order))
    few = found.withColumn("part", part).withColumn("rank", first).where(F.col("rank") <= k).drop("rank", "part")
    last = F.row_number().over(Window.partitionBy("anchor", "window").orderBy(*order))
    return few.withColumn("rank", last).where(F.col("rank") <= k)


def band(positive: int) -> tuple[int, int]:
    """Lowest and highest score of a negative: half the positive's to 95 hundredths of it."""
    return -(-50 * positive // 100), 95 * positive // 100


def mine(embeddings: DataFrame, is_anchor: Column, label: Column | None = None, shard: int = SHARD, components: int = COMPONENTS) -> DataFrame:
    """Negatives of each anchor (a condition on ``vec_id``) and positive.

    ``label`` is an expression over ``vec_id`` and ``label`` that replaces the label.
    """
    spark = embeddings.sparkSession
    rows = vectors(embeddings)
    rows = written(rows if label is None else rows.withColumn("label", label), "vectors")
    count, width = rows.agg(F.count("*"), F.max(F.greatest(F.size("vector"), F.lit(1)))).first()
    shard = max(1, min(shard, components // (width or 1)))
    index = written(build_index(rows, shard, max(1, min(PARTITIONS, -(-count // shard)))), "shards")
    chosen = rows.where(is_anchor & F.col("vec_id").isNotNull())
    numbers = chosen.agg(F.coalesce(F.sum(F.size("vector")), F.lit(0))).first()[0]
    blocks = max(1, -(-numbers // components))
    results = None
    for block in range(blocks):
        own = chosen.where(F.pmod(F.xxhash64("row"), F.lit(blocks)) == block).select("row", "vec_id", "label", "vector").collect()
        named = {a.row: a for a in own}
        if not named:
            continue
        found = _search_all(index, [(a.row, a.label, a.vector, [()]) for a in own], True, POSITIVES)
        positives = _merged(found, POSITIVES).select("anchor", "rank", "vec_id", "score").collect()
        windows: dict[int, list] = {}
        for p in sorted(positives, key=lambda p: p["rank"]):
            windows.setdefault(p.anchor, []).append(p)
        asked = [(row, named[row].label, named[row].vector, [band(p.score) for p in found]) for row, found in windows.items()]
        best = _merged(_search_all(index, asked, False, NEGATIVES), NEGATIVES)
        sides = [(row, w, named[row].vec_id, p.vec_id, p.score) for row, found in windows.items() for w, p in enumerate(found)]
        side = spark.createDataFrame(sides, "anchor long, window long, anchor_id long, positive_id long, positive_score long")
        found = written(best.join(side, ["anchor", "window"]), "negatives")
        results = found if results is None else results.unionByName(found)
    if results is None:
        return spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    return results.select(
        "anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("vec_id").alias("negative_id"),
        "positive_score", F.col("score").alias("negative_score"),
    )
