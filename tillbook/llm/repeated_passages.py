"""Repeated passages by distributed prefix doubling over sampled positions.

A byte goes if some string of ``length`` bytes that covers it also starts
earlier. Positions get ranks for ever longer prefixes: 32 bytes, then 64, then
``length``, each rank made of the pair of ranks at the position and at an offset.
Spark sorts (rank, content, position) rows over the whole corpus; a position
whose rank is unique has no repeat and drops out, the others go on to the next
offset until they are past the threshold. Two things keep the sorts small:

* Sampling. Every string of ``length`` bytes holds a lowest rank among its
  prefixes of the round's size, chosen by content alone, and neighbouring
  strings mostly share it. They are one *span*: a row stands for some 35 strings
  in the first round and for one in the last, where prefix and string are one.
* Equal spans. If a span equals an earlier one as a whole, all of its strings
  start earlier as well: it is removed and asks nothing more. Only the first of
  equal spans goes on, and only if another span shares its rank.

Ranks up to the first 32 bytes are paired inside the task that holds the text.
The sorts are by range over the whole row, so a rank or a span that fills a
third of the corpus lies in as many partitions as it needs; neighbours are
compared across partitions by their first and last rows, two for each partition.
Equal spans of a task meet there before they are sent. Strings are taken as
equal if two 64-bit hashes are.

Rules for odd input: a null text is empty; texts shorter than ``length`` keep
all bytes. Earlier means smaller doc_id, a null one last; rows that share a
doc_id go in the order of a hash of their text, and of rows equal in both one
counts as first. Extra columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tillbook.llm.batches import ship
from tillbook.session import written

LENGTH = 100
FIRST = 32
# Bytes ranked at once; places in them fit 24 bits.
BUFFER = 1 << 20
PLACE = np.uint64((1 << 24) - 1)
SEED = 42

DROP, OPEN, EDGE, LOW, HIGH = range(5)


def rounds(length: int, first: int = FIRST) -> list[int]:
    """Sizes of the prefixes ranked: doubled until past the threshold."""
    if min(length, first) < 8:
        raise ValueError("prefixes have 8 bytes or more")
    sizes = [min(first, length)]
    while sizes[-1] < length:
        sizes.append(min(2 * sizes[-1], length))
    return sizes


def _pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    x = a * np.uint64(0x9E3779B97F4A7C15) + b
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


def ranks(data: bytes, size: int) -> np.ndarray:
    """Rank of the ``size`` >= 8 bytes from each place, by pairs at growing offsets."""
    rank = np.ndarray(max(0, len(data) - 7), "<u8", data, strides=(1,))
    held = 8
    while held < size:
        offset = min(held, size - held)
        rank = _pair(rank[:-offset], rank[offset:])
        held += offset
    return rank


def _lowest(rank: np.ndarray, width: int) -> np.ndarray:
    """Place of the lowest rank among ``width`` from each place, the leftmost of equal ones."""
    low = (rank & ~PLACE) | np.arange(len(rank), dtype=np.uint64)
    held = 1
    while held < width:
        offset = min(held, width - held)
        low = np.minimum(low[:-offset], low[offset:])
        held += offset
    return (low & PLACE).astype(np.int64)


def spans(data: bytes, starts: np.ndarray, ends: np.ndarray, size: int, length: int) -> tuple[np.ndarray, ...]:
    """Segment, place, number of strings, rank and content hash of the spans of segments laid side by side."""
    none = np.zeros(0, np.int64)
    long = ends - starts >= length
    if not long.any():
        return none, none, none, none, none
    rank = ranks(data, size)
    low = _lowest(rank, length - size + 1)
    edge = np.zeros(len(low) + 1, np.int64)
    np.add.at(edge, starts[long], 1)
    np.add.at(edge, ends[long] - length + 1, -1)
    at = np.flatnonzero(np.cumsum(edge[:-1]))
    chosen = low[at]
    new = np.flatnonzero(np.concatenate(([True], (chosen[1:] != chosen[:-1]) | (at[1:] != at[:-1] + 1))))
    place, count = at[new], np.diff(np.append(new, len(at)))
    digest, more = xxhash.xxh64_intdigest, length - 1
    content = np.array([digest(data[p : p + n + more], SEED) for p, n in zip(place.tolist(), count.tolist(), strict=True)], np.uint64)
    owner = np.searchsorted(starts, place, "right") - 1
    return owner, place, count, rank[chosen[new]].view(np.int64), content.view(np.int64)


def _buffers(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[tuple[bytes, np.ndarray, np.ndarray, np.ndarray]]:
    """Texts laid side by side: bytes, places of their starts and ends, and (earlier, tie, start) of each.

    A text longer than a buffer is cut, with all but one byte of a string repeated.
    """
    parts: list[bytes] = []
    keys: list[tuple] = []
    held = 0

    def laid() -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray]:
        ends = np.cumsum([len(p) for p in parts])
        return b"".join(parts), ends - [len(p) for p in parts], ends, np.array(keys, np.int64).reshape(-1, 3)

    for batch in batches:
        for earlier, tie, start, data in zip(*(batch.column(n) for n in ("earlier", "tie", "start", "data")), strict=True):
            data, key = memoryview(data.as_buffer()), (earlier.as_py(), tie.as_py())
            for at in range(0, max(1, len(data) - length + 1), BUFFER):
                part = bytes(data[at : at + BUFFER + length - 1])
                if len(part) < length:
                    continue
                if held and held + len(part) > BUFFER:
                    yield laid()
                    parts, keys, held = [], [], 0
                parts.append(part)
                keys.append((*key, start.as_py() + at))
                held += len(part)
    if parts:
        yield laid()


SPAN = "rank long, content long, earlier long, tie long, start long, strings long"


def _first_of_equal(rows: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Which rows go on, and which are removed as they equal an earlier one of the task."""
    count = len(rows["content"])
    stays, drops = np.ones(count, bool), np.zeros(count, bool)
    _, group, size = np.unique(rows["content"], return_inverse=True, return_counts=True)
    again = np.flatnonzero(size[group] > 1)
    if len(again):
        keys = [rows[n][again] for n in ("start", "tie", "earlier", "rank", "content")]
        again = again[np.lexsort(keys)]
        same = np.concatenate(([False], _equal(rows, again, ("content", "rank"))))
        stays[again[same]] = False
        # A row told twice is no repeat of itself.
        place = ("earlier", "tie", "start")
        head = np.maximum.accumulate(np.where(same, 0, np.arange(len(again))))
        twice = np.logical_and.reduce([rows[n][again] == rows[n][again[head]] for n in place])
        drops[again[same & ~twice]] = True
    return stays, drops


def _equal(rows: dict[str, np.ndarray], at: np.ndarray, names: tuple) -> np.ndarray:
    return np.logical_and.reduce([rows[n][at[1:]] == rows[n][at[:-1]] for n in names])


def _joined(rows: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """Removed spans with those that follow them directly as one."""
    order = np.lexsort([rows[n] for n in ("start", "tie", "earlier")])
    rows = {n: v[order] for n, v in rows.items()}
    end = rows["start"] + rows["strings"]
    new = np.ones(len(order), bool)
    if len(order):
        new[1:] = (rows["earlier"][1:] != rows["earlier"][:-1]) | (rows["tie"][1:] != rows["tie"][:-1]) | (rows["start"][1:] > end[:-1])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(order))[: len(first)] - 1
    found = {n: v[first] for n, v in rows.items()}
    return found | {"strings": end[last] - found["start"]}


def _spans(texts: DataFrame, size: int, length: int, carry: bool) -> DataFrame:
    """Spans of texts (earlier, tie, start, data); removed ones have a negative number of strings.

    With ``carry`` spans that go on take their bytes with them.
    """
    ship(texts.sparkSession)
    names = ("rank", "content", "earlier", "tie", "start", "strings")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for data, starts, ends, keys in _buffers(batches, length):
            owner, place, count, rank, content = spans(data, starts, ends, size, length)
            earlier, tie, start = keys[owner].T
            rows = {"rank": rank, "content": content, "earlier": earlier, "tie": tie, "start": start + place - starts[owner], "strings": count}
            stays, drops = _first_of_equal(rows)
            gone = _joined({n: v[drops] for n, v in rows.items()})
            # A removed span meets no other; its place spreads it.
            gone["rank"] = _pair(gone["earlier"].view(np.uint64), gone["start"].view(np.uint64)).view(np.int64)
            gone["strings"] = -gone["strings"]
            columns = [pa.array(np.concatenate((rows[n][stays], gone[n]))) for n in names]
            if carry:
                kept = zip(place[stays].tolist(), count[stays].tolist(), strict=True)
                columns.append(pa.array([data[p : p + n + length - 1] for p, n in kept] + [None] * len(gone["rank"]), pa.binary()))
            yield pa.RecordBatch.from_arrays(columns, names=[*names, *["data"] * carry])

    return texts.mapInArrow(run, SPAN + ", data binary" * carry)


def _ranked(found: DataFrame, carry: bool) -> DataFrame:
    """Spans with a ``kind``: removed, open for the next round, or at a partition's edge; unique ones go."""
    keys = ["rank", "content", "earlier", "tie", "start"]
    columns = [*keys, "strings", *["data"] * carry]
    ordered = found.select(*columns).repartitionByRange(*keys).sortWithinPartitions(*keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        begin = last = waiting = None
        alike = alone = False

        def out(rows: pa.RecordBatch, kind: int) -> pa.RecordBatch:
            fixed = [pa.array([v] * rows.num_rows, pa.int32()) for v in (part, kind)]
            return pa.RecordBatch.from_arrays(fixed + rows.columns, names=["part", "kind", *columns])

        for batch in batches:
            count = batch.column("strings").to_numpy()
            if (count < 0).any():
                yield out(batch.filter(pa.array(count < 0)), DROP)
                batch = batch.filter(pa.array(count > 0))
            if not batch.num_rows:
                continue
            own = np.array([batch.column(n).to_numpy() for n in keys])
            equal = own == np.concatenate((own[:, :1] if last is None else last, own[:, :-1]), axis=1)
            if last is None:
                equal[:, 0], begin = False, own[:2, 0].tolist()
            last = own[:, -1:]
            same = equal[0] & equal[1]
            # A row told twice is no repeat of itself.
            yield out(batch.filter(pa.array(same & ~equal[2:].all(0))), DROP)
            heads = batch.filter(pa.array(~same))
            if not heads.num_rows:
                continue
            # The first of equal spans is open if the one before or behind has the same rank; the last one waits for its next.
            rank = heads.column("rank").to_numpy()
            tied = np.append(False, rank[1:] == rank[:-1])
            if waiting is not None:
                tied[0] = waiting.column("rank")[0].as_py() == rank[0]
                if alike or tied[0] or alone:
                    yield out(waiting, OPEN if alike or tied[0] else EDGE)
            elif len(rank) > 1 and not tied[1]:
                yield out(heads.slice(0, 1), EDGE)
            yield out(heads.slice(0, len(rank) - 1).filter(pa.array(tied[:-1] | tied[1:])), OPEN)
            alone = waiting is None and len(rank) == 1
            waiting, alike = heads.slice(len(rank) - 1), bool(tied[-1])
        if waiting is not None:
            yield out(waiting, OPEN if alike else EDGE)
            ends = {"rank": [begin[0], int(last[0, 0])], "content": [begin[1], int(last[1, 0])]}
            arrays = [pa.array(ends.get(n, [None, None]), batch.schema.field(n).type) for n in columns]
            kinds = [pa.array(v, pa.int32()) for v in ([part, part], [LOW, HIGH])]
            yield pa.RecordBatch.from_arrays(kinds + arrays, names=["part", "kind", *columns])

    schema = f"part int, kind int, {SPAN}" + ", data binary" * carry
    return _across(written(ordered.mapInArrow(run, schema), "ranked"))


def _across(ranked: DataFrame) -> DataFrame:
    """What the edges of the partitions are, by their neighbours: two rows for each partition, on the driver."""
    bounds: dict[int, dict[int, tuple]] = {}
    for row in ranked.where(F.col("kind") >= LOW).select("part", "kind", "rank", "content").collect():
        bounds.setdefault(row["part"], {})[row["kind"]] = (row["rank"], row["content"])
    known: dict[tuple, int] = {}
    parts = sorted(bounds)
    for left, right in zip(parts, parts[1:], strict=False):
        end, begin = bounds[left][HIGH], bounds[right][LOW]
        if end[0] == begin[0]:
            known.setdefault((left, *end), OPEN)
            known[right, *begin] = DROP if end == begin else OPEN
    spark = ranked.sparkSession
    fixes = spark.createDataFrame([(*k, v) for k, v in known.items()], "part int, rank long, content long, known int")
    fixed = ranked.where(F.col("kind") < LOW).join(fixes, ["part", "rank", "content"], "left")
    kind = F.when(F.col("kind") == DROP, F.col("kind")).otherwise(F.coalesce("known", "kind"))
    return fixed.withColumn("kind", kind).drop("known", "part").where(F.col("kind") != EDGE)


def _keyed(docs: DataFrame) -> tuple[DataFrame, bool]:
    """doc_id, order of the rows as (earlier, tie) and bytes; whether rows may share an order."""
    doc_id = F.col("doc_id").cast("long")
    ids = docs.select(doc_id.alias("doc_id"))
    shared = not ids.groupBy("doc_id").count().where("count > 1 OR doc_id IS NULL").isEmpty()
    tie: Column = F.xxhash64("text") if shared else F.lit(0).cast("long")
    data = F.coalesce(F.col("text").cast("binary"), F.lit(b""))
    return docs.select(doc_id.alias("doc_id"), F.coalesce(doc_id, F.lit((1 << 63) - 1)).alias("earlier"), tie.alias("tie"), data.alias("data")), shared


def _lists(rows: DataFrame) -> DataFrame:
    """Starts and numbers of strings of the spans of each text, as many as the text has at most."""
    held = rows.groupBy("earlier", "tie").agg(F.collect_list(F.struct("start", "strings")).alias("held"))
    return held.select("earlier", "tie", F.col("held.start").alias("starts"), F.col("held.strings").alias("counts"))


def _fetched(keyed: DataFrame, opened: DataFrame, length: int) -> DataFrame:
    """Open spans with their bytes (earlier, tie, start, data)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for earlier, tie, data, starts, counts in zip(*(batch.column(n) for n in ("earlier", "tie", "data", "starts", "counts")), strict=True):
                key, data = (earlier.as_py(), tie.as_py()), data.as_py()
                rows += [(*key, s, data[s : s + n + length - 1]) for s, n in zip(starts.as_py(), counts.as_py(), strict=True)]
            if rows:
                columns = zip(*rows, strict=True)
                types = pa.int64(), pa.int64(), pa.int64(), pa.binary()
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["earlier", "tie", "start", "data"])

    texts = keyed.drop("doc_id").join(_lists(opened), ["earlier", "tie"])
    return texts.mapInArrow(run, "earlier long, tie long, start long, data binary")


def _repeated(keyed: DataFrame, length: int, first: int) -> DataFrame:
    """Spans whose strings all start earlier: earlier, tie, start and the number of strings."""
    texts = keyed.withColumn("start", F.lit(0).cast("long"))
    every, sizes = None, rounds(length, first)
    for at, size in enumerate(sizes):
        # Open spans leave the first round without their bytes and bring them from then on.
        carry = 0 < at < len(sizes) - 1
        held = texts.select("earlier", "tie", "start", "data").where(F.octet_length("data") >= length)
        ranked = _ranked(_spans(held, size, length, carry), carry)
        gone = ranked.where(F.col("kind") == DROP).select("earlier", "tie", "start", F.abs("strings").alias("strings"))
        every = gone if every is None else every.unionByName(gone)
        if size < length:
            opened = ranked.where(F.col("kind") == OPEN)
            texts = opened if carry else _fetched(keyed, opened, length)
    return every


def _kept(data: bytes, starts: np.ndarray, counts: np.ndarray, length: int) -> tuple[bytes, list[int], list[int]]:
    """The bytes that stay, and start and size of every maximal run that goes."""
    order = np.argsort(starts, kind="stable")
    low, high = starts[order], np.maximum.accumulate((starts + counts + length - 1)[order])
    new = np.flatnonzero(np.concatenate(([True], low[1:] > high[:-1])))
    low, high = low[new].tolist(), high[np.append(new[1:], len(high)) - 1].tolist()
    pieces = [data[a:b] for a, b in zip([0, *high], [*low, len(data)], strict=True)]
    return b"".join(pieces), low, [b - a for a, b in zip(low, high, strict=True)]


def remove_repeats(docs: DataFrame, length: int = LENGTH, first: int = FIRST) -> DataFrame:
    """doc_id, n_bytes, the bytes that stay (``kept``) and the runs that go (``removed``: start and size) of every row."""
    keyed, shared = _keyed(docs)
    lists = _lists(_repeated(keyed, length, first))
    schema = "doc_id long, earlier long, tie long, n_bytes long, kept binary, starts array<long>, sizes array<long>"
    types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int64())]
    names = ["doc_id", "earlier", "tie", "n_bytes", "kept", "starts", "sizes"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, kept, low, high = [], [], [], []
            for data, starts, counts in zip(*(batch.column(n) for n in ("data", "starts", "counts")), strict=True):
                data, found = data.as_py(), ([], [])
                sizes.append(len(data))
                if starts.is_valid:
                    data, *found = _kept(data, starts.values.to_numpy(), counts.values.to_numpy(), length)
                kept.append(data)
                low.append(found[0])
                high.append(found[1])
            more = [pa.array(c, t) for c, t in zip((sizes, kept, low, high), types[3:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(n) for n in names[:3]] + more, names=names)

    found = keyed.join(lists, ["earlier", "tie"], "left").select("doc_id", "earlier", "tie", "data", "starts", "counts").mapInArrow(run, schema)
    if shared:
        # Of rows equal in doc_id and text the others repeat the first.
        again = F.row_number().over(Window.partitionBy("earlier", "tie").orderBy(F.asc_nulls_last("doc_id"))) > 1
        found = found.withColumn("again", again & (F.col("n_bytes") >= length))
        found = found.withColumns({
            "kept": F.when(F.col("again"), F.lit(b"")).otherwise(F.col("kept")),
            "starts": F.when(F.col("again"), F.array(F.lit(0).cast("long"))).otherwise(F.col("starts")),
            "sizes": F.when(F.col("again"), F.array("n_bytes")).otherwise(F.col("sizes")),
        })
    removed = F.zip_with("starts", "sizes", lambda a, b: F.struct(a.alias("start"), b.alias("size")))
    return found.select("doc_id", "n_bytes", "kept", removed.alias("removed"))
