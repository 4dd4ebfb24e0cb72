"""Best-fit packing of token sequences as vectors.

A piece needs tokens, one document place and attention cost (the square of its
length); a sequence has a capacity of each. Pieces go in order of falling
length, each into the open sequence that fits under every constraint and is
best by the rule: the smallest norm of the residual that would be left, or the
smallest weighted dot product of need and residual.

Documents are encoded in one scan that keeps a few numbers per piece. The
pieces, spread by hash over groups of bounded size, are then packed group by
group; full pieces are sequences by themselves. A group of ``GROUP`` pieces
leaves a few sequences part-filled, which is the whole price of not packing all
pieces in one task.

Rules for odd input: a null or empty text is the single end id. Rows repeated
with one doc_id are packed as often as they occur. A null doc_id is carried.
Extra columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import math
import zlib
from collections import defaultdict
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillbook.llm import tokens
from tillbook.llm.batches import map_lists, ship
from tillbook.session import written

LENGTH = 2048
END_ID = 0
# Pieces packed together in one task.
GROUP = 20_000


@dataclass(frozen=True)
class Capacity:
    """What a sequence holds; the default bounds of documents and attention never bind before tokens do."""

    tokens: int = LENGTH
    documents: int = LENGTH
    attention: int = LENGTH * LENGTH

    def vector(self) -> tuple[int, int, int]:
        return self.tokens, self.documents, self.attention

    def longest(self) -> int:
        """The longest piece that a sequence can hold."""
        return min(self.tokens, math.isqrt(self.attention))


WEIGHTS = (1.0, 0.05, 0.05)


def pieces(docs: DataFrame, path: str, length: int = LENGTH, end_id: int = END_ID) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every document cut to ``length``."""

    def run(columns: dict[str, list]) -> dict[str, list]:
        encoder, out = tokens.word_encoder(path), defaultdict(list)
        end = np.array([end_id], "<u4").tobytes()
        for doc_id, text in zip(columns["doc_id"], columns["text"], strict=True):
            ids = encoder.ids(text or "") + end
            for piece, at in enumerate(range(0, len(ids), 4 * length)):
                part = ids[at : at + 4 * length]
                row = (doc_id, piece, at // 4, len(part) // 4, zlib.crc32(part))
                for name, value in zip(("doc_id", "piece", "start", "length", "ids_crc32"), row, strict=True):
                    out[name].append(value)
        return {n: out[n] for n in ("doc_id", "piece", "start", "length", "ids_crc32")}

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long"
    return map_lists(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run, schema)


def best_fit(lengths: np.ndarray, capacity: Capacity, rule: str = "norm", weights=WEIGHTS) -> tuple[np.ndarray, np.ndarray]:
    """Sequence number and offset of every piece, for lengths in falling order.

    ``norm`` takes the smallest weighted norm of the residual that would be
    left, ``dot`` the smallest weighted dot product of need and residual: the
    sequence with the least to spare in the directions that the piece needs.
    """
    full = np.array(capacity.vector(), float)
    scale = np.array(weights) / full**2
    count = len(lengths)
    left = np.empty((3, count))
    name = np.empty(count, np.int64)
    sequence, offset = np.empty(count, np.int64), np.empty(count, np.int64)
    smallest = float(lengths[-1]) if count else 0.0
    live = opened = 0
    for i, length in enumerate(lengths.tolist()):
        need = np.array([[length], [1.0], [float(length) ** 2]])
        if (need[:, 0] > full).any():
            raise ValueError(f"a piece of {length} tokens exceeds the capacity")
        now = left[:, :live]
        spare = now - need
        if rule == "norm":
            cost = scale @ (spare * spare)
        else:
            cost = (scale * need[:, 0]) @ now
        cost[(spare < 0).any(0)] = np.inf
        at = int(cost.argmin()) if live else -1
        if at < 0 or cost[at] == np.inf:
            at, live = live, live + 1
            left[:, at], name[at] = full, opened
            opened += 1
        sequence[i], offset[i] = name[at], int(full[0] - left[0, at])
        left[:, at] -= need[:, 0]
        if left[0, at] < smallest or left[1, at] < 1:  # nothing more fits: closed
            live -= 1
            left[:, at], name[at] = left[:, live], name[live]
    return sequence, offset


def pack(cut: DataFrame, capacity: Capacity = Capacity(), rule: str = "norm", group: int = GROUP) -> DataFrame:
    """Add sequence_id and offset to pieces (columns of ``pieces``)."""
    cut = written(cut, "pieces")
    part = cut.where(F.col("length") < capacity.tokens)
    whole = cut.where(F.col("length") >= capacity.tokens)
    groups = max(1, -(-part.count() // group))
    # Numbered by place in the written table, so that repeated rows spread as well.
    dealt = part.withColumn("group", F.expr(f"cast(pmod(xxhash64(monotonically_increasing_id()), {groups}) as int)"))
    ship(cut.sparkSession)

    # Arrow and not pandas, where a null among the ids would turn them all into doubles.
    def run(rows: pa.Table) -> pa.Table:
        order = [("length", "descending"), *((n, "ascending") for n in ("doc_id", "piece", "ids_crc32"))]
        rows = rows.sort_by(order)
        sequence, offset = best_fit(rows.column("length").to_numpy(), capacity, rule)
        names = rows.column("group").to_numpy().astype(np.int64) * (1 << 32) + sequence
        packed = rows.drop_columns("group")
        return packed.append_column("sequence_id", pa.array(names)).append_column("offset", pa.array(offset))

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in cut.schema) + ", sequence_id long, offset long"
    alone = whole.select("*", (-1 - F.monotonically_increasing_id()).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return dealt.groupBy("group").applyInArrow(run, schema).union(alone)


def packed(docs: DataFrame, path: str, capacity: Capacity = Capacity(), rule: str = "norm", group: int = GROUP) -> DataFrame:
    """Every piece of every document with its sequence and its place there."""
    return pack(pieces(docs, path, capacity.longest()), capacity, rule, group)
