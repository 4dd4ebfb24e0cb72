"""Language of a text by n-gram filters that hold a bitmask of languages per cell.

One pass counts, for every language and every cell of a fixed array, the
training documents with an n-gram that hashes there; tasks add up their own
documents first. A language's bit is set in the cells whose share of its
documents is not far below the best language's. So an n-gram's cells, their
masks combined by AND, give all languages whose Bloom filter holds it. A text
is scored by popcounts: the n-grams each language holds, less what its filter
would hold by chance. The array has ``CELLS`` cells whatever the corpus, which
bounds the counts of a task, the rows sent to the driver and the broadcast.

Rules for odd input: a null text, or one without a letter, is ``und`` with score
0. Rows without lang teach nothing. Without any training row everything is
``und``. A text that no language holds goes to the language with most training
documents, with score 0. Ties go to the first language in alphabetical order.
Repeated rows each count and each get a row; a null doc_id counts as the empty
text where rows are held out. Extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillbook.llm.batches import BATCH_ROWS, held_out, map_lists, ship
from tillbook.session import written

CELLS = 1 << 20
SIZES = (2, 3, 4)
HASHES = 2
# A language holds a cell if its share of documents there is this part of the largest, and not below the least share.
RELATIVE_SHARE = 0.1
LEAST_SHARE = 0.0005
# Languages of one mask; more languages take more masks.
PLANE = 63

WORD = re.compile(r"[^\W\d_]+")
UNDETERMINED = "und"
_ODD = np.uint64(0x9E3779B97F4A7C15)


def cells_of(text: str | None) -> tuple[np.ndarray, ...] | None:
    """Cells of the n-grams of the text's words, one array per hash; None without a letter."""
    # Numbers such as a half or a Roman eight are parts of words for a pattern, but no letters.
    if not any(map(str.isalpha, text or "")):
        return None
    words = WORD.findall(text.lower())
    codes = np.frombuffer((" " + " ".join(words) + " ").encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    inner = codes != 32
    found = []
    for size in SIZES:
        count = len(codes) - size + 1
        if count < 1:
            continue
        mixed = np.full(count, size, np.uint64)
        whole = np.ones(count, bool)
        for place in range(size):
            mixed = (mixed ^ codes[place : place + count]) * _ODD
            mixed ^= mixed >> np.uint64(29)
            if 0 < place < size - 1:
                whole &= inner[place : place + count]
        found.append(mixed[whole])
    grams = np.concatenate(found)
    return tuple(((grams >> np.uint64(20 * i)) & np.uint64(CELLS - 1)).astype(np.int32) for i in range(HASHES))


@dataclass
class Model:
    """Languages, the masks of all cells by plane, and each language's rate of chance hits."""

    languages: list[str]
    masks: np.ndarray
    chance: np.ndarray
    fallback: int

    def predict(self, text: str | None) -> tuple[str, float]:
        cells = cells_of(text) if self.languages else None
        if cells is None:
            return UNDETERMINED, 0.0
        hits = np.empty(len(self.languages))
        for plane, masks in enumerate(self.masks):
            both = masks[cells[0]]
            for more in cells[1:]:
                both = both & masks[more]
            low = plane * PLANE
            for bit in range(min(PLANE, len(self.languages) - low)):
                hits[low + bit] = np.count_nonzero(both & np.int64(1 << bit))
        fair = np.maximum(hits - len(cells[0]) * self.chance, 0) / np.maximum(1 - self.chance, 1e-9)
        total = float(fair.sum())
        if not total:
            return self.languages[self.fallback], 0.0
        best = int(fair.argmax())
        return self.languages[best], float(fair[best] / total)


def _cell_counts(training: DataFrame) -> DataFrame:
    """Documents by language and cell; cell -1 holds all documents of the language."""
    ship(training.sparkSession)
    training.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, np.ndarray] = {}
        for batch in batches:
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
                own = counts.setdefault(lang, np.zeros(CELLS + 1, np.int32))
                own[CELLS] += 1
                cells = cells_of(text)
                if cells is not None:
                    own[np.unique(np.concatenate(cells))] += 1
        for lang, own in counts.items():
            used = np.flatnonzero(own).astype(np.int32)
            columns = [pa.array([lang] * len(used)), pa.array(np.where(used == CELLS, -1, used).astype(np.int32)), pa.array(own[used].astype(np.int64))]
            yield pa.RecordBatch.from_arrays(columns, names=["lang", "cell", "docs"])

    parts = training.select("lang", "text").mapInArrow(run, "lang string, cell int, docs long")
    return parts.groupBy("cell", "lang").agg(F.sum("docs").alias("docs"))


def train(training: DataFrame) -> Model:
    """Learn from the rows of ``training`` (text, lang) that have a lang."""
    counts = written(_cell_counts(training.where("lang IS NOT NULL").select("text", "lang")), "cells")
    totals = {r["lang"]: r["docs"] for r in counts.where("cell = -1").collect()}
    languages = sorted(totals)
    if not languages:
        return Model([], np.zeros((1, CELLS), np.int64), np.zeros(0), 0)
    spark = training.sparkSession
    sizes = spark.createDataFrame([(n, i, totals[n]) for i, n in enumerate(languages)], "lang string, number int, total long")
    shares = counts.where("cell >= 0").join(F.broadcast(sizes), "lang").select("cell", "number", (F.col("docs") / F.col("total")).alias("share"))
    best = shares.groupBy("cell").agg(F.collect_list(F.struct("number", "share")).alias("own"), F.max("share").alias("best"))
    held = best.select("cell", F.expr(f"filter(own, o -> o.share >= {LEAST_SHARE} AND o.share >= {RELATIVE_SHARE} * best)").alias("own"))
    masks = np.zeros((-(-len(languages) // PLANE), CELLS), np.int64)
    for plane in range(len(masks)):
        bits = F.expr(f"aggregate(own, 0L, (m, o) -> IF(o.number div {PLANE} = {plane}, m | shiftleft(1L, o.number % {PLANE}), m))")
        # At most CELLS rows of two numbers.
        rows = held.select("cell", bits.alias("mask")).where("mask <> 0").toArrow()
        masks[plane][rows.column("cell").to_numpy()] = rows.column("mask").to_numpy()
    filled = [np.count_nonzero(masks[i // PLANE] & np.int64(1 << i % PLANE)) / CELLS for i in range(len(languages))]
    return Model(languages, masks, np.array(filled) ** HASHES, int(np.argmax([totals[n] for n in languages])))


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred, score of every document."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(columns: dict[str, list]) -> dict[str, list]:
        found = [shared.value.predict(t) for t in columns["text"]]
        return {"doc_id": columns["doc_id"], "lang_pred": [f[0] for f in found], "score": [f[1] for f in found]}

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return map_lists(rows, run, "doc_id long, lang_pred string, score double")


def identify(docs: DataFrame, modulus: int = 4, remainder: int = 2) -> DataFrame:
    """Learn from the rows not held out, predict all: doc_id, held_out, lang_pred, score."""
    found = predict(docs, train(docs.where(~held_out(modulus, remainder))))
    return found.select("doc_id", held_out(modulus, remainder).alias("held_out"), "lang_pred", "score")
