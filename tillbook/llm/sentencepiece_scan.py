"""SentencePiece encoding as a max-plus scan over chunks, and decoding.

Encoding a text is a best path through the lattice of pieces that match it. A
step from piece u to piece t weighs 0 if t may follow u, else minus infinity:
for a merge model t may follow u if encoding the two together gives just these
two, and a path all of whose steps are allowed is the library's encoding, the
only one. So at a chunk's boundary the state is the piece that reaches over it,
or ends at it, and a chunk is a matrix from states at its left to states at its
right boundary. Matrices multiply in the max-plus semiring, which is
associative: blocks of chunks are combined first, then the blocks, then every
chunk learns its two boundary states and is backtraced by itself.

No piece reaches over the start of a word. There all paths of a chunk meet, so a
matrix needs the letters before the first and behind the last word start only,
and the words between are looked up. A chunk without a word start is scanned as
a whole. A document of one chunk has no boundary inside and skips the matrices.

Rules for odd input: a null or empty text has no tokens. Documents are told
apart by row, so repeated rows and null doc_ids each give a row. Extra columns
are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from functools import cache, reduce

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillbook.llm.batches import map_lists, ship
from tillbook.session import written

CHUNK = 16_384
BLOCK = 64
MEMORY_WORDS = 400_000
SPACE = "▁"

# A state is (characters beyond the boundary, last piece); these two stand for the ends of a text.
START = (0, -1)
STOP = (0, -2)
State = tuple[int, int]
Matrix = dict[State, dict[State, float]]


class Pieces:
    """A merge model's pieces, and what may follow what."""

    def __init__(self, path: str):
        import sentencepiece

        self.lib = sentencepiece.SentencePieceProcessor(model_file=path)
        special = (self.lib.is_control, self.lib.is_unknown, self.lib.is_byte, self.lib.is_unused)
        numbers = range(self.lib.get_piece_size())
        self.id = {self.lib.id_to_piece(i): i for i in numbers if not any(f(i) for f in special)}
        self.text = {i: p for p, i in self.id.items()}
        self.score = {p: self.lib.get_score(i) for p, i in self.id.items()}
        self.byte = {int(self.lib.id_to_piece(i)[1:-1], 16): i for i in numbers if self.lib.is_byte(i)}
        self.spelled = [self.text.get(i, "").encode("utf-8") for i in numbers]
        for value, i in self.byte.items():
            self.spelled[i] = bytes([value])
        self.opens = np.array([self.text.get(i, "").startswith(SPACE) for i in numbers])
        self.lengths = np.array([len(s) for s in self.spelled])
        self.places = np.cumsum(self.lengths) - self.lengths
        self.bytes = np.frombuffer(b"".join(self.spelled), np.uint8)
        self.longest = max(map(len, self.id))
        if any(SPACE in p.lstrip(SPACE) for p in self.id):
            raise ValueError("a piece reaches over the start of a word")
        self.words: dict[str, bytes] = {}
        self.allowed: dict[tuple[str, str], bool] = {}

    def merge(self, text: str) -> list[str]:
        """Pieces of a short string: the best neighbours merge until none can."""
        parts = list(text)
        while True:
            scored = [(self.score[a + b], -i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in self.score]
            if not scored:
                return parts
            at = -max(scored)[1]
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def follows(self, before: str, piece: str) -> bool:
        found = self.allowed.get((before, piece))
        if found is None:
            if len(self.allowed) > MEMORY_WORDS:
                self.allowed.clear()
            found = self.allowed[before, piece] = self.merge(before + piece) == [before, piece]
        return found

    def ids(self, piece: str) -> list[int]:
        """A piece's id; a character without one gives its bytes."""
        own = self.id.get(piece)
        if own is not None:
            return [own]
        return [self.byte[b] for b in piece.encode("utf-8", "surrogatepass")] if self.byte else [self.lib.unk_id()]

    def run_ids(self, text: str) -> bytes:
        """Ids of a run of whole words, as little-endian 32-bit numbers."""
        words = text.split(SPACE)[1:] if SPACE * 2 not in text else [w[1:] for w in split_words(text)]
        missing = list(set(words).difference(self.words))
        if len(self.words) + len(missing) > MEMORY_WORDS:
            self.words, missing = {}, list(set(words))
        self.words.update(zip(missing, self.encoded(missing), strict=True))
        return b"".join(map(self.words.__getitem__, words))

    def encoded(self, words: list[str]) -> list[bytes]:
        """Ids of words; the library puts the one space in front that a word leaves out.

        They go to the library in one text, cut again where a piece begins with a
        space: no piece reaches over the start of a word, and each has one there.
        """
        if not words:
            return []
        if "" not in words and not any(SPACE in w for w in words):
            ids = np.array(self.lib.encode(" ".join(words)), "<i4")
            starts = np.append(np.flatnonzero(self.opens[ids]), len(ids))
            if len(starts) == len(words) + 1:
                data = ids.tobytes()
                return [data[4 * a : 4 * b] for a, b in zip(starts.tolist(), starts[1:].tolist(), strict=False)]
        return [np.array(ids, "<i4").tobytes() for ids in self.lib.encode([w.replace(SPACE, " ") for w in words])]

    def spell(self, ids: np.ndarray) -> bytes:
        """The bytes of ids, marks of spaces as they are."""
        held = self.lengths[ids]
        within = np.arange(held.sum()) - np.repeat(np.cumsum(held) - held, held)
        return self.bytes[np.repeat(self.places[ids], held) + within].tobytes()


@cache
def pieces(path: str) -> Pieces:
    return Pieces(path)


def word_starts(text: str, low: int, high: int) -> tuple[int, int] | None:
    """First and last place in [low, high) where spaces begin behind something else."""
    first = low
    while True:
        first = text.find(SPACE, first, high)
        if first < 0:
            return None
        if first > 0 and text[first - 1] != SPACE:
            break
        first += 1
    last = high
    while True:
        last = text.rfind(SPACE, 0, last)
        if text[last - 1] != SPACE:
            return first, last


def split_words(text: str) -> list[str]:
    """Cut a text that begins with a space in front of every run of spaces."""
    words, spaces = [], ""
    for part in text.split(SPACE)[1:]:
        spaces += SPACE
        if part:
            words.append(spaces + part)
            spaces = ""
    return words + [spaces] if spaces else words


class Chunk:
    """``text`` from ``low`` to ``high``, with context on both sides."""

    def __init__(self, model: Pieces, text: str, low: int, high: int, last: bool):
        self.model, self.text, self.low, self.high, self.last = model, text, low, high, last
        self.starts = word_starts(text, low, high)

    def matching(self, start: int) -> Iterator[tuple[int, str]]:
        """End and piece of all pieces that begin here; any single character is one."""
        for end in range(start + 1, min(len(self.text), start + self.model.longest) + 1):
            piece = self.text[start:end]
            if end == start + 1 or piece in self.model.id:
                yield end, piece

    def entries(self) -> dict[State, str]:
        """States that pieces from the left of the boundary can leave behind."""
        found: dict[State, str] = {}
        for start in range(max(0, self.low - self.model.longest), self.low):
            for end, piece in self.matching(start):
                if end >= self.low:
                    found[end - self.low, self.name(piece)] = piece
        return found

    def name(self, piece: str) -> int:
        own = self.model.id.get(piece)
        return own if own is not None else -10 - ord(piece)

    def walk(self, at: int, before: str | None, stop: int) -> dict[int, tuple[int, str | None]]:
        """For every place a path can reach up to ``stop``: where its last piece began, and that piece."""
        reached: dict[int, tuple[int, str | None]] = {at: (-1, before)}
        for start in range(at, stop):
            if start in reached:
                last = reached[start][1]
                for end, piece in self.matching(start):
                    if end <= stop and end not in reached and (last is None or self.model.follows(last, piece)):
                        reached[end] = (start, piece)
        return reached

    def exits(self, at: int, before: str | None) -> dict[State, list[str]]:
        """Right boundary states that a path from ``at`` can reach, with the pieces on the way."""
        if self.last:
            reached = self.walk(at, before, self.high)
            return {STOP: self.path(reached, self.high)} if self.high in reached else {}
        reached = self.walk(at, before, self.high - 1)
        found: dict[State, list[str]] = {}
        for start in sorted(reached):
            last = reached[start][1]
            for end, piece in self.matching(start):
                if end >= self.high and start < self.high and (last is None or self.model.follows(last, piece)):
                    found[end - self.high, self.name(piece)] = [*self.path(reached, start), piece]
        if at >= self.high:  # the piece from the left reaches beyond this chunk
            found[at - self.high, self.name(before)] = []
        return found

    @staticmethod
    def path(reached: dict[int, tuple[int, str | None]], end: int) -> list[str]:
        found = []
        while reached[end][0] >= 0:
            start, piece = reached[end]
            found.append(piece)
            end = start
        return found[::-1]

    def matrix(self) -> Matrix:
        """Weight of the best path by left and right state; pairs without a path are left out."""
        sides = {START: (self.low, None)} if self.low == 0 else {s: (self.low + s[0], p) for s, p in self.entries().items()}
        if not self.starts:
            found = {s: dict.fromkeys(self.exits(at, p), 0.0) for s, (at, p) in sides.items()}
            return {s: row for s, row in found.items() if row}
        first, last = self.starts
        right = dict.fromkeys(self.exits(last, None), 0.0)
        meets = [s for s, (at, p) in sides.items() if at == first or at < first and first in self.walk(at, p, first)]
        return {s: dict(right) for s in meets} if right else {}

    def backtrace(self, entry: State, leave: State) -> np.ndarray:
        """Ids of the pieces that begin in this chunk."""
        at = self.low + entry[0]
        before = None if entry == START else self.model.text.get(entry[1]) or chr(-10 - entry[1])
        if not self.starts:
            return self.ids(self.exits(at, before)[leave])
        first, last = self.starts
        head = self.ids(self.path(self.walk(at, before, first), first)) if at < first else self.ids([])
        words = np.frombuffer(self.model.run_ids(self.text[first:last]), "<i4") if last > first else self.ids([])
        return np.concatenate([head, words, self.ids(self.exits(last, None)[leave])])

    def ids(self, parts: list[str]) -> np.ndarray:
        return np.array([i for p in parts for i in self.model.ids(p)], "<i4")


def multiply(left: Matrix, right: Matrix) -> Matrix:
    """Max-plus product."""
    found: Matrix = {}
    for a, row in left.items():
        best: dict[State, float] = {}
        for b, first in row.items():
            for c, second in right.get(b, {}).items():
                best[c] = max(best.get(c, float("-inf")), first + second)
        if best:
            found[a] = best
    return found


def states_between(matrices: list[Matrix], entry: State, leave: State) -> list[State]:
    """The states at all boundaries on the best path from ``entry`` to ``leave``."""
    reached: list[dict[State, tuple[float, State | None]]] = [{entry: (0.0, None)}]
    for matrix in matrices:
        following: dict[State, tuple[float, State | None]] = {}
        for a, (weight, _) in reached[-1].items():
            for b, more in matrix.get(a, {}).items():
                if b not in following or weight + more > following[b][0]:
                    following[b] = weight + more, a
        reached.append(following)
    path = [leave]
    for step in reached[:0:-1]:
        path.append(step[path[-1]][1])
    return path[::-1]


def _pack(matrix: Matrix) -> list[list[float]]:
    return [[*a, *b, w] for a, row in matrix.items() for b, w in row.items()]


def _unpack(cells) -> Matrix:
    found: Matrix = defaultdict(dict)
    for a0, a1, b0, b1, w in cells:
        found[int(a0), int(a1)][int(b0), int(b1)] = w
    return dict(found)


CUT = "row long, doc_id long, chunk long, block long, chunks long, text string, low int, high int"


def cut(docs: DataFrame, path: str, chunk: int = CHUNK) -> DataFrame:
    """Chunks of the normalised texts, with context for pieces that reach over a boundary."""

    def run(columns: dict[str, list]) -> dict[str, list]:
        model, out = pieces(path), defaultdict(list)
        for row, doc_id, text in zip(columns["row"], columns["doc_id"], columns["text"], strict=True):
            whole = model.lib.normalize(text)
            chunks = max(1, -(-len(whole) // chunk))
            for number in range(chunks):
                low, high = number * chunk, min(len(whole), (number + 1) * chunk)
                left = max(0, low - model.longest - 1)
                values = row, doc_id, number, number // BLOCK, chunks, whole[left : high + model.longest], low - left, high - left
                for name, value in zip(NAMES, values, strict=True):
                    out[name].append(value)
        return {n: out[n] for n in NAMES}

    return map_lists(docs, run, CUT)


NAMES = [part.split()[0] for part in CUT.split(", ")]
CELLS = "array<array<double>>"


def _matrices(chunks: DataFrame, path: str) -> DataFrame:
    def run(columns: dict[str, list]) -> dict[str, list]:
        model = pieces(path)
        rows = zip(*(columns[n] for n in ("text", "low", "high", "chunk", "chunks")), strict=True)
        cells = [_pack(Chunk(model, t, lo, hi, c == n - 1).matrix()) for t, lo, hi, c, n in rows]
        return {**{n: columns[n] for n in ("row", "block", "chunk")}, "cells": cells}

    return map_lists(chunks, run, f"row long, block long, chunk long, cells {CELLS}")


def _boundaries(matrices: DataFrame) -> DataFrame:
    """Both boundary states of every chunk: row, chunk, e0, e1, l0, l1.

    Matrices meet in arrays of at most ``BLOCK`` chunks, and then of a
    document's blocks.
    """
    ends = "array<struct<at:long,e0:long,e1:long,l0:long,l1:long>>"

    def total(columns: dict[str, list]) -> dict[str, list]:
        found = [reduce(multiply, [_unpack(p["cells"]) for p in parts]) for parts in columns["parts"]]
        return {**{n: columns[n] for n in ("row", "block")}, "cells": [_pack(m) for m in found]}

    def states(parts: list[dict], entry: State, leave: State) -> list[dict]:
        path = states_between([_unpack(p["cells"]) for p in parts], entry, leave)
        return [{"at": p["at"], "e0": a[0], "e1": a[1], "l0": b[0], "l1": b[1]} for p, a, b in zip(parts, path, path[1:])]

    def across(columns: dict[str, list]) -> dict[str, list]:
        return {"row": columns["row"], "ends": [states(p, START, STOP) for p in columns["parts"]]}

    def within(columns: dict[str, list]) -> dict[str, list]:
        sides = zip(*(columns[n] for n in ("e0", "e1", "l0", "l1")), strict=True)
        return {"row": columns["row"], "ends": [states(p, s[:2], s[2:]) for p, s in zip(columns["parts"], sides, strict=True)]}

    def gathered(frame: DataFrame, keys: list[str], at: str) -> DataFrame:
        return frame.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(F.col(at).alias("at"), "cells"))).alias("parts"))

    def flat(frame: DataFrame, name: str) -> DataFrame:
        return frame.select("row", F.explode("ends").alias("e")).select("row", F.col("e.at").alias(name), "e.e0", "e.e1", "e.l0", "e.l1")

    blocks = gathered(matrices, ["row", "block"], "chunk")
    whole = gathered(map_lists(blocks, total, f"row long, block long, cells {CELLS}"), ["row"], "block")
    outer = flat(map_lists(whole, across, f"row long, ends {ends}"), "block")
    return flat(map_lists(blocks.join(outer, ["row", "block"]), within, f"row long, ends {ends}"), "chunk")


ENCODED = "row long, doc_id long, chunk long, chunks long, n long, s long, w long, decoded boolean"


def _backtraced(chunks: DataFrame, path: str, keep_ids: bool) -> DataFrame:
    def run(columns: dict[str, list]) -> dict[str, list]:
        model, out = pieces(path), defaultdict(list)
        names = ("text", "low", "high", "chunk", "chunks", "e0", "e1", "l0", "l1")
        for text, low, high, number, chunks, e0, e1, l0, l1 in zip(*(columns[n] for n in names), strict=True):
            one = Chunk(model, text, low, high, number == chunks - 1) if text else None
            ids = one.backtrace((e0, e1), (l0, l1)) if one else np.array([], "<i4")
            wide = ids.astype(np.int64)
            out["n"].append(len(ids))
            out["s"].append(int(wide.sum()))
            out["w"].append(int(wide @ np.arange(1, len(ids) + 1)))
            out["decoded"].append(model.spell(ids) == text[low + e0 : high + l0].encode("utf-8", "surrogatepass"))
            if keep_ids:
                out["ids"].append(ids.tobytes())
        return {**{n: columns[n] for n in ("row", "doc_id", "chunk", "chunks")}, **{n: out[n] for n in ("n", "s", "w", "decoded", "ids")}}

    return map_lists(chunks, run, ENCODED + ", ids binary" * keep_ids)


def encode(docs: DataFrame, path: str, chunk: int = CHUNK, keep_ids: bool = True) -> DataFrame:
    """Ids by document and chunk.

    Columns: row, doc_id, chunk, chunks, n (number of ids), s (their sum), w
    (their sum times their places from 1), decoded (whether the ids give the
    text back) and, unless left out, ids, as little-endian 32-bit numbers, with
    the path of the model that spells them.
    """
    ship(docs.sparkSession)
    numbered = docs.select(
        F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")
    )
    # A short text is one chunk whatever the normaliser makes of it. Rows of either kind have numbers of their own.
    small = cut(numbered.where(f"char_length(text) < {chunk}"), path, 1 << 40)
    giant = cut(numbered.where(f"char_length(text) >= {chunk}").withColumn("row", -1 - F.col("row")), path, chunk)
    giant = written(giant.repartition("row", "chunk"), "chunks")
    inner = written(_matrices(giant.where("chunks > 1"), path), "matrices")
    ends = written(_boundaries(inner), "boundaries")
    known = giant.where("chunks > 1").join(ends, ["row", "chunk"])
    alone = small.unionByName(giant.where("chunks = 1"))
    for name, value in (("e0", START[0]), ("e1", START[1]), ("l0", STOP[0]), ("l1", STOP[1])):
        alone = alone.withColumn(name, F.lit(value).cast("long"))
    found = _backtraced(alone, path, keep_ids).unionByName(_backtraced(known.select(*alone.columns), path, keep_ids))
    return found.withColumn("path", F.lit(path)) if keep_ids else found


def decode(encoded: DataFrame) -> DataFrame:
    """Texts of encoded documents (columns of ``encode`` with ids): row, doc_id and text as the library decodes them.

    Chunks are spelled by themselves, so a character's bytes may lie in two of
    them; a document's bytes meet in order and are read as one text. Bytes that
    are no UTF-8 become replacement characters. A document without ids is empty.
    """
    path = F.col("path")

    def run(columns: dict[str, list]) -> dict[str, list]:
        spelled = [pieces(p).spell(np.frombuffer(ids, "<i4")) for p, ids in zip(columns["path"], columns["ids"], strict=True)]
        return {**{n: columns[n] for n in ("row", "doc_id", "chunk")}, "spelled": spelled}

    parts = map_lists(encoded.select("row", "doc_id", "chunk", path, "ids"), run, "row long, doc_id long, chunk long, spelled binary")
    whole = parts.groupBy("row").agg(
        F.first("doc_id").alias("doc_id"), F.array_sort(F.collect_list(F.struct("chunk", "spelled"))).alias("parts")
    )
    text = F.decode(F.aggregate("parts", F.lit(b""), lambda a, p: F.concat(a, p["spelled"])), "utf-8")
    # The mark in front stands for no space of the text.
    return whole.select("row", "doc_id", F.regexp_replace(F.regexp_replace(text, f"^{SPACE}", ""), SPACE, " ").alias("text"))


def summary(encoded: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_tokens, id_sum, id_place_sum (ids times places from 1), n_chunks, decoded."""
    # One use of ``encoded``, or every text would be encoded twice. The window runs over the few numbers of
    # a document's chunks.
    placed = encoded.withColumn("before", F.expr("sum(n) OVER (PARTITION BY row ORDER BY chunk) - n"))
    whole = placed.groupBy("row").agg(
        F.first("doc_id").alias("doc_id"),
        F.sum("n").alias("n_tokens"),
        F.sum("s").alias("id_sum"),
        F.sum(F.col("w") + F.col("before") * F.col("s")).alias("id_place_sum"),
        F.first("chunks").alias("n_chunks"),
        F.bool_and("decoded").alias("decoded"),
    )
    return whole.drop("row")
