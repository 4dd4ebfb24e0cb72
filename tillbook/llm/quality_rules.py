"""Quality rules under weak supervision.

Every rule votes good, votes bad or abstains on a whole text. Spark counts the
documents by vote pattern; expectation-maximisation over those counts estimates
for every rule how often it votes either way on good and on bad texts, and the
share of good texts. The posterior probability of "good" then decides, in
place of a filter that demands every rule. The counts cover all documents. With
``len(RULES)`` rules there are at most 3 to that power patterns, which bounds
what reaches the driver.

Rules for odd input: a null text has no words; it fails the base test like any
text under 50 words. Rows are judged one by one, repeated rows alike. Columns
besides doc_id and text are carried by ``keep_good``. An empty table gives an
empty result; the model is then the prior.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillbook.llm.batches import BATCH_ROWS, SPACE, map_lists, ship
from tillbook.session import written

SYMBOLS = "#*$%&|<>"
MIN_WORDS, MAX_REPEATED = 50, 50
THRESHOLD = 0.5
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")

# Frequent function words of English, French, German and Spanish.
FUNCTION_WORDS = frozenset(
    """the of and to in is that for with was are be by this it on as from at
    le la les des et un une du en que qui dans pour par sur de est au avec
    der die das und den von zu mit sich auf für im dem nicht ein eine als
    el los las y del se con una para es lo como su al o""".split()
)


def _measure(text: str) -> tuple[dict[str, int], list[str]]:
    """The counts of the contract, whose words are runs without ASCII white space, and the lines with a word."""
    words = text.encode("utf-8", "surrogatepass").split()
    lines = [x for x in text.split("\n") if x.strip(" \t\x0b\x0c\r")]
    counts = {
        "n_words": len(words),
        "word_chars": len(text) - sum(map(text.count, SPACE)),
        "n_symbols": sum(map(text.count, SYMBOLS)),
        "n_dup_lines": len(lines) - len(set(lines)),
        "n_repeat_words": repeated_words(words),
    }
    return counts, lines


def repeated_words(words: list[bytes]) -> int:
    """Words inside windows of three words that the text holds at least twice."""
    if len(words) < 4:
        return 0
    number: dict[bytes, int] = {}
    ids = np.array([number.setdefault(w, len(number)) for w in words], np.int64)
    # Pairs are numbered anew, so that the product stays far below 64 bits.
    _, pair = np.unique(ids[:-1] * len(number) + ids[1:], return_inverse=True)
    _, where, times = np.unique(pair[:-1] * len(number) + ids[2:], return_inverse=True, return_counts=True)
    again = times[where] > 1
    marked = np.zeros(len(words), bool)
    for shift in range(3):
        marked[shift : shift + len(again)] |= again
    return int(marked.sum())


FAR = float("inf")


@dataclass(frozen=True)
class Rule:
    """Bad outside ``fair``; good inside ``good``, where a rule has it; else no vote."""

    name: str
    fair: tuple[float, float]
    good: tuple[float, float] | None = None

    def vote(self, value: float | None) -> int:
        if value is None:
            return 0
        if not self.fair[0] <= value <= self.fair[1]:
            return -1
        return int(self.good is not None and self.good[0] <= value <= self.good[1])


RULES = (
    Rule("word_length", (2, 14)),
    Rule("symbols_per_word", (0, 0.1)),
    Rule("symbols_per_character", (0, 0.03)),
    Rule("plain_words", (0.7, 1)),
    Rule("repeated_lines", (0, 0.3)),
    Rule("repeated_words", (0, 0.35)),
    Rule("upper_case_words", (0, 0.5)),
    Rule("exclamations", (0, 0.2)),
    Rule("sentence_ends", (0.01, FAR), (0.03, 0.5)),
    Rule("function_words", (0.01, 0.95), (0.06, 0.8)),
)


def features(counts: dict[str, int], lines: list[str], text: str) -> list[float | None]:
    """What the rules judge, in their order; None where a text is too short to tell."""
    words = text.split()
    n = len(words)
    if n < 10:
        return [None] * len(RULES)
    plain = [w.strip(".,;:!?\"'()") for w in words]
    return [
        counts["word_chars"] / n,
        counts["n_symbols"] / n,
        counts["n_symbols"] / counts["word_chars"],
        sum(map(str.isalnum, plain)) / n,
        counts["n_dup_lines"] / len(lines) if len(lines) > 3 else None,
        counts["n_repeat_words"] / n,
        sum(map(str.isupper, plain)) / n,
        text.count("!") / n,
        sum(map(text.count, ".?!。")) / n,
        sum(map(FUNCTION_WORDS.__contains__, map(str.lower, plain))) / n,
    ]


def votes(text: str | None) -> tuple[dict[str, int], str]:
    """Counts, and a letter per rule: ``+`` good, ``-`` bad, ``0`` abstains."""
    counts, lines = _measure(text or "")
    values = features(counts, lines, text or "")
    return counts, "".join("0+-"[r.vote(v)] for r, v in zip(RULES, values, strict=True))


# The rates of the votes "-", "0" and "+" that estimation starts from and leans on.
START = {
    "good": {True: (0.01, 0.29, 0.7), False: (0.01, 0.99, 0.0)},
    "bad": {True: (0.3, 0.4, 0.3), False: (0.3, 0.7, 0.0)},
}
START_SHARE = 0.8
# The start weighs as much as this share of the documents.
PRIOR_WEIGHT = 0.1


@dataclass
class Model:
    """Share of good texts, and by rule the rates of its votes on good and on bad ones."""

    good_share: float
    on_good: np.ndarray
    on_bad: np.ndarray

    def posterior(self, pattern: str) -> float:
        odds = np.log(self.good_share / (1 - self.good_share))
        for rule, letter in enumerate(pattern):
            vote = "-0+".index(letter)
            odds += np.log(self.on_good[rule, vote] / self.on_bad[rule, vote])
        return float(1 / (1 + np.exp(-odds)))


def _start() -> Model:
    rates = {side: np.array([START[side][r.good is not None] for r in RULES]) + 1e-9 for side in START}
    return Model(START_SHARE, rates["good"], rates["bad"])


def estimate(patterns: dict[str, int], rounds: int = 200) -> Model:
    """Expectation-maximisation over the numbers of documents by vote pattern.

    It maximises the posterior under the starting rates. A rule keeps pointing
    its own way: its "-" is never likelier on good texts nor its "+" on bad ones.
    """
    start = model = _start()
    total = sum(patterns.values())
    if not total:
        return start
    names = sorted(patterns)
    weight = np.array([patterns[p] for p in names], float)
    cast = np.array([[["-0+".index(c) == v for v in range(3)] for c in p] for p in names], float)
    prior = PRIOR_WEIGHT * total
    for _ in range(rounds):
        good = np.array([model.posterior(p) for p in names]) * weight
        bad = weight - good
        on_good = (np.einsum("p,prv->rv", good, cast) + prior * start.on_good) / (good.sum() + prior)
        on_bad = (np.einsum("p,prv->rv", bad, cast) + prior * start.on_bad) / (bad.sum() + prior)
        low, high = np.minimum(on_good, on_bad), np.maximum(on_good, on_bad)
        on_good[:, 0], on_bad[:, 0] = low[:, 0], high[:, 0]
        on_good[:, 2], on_bad[:, 2] = high[:, 2], low[:, 2]
        share = float((good.sum() + prior * START_SHARE) / (total + prior))
        moved = abs(share - model.good_share) + float(np.abs(on_good - model.on_good).sum())
        model = Model(share, on_good, on_bad)
        if moved < 1e-9:
            break
    return model


def _voted(docs: DataFrame) -> DataFrame:
    def run(columns: dict[str, list]) -> dict[str, list]:
        found = [votes(t) for t in columns["text"]]
        return {"doc_id": columns["doc_id"], **{c: [f[0][c] for f in found] for c in COUNTS}, "votes": [f[1] for f in found]}

    schema = "doc_id long, " + ", ".join(f"{c} long" for c in COUNTS) + ", votes string"
    return map_lists(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run, schema)


def _fitted(voted: DataFrame) -> tuple[Model, dict[str, int]]:
    patterns = {r["votes"]: r["count"] for r in voted.groupBy("votes").count().collect()}
    return estimate(patterns), patterns


def base_failed(n_words: str = "n_words", n_repeat_words: str = "n_repeat_words"):
    return (F.col(n_words) < MIN_WORDS) | (100 * F.col(n_repeat_words) > MAX_REPEATED * F.col(n_words))


def quality(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One row per document: its counts, base_failed, kept, votes and the posterior."""
    voted = written(_voted(docs), "votes")
    model, patterns = _fitted(voted)
    spark = docs.sparkSession
    # At most 3 ** len(RULES) patterns.
    scores = spark.createDataFrame([(p, model.posterior(p)) for p in sorted(patterns)], "votes string, posterior double")
    judged = voted.join(F.broadcast(scores), "votes").withColumn("base_failed", base_failed())
    kept = ~F.col("base_failed") & (F.col("posterior") >= threshold)
    return judged.select("doc_id", *COUNTS, "base_failed", kept.alias("kept"), "posterior", "votes")


def keep_good(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The documents that the rules keep, with all their columns.

    The texts are judged again in the scan that passes them on, which is cheaper
    than shuffling them to their verdicts.
    """
    model, patterns = _fitted(_voted(docs).select("votes"))
    posterior = {p: model.posterior(p) for p in patterns}
    ship(docs.sparkSession)
    docs.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    place = docs.columns.index("text")

    def stays(text: str | None) -> bool:
        counts, pattern = votes(text)
        if counts["n_words"] < MIN_WORDS or 100 * counts["n_repeat_words"] > MAX_REPEATED * counts["n_words"]:
            return False
        return (posterior[pattern] if pattern in posterior else model.posterior(pattern)) >= threshold

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array([stays(t) for t in batch.column(place).to_pylist()], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
