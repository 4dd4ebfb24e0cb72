"""Quality classifier: random-indexing word vectors, pooled, and a two-layer network.

Every word has a sparse random index vector that follows from its hash; capitals,
numbers and a repeated word have signs of their own, which count as words. Its word
vector is the sum of the index vectors of its neighbours over the training
texts, plus its own. A text is the mean of its word vectors. A network with one
hidden layer, trained with numpy, turns that into a probability, and a
temperature fitted on rows apart from the training rows calibrates it.

Words share ``BUCKETS`` vectors by hash, so the model has a fixed size. It is
fitted on at most ``FIT_ROWS`` labelled rows, taken in the order of a hash of
their doc_id; the corpus is then scored whole in one scan. Only sums of vectors
and pooled vectors of the fitting rows reach the driver.

Rules for odd input: a null text is empty; a text without words is the zero
vector and gets the network's score for it. Rows without a label teach nothing.
If the labels hold fewer than two classes the score is their share of 1, or 0.5
without any. Repeated rows each get a row. Extra columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillbook.llm.batches import BATCH_ROWS, held_out, map_lists, ship
from tillbook.session import written

BUCKETS = 1 << 14
DIMENSIONS = 48
NONZERO = 4
FIT_ROWS = 20_000
HIDDEN = 24
THRESHOLD = 0.3
# Words with their sums remembered by one worker.
MEMORY_WORDS = 200_000

TOKEN = re.compile(r"[^\W\d_]+|\d+|[^\w\s]|_")


def word_tokens(word: str) -> list[int]:
    """Buckets of what stands between white space: words, numbers, marks, and signs."""
    found = []
    for token in TOKEN.findall(word):
        if len(token) > 1 and token.isupper():
            found.append("<capitals>")
        found.append("<number>" if token[0].isdigit() else token.lower())
    return [bucket(t) for t in found]


def bucket(token: str) -> int:
    return zlib.crc32(token.encode("utf-8", "surrogatepass")) % BUCKETS


# Follows a word that equals the word before it.
AGAIN = bucket("<again>")


def text_tokens(text: str | None) -> list[int]:
    found, last = [], None
    for word in (text or "").split():
        found += word_tokens(word)
        if word == last:
            found.append(AGAIN)
        last = word
    return found


def index_vectors() -> tuple[np.ndarray, np.ndarray]:
    """Places and signs of the nonzero entries of every bucket's index vector."""
    random = np.random.default_rng(20240)
    places = np.argsort(random.random((BUCKETS, DIMENSIONS)), axis=1)[:, :NONZERO]
    return places, random.choice(np.array([-1.0, 1.0]), (BUCKETS, NONZERO))


def context_sums(texts: list[str | None]) -> np.ndarray:
    """Sum of the neighbours' index vectors for every bucket."""
    places, signs = index_vectors()
    total = np.zeros(BUCKETS * DIMENSIONS)
    for text in texts:
        ids = np.array(text_tokens(text), np.int64)
        for word, near in ((ids[1:], ids[:-1]), (ids[:-1], ids[1:])):
            if len(word):
                where = (word[:, None] * DIMENSIONS + places[near]).ravel()
                np.add.at(total, where, signs[near].ravel())
    return total


def word_vectors(sums: np.ndarray) -> np.ndarray:
    """Vectors of length one: context plus the word's own index vector."""
    places, signs = index_vectors()
    own = np.zeros((BUCKETS, DIMENSIONS))
    np.put_along_axis(own, places, signs, 1)
    context = sums.reshape(BUCKETS, DIMENSIONS)
    length = np.linalg.norm(context, axis=1, keepdims=True)
    vectors = context / np.maximum(length, 1e-9) + own / np.sqrt(NONZERO)
    return (vectors / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-9)).astype(np.float32)


class Pooler:
    """Mean word vector of a text; sums of whole words are remembered."""

    def __init__(self, vectors: np.ndarray):
        self.vectors = vectors
        self.start()

    def start(self) -> None:
        self.number: dict[str, int] = {}
        self.sums = np.zeros((1024, DIMENSIONS), np.float32)
        self.counts = np.zeros(1024, np.int64)

    def pooled(self, text: str | None) -> np.ndarray:
        words = (text or "").split()
        total, count = np.zeros(DIMENSIONS), 0
        again = sum(map(eq, words, islice(words, 1, None)))
        for low in range(0, len(words), 4096):  # a slice never meets a memory that was cleared under it
            part = words[low : low + 4096]
            if len(self.number) + len(part) > MEMORY_WORDS:
                self.start()
            ids = [self.number[w] if w in self.number else self.learn(w) for w in part]
            total += self.sums[ids].sum(0)
            count += int(self.counts[ids].sum())
        total += again * self.vectors[AGAIN]
        return (total / max(count + again, 1)).astype(np.float32)

    def learn(self, word: str) -> int:
        at = self.number[word] = len(self.number)
        if at == len(self.counts):
            self.sums, self.counts = np.vstack([self.sums, np.zeros_like(self.sums)]), np.concatenate([self.counts, 0 * self.counts])
        tokens = word_tokens(word)
        self.sums[at], self.counts[at] = self.vectors[tokens].sum(0) if tokens else 0, len(tokens)
        return at


@dataclass
class Network:
    """tanh layer, linear output, temperature; inputs are standardised."""

    mean: np.ndarray
    spread: np.ndarray
    first: np.ndarray
    first_bias: np.ndarray
    second: np.ndarray
    second_bias: float
    temperature: float = 1.0

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.tanh((x - self.mean) / self.spread @ self.first + self.first_bias) @ self.second + self.second_bias

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -30, 30)))


def constant(probability: float) -> Network:
    p = min(max(probability, 1e-6), 1 - 1e-6)
    zero = np.zeros(DIMENSIONS)
    return Network(zero, zero + 1, np.zeros((DIMENSIONS, 1)), np.zeros(1), np.zeros(1), float(np.log(p / (1 - p))))


def fit_network(x: np.ndarray, y: np.ndarray, epochs: int = 60, rate: float = 0.01, decay: float = 1e-4) -> Network:
    """Adam on the log loss; every fifth row is left for the temperature."""
    if not len(y):
        return constant(0.5)
    if len(set(y.tolist())) < 2:
        return constant(float(y.mean()))
    random = np.random.default_rng(7)
    apart = np.arange(len(y)) % 5 == 0
    if len(set(y[~apart].tolist())) < 2:
        apart[:] = False
    train_x, train_y = x[~apart], y[~apart]
    net = Network(train_x.mean(0), train_x.std(0) + 1e-6, random.normal(0, 1 / np.sqrt(x.shape[1]), (x.shape[1], HIDDEN)), np.zeros(HIDDEN), random.normal(0, 0.1, HIDDEN), 0.0)
    z = (train_x - net.mean) / net.spread
    weights = [net.first, net.first_bias, net.second, np.zeros(1)]
    moments = [[np.zeros_like(w), np.zeros_like(w)] for w in weights]
    step = 0
    for _ in range(epochs):
        for rows in np.array_split(random.permutation(len(z)), max(1, len(z) // 256)):
            hidden = np.tanh(z[rows] @ weights[0] + weights[1])
            error = (1 / (1 + np.exp(-np.clip(hidden @ weights[2] + weights[3], -30, 30))) - train_y[rows]) / len(rows)
            back = np.outer(error, weights[2]) * (1 - hidden**2)
            slopes = [z[rows].T @ back + decay * weights[0], back.sum(0), hidden.T @ error + decay * weights[2], np.array([error.sum()])]
            step += 1
            for w, (m, v), g in zip(weights, moments, slopes, strict=True):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                w -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    net.first, net.first_bias, net.second, net.second_bias = *weights[:3], float(weights[3][0])
    held_x, held_y = (x[apart], y[apart]) if apart.any() else (train_x, train_y)
    net.temperature = fit_temperature(net.logits(held_x), held_y)
    return net


def fit_temperature(logits: np.ndarray, y: np.ndarray) -> float:
    """The temperature with the smallest log loss, by golden-section search over its logarithm."""
    sign = np.where(y > 0.5, 1.0, -1.0)

    def loss(log_t: float) -> float:
        return float(np.logaddexp(0, -sign * logits / np.exp(log_t)).mean())

    low, high, part = np.log(0.25), np.log(20.0), (np.sqrt(5) - 1) / 2
    for _ in range(60):
        a, b = high - part * (high - low), low + part * (high - low)
        low, high = (low, b) if loss(a) < loss(b) else (a, high)
    return float(np.exp((low + high) / 2))


def fitting_rows(docs: DataFrame, labels: DataFrame, modulus: int, remainder: int, rows: int) -> DataFrame:
    """Texts and labels (doc_id, text, label) of at most ``rows`` labelled documents that are not held out."""
    marked = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(modulus, remainder))
    one = marked.groupBy("doc_id").agg(F.max("quality").cast("double").alias("label"))
    # Bounded by ``rows``, so it may be broadcast and the texts are not shuffled.
    chosen = one.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    return docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")


def fit(sample: DataFrame) -> tuple[np.ndarray, Network]:
    """Word vectors and network from (doc_id, text, label)."""
    sample = written(sample, "fitting")
    ship(sample.sparkSession)
    sample.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS * DIMENSIONS)
        for batch in batches:
            total += context_sums(batch.column("text").to_pylist())
        yield pa.RecordBatch.from_arrays([pa.array([total.astype(np.float32).tobytes()], pa.binary())], names=["sums"])

    # Eight partial sums of fixed size.
    total = np.zeros(BUCKETS * DIMENSIONS)
    for row in sample.select("text").repartition(8).mapInArrow(sums, "sums binary").toLocalIterator():
        total += np.frombuffer(row["sums"], np.float32)
    vectors = word_vectors(total)
    rows = pooled(sample, vectors, ["label"]).orderBy("doc_id").toArrow()
    x = np.array([np.frombuffer(v, np.float32) for v in rows.column("vector").to_pylist()]).reshape(-1, DIMENSIONS)
    return vectors, fit_network(x.astype(float), np.array(rows.column("label").to_pylist(), float))


def pooled(docs: DataFrame, vectors: np.ndarray, others: list[str] = ()) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(vectors)

    def run(columns: dict[str, list]) -> dict[str, list]:
        pooler = Pooler(shared.value)
        return {**columns, "vector": [pooler.pooled(t).tobytes() for t in columns["text"]]}

    chosen = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *others)
    extra = "".join(f", {c} {chosen.schema[c].dataType.simpleString()}" for c in others)
    return map_lists(chosen, run, f"doc_id long{extra}, vector binary")


def score(docs: DataFrame, vectors: np.ndarray, network: Network) -> DataFrame:
    """doc_id and probability of quality 1 of every document."""
    shared = docs.sparkSession.sparkContext.broadcast((vectors, network))
    ship(docs.sparkSession)
    docs.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    schema = pa.schema([("doc_id", pa.int64()), ("score", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        word, network = shared.value
        pooler = Pooler(word)
        for batch in batches:
            if batch.num_rows:
                x = np.array([pooler.pooled(t) for t in batch.column("text").to_pylist()], float)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(network.probability(x))], schema=schema)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, score double")


def classify(docs: DataFrame, labels: DataFrame, modulus: int = 5, remainder: int = 0, rows: int = FIT_ROWS, threshold: float = THRESHOLD) -> DataFrame:
    """Learn from the labelled rows not held out, score all: doc_id, held_out, score, predicted."""
    scored = score(docs, *fit(fitting_rows(docs, labels, modulus, remainder, rows)))
    predicted = (F.col("score") >= threshold).cast("int").alias("predicted")
    return scored.select("doc_id", held_out(modulus, remainder).alias("held_out"), "score", predicted)
