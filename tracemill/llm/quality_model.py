"""Quality classifier: random-indexing word vectors, pooled per document, under a two-layer network.

Random indexing: every word has a sparse random index vector, which follows from its hash, and a context vector,
the sum of the index vectors of the words around it in all documents. Context vectors are kept in a table of
fixed size whose rows words share by hash, so there is no vocabulary to gather, ship or bound; tasks add up whole
numbers, and their tables are added as a tree, so the sums are exact and the same in every run. A word's vector
is its context vector at unit length beside the index vectors of its form (the word, its ending, its shape). A
document is the mean of its words, its length, how much the mean cancels out (repetitive texts keep a long mean)
and its repeats. The network is trained in numpy on a bounded sample of labelled rows and its logits are divided
by a temperature fitted on rows set aside.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracemill.functions.workspace import Shipped, bound_arrow_batches, distinct_name
from tracemill.llm.hashing import ASCII_SPACE, buffers, mix, portions, word_hashes, word_spans

#: Dimensions of the vectors of a word's form, and entries that are not zero in an index vector.
DIMENSIONS, ENTRIES = 96, 4
#: Rows and dimensions of the table of context vectors, words to each side that are context, and parts it is added in.
CONTEXT_ROWS, CONTEXT_DIMENSIONS, REACH, PARTS = 1 << 12, 32, 2, 16
#: Tables of so many tasks are added first, then their sums.
FAN_IN = 64
#: Labelled rows that the network is trained on, at most; those with the smallest hash of their id.
MAX_TRAINING_ROWS = 20_000
#: Words whose index vectors are held at a time.
CHUNK_WORDS, CONTEXT_CHUNK_WORDS = 64_000, 64_000
THRESHOLD = 0.7
N_FEATURES = CONTEXT_DIMENSIONS + DIMENSIONS + 5

_IDENTITY = np.arange(256, dtype=np.uint8)
#: Byte classes of a word's shape: lower, upper, digit, symbol, bar or slash, other punctuation, beyond ASCII.
_CLASS = np.full(256, 32, dtype=np.uint8)
_CLASS[97:123], _CLASS[65:91], _CLASS[48:58], _CLASS[128:] = 1, 2, 4, 64
_CLASS[list(b"#*$%&<>@^~=+")] = 8
_CLASS[list(b"|/\\")] = 16


def _shapes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Class of the first byte, classes inside, class of the last byte and length class of every word."""
    classes = _CLASS[data]
    inside = np.bitwise_or.reduceat(np.append(classes, 0), np.stack([starts, ends], 1).ravel())[::2]
    length = np.minimum(ends - starts, 15) // 3
    code = classes[starts].astype(np.uint64) | inside.astype(np.uint64) << np.uint64(8)
    return code | classes[ends - 1].astype(np.uint64) << np.uint64(16) | length.astype(np.uint64) << np.uint64(24)


def _endings(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    code = np.zeros(len(starts), dtype=np.uint64)
    for k in range(1, 4):
        at = ends - k
        code |= np.where(at >= starts, data[np.maximum(at, 0)], 0).astype(np.uint64) << np.uint64(8 * (k - 1))
    return code


def _index_entries(words: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(place, sign) of entry k of the index vectors of words, in the dimensions of the context table."""
    bits = mix(words + np.uint64(k + 1))
    return ((bits >> np.uint64(8)) % np.uint64(CONTEXT_DIMENSIONS)).astype(np.int64), (bits & np.uint64(1)).astype(np.int64) * 2 - 1


def _context_rows(words: np.ndarray) -> np.ndarray:
    return (words >> np.uint64(40)).astype(np.int64) & (CONTEXT_ROWS - 1)


def add_contexts(table: np.ndarray, texts: pa.Array) -> None:
    """Add to each word's row of the flat table the index vectors of the words within ``REACH`` of it."""
    for low, high in portions(texts):
        data, offsets = buffers(texts.slice(low, high - low))
        starts, ends, at = word_spans(data, offsets, ASCII_SPACE)
        for a in range(int(at[0]), int(at[-1]), CONTEXT_CHUNK_WORDS):
            b = min(a + CONTEXT_CHUNK_WORDS, int(at[-1]))
            last = min(b + REACH, int(at[-1]))  # the words after a piece are context of its last ones
            words = word_hashes(data, starts[a:last], ends[a:last])
            owner = np.searchsorted(at, np.arange(a, last), "right")
            rows = _context_rows(words) * CONTEXT_DIMENSIONS
            entries = [_index_entries(words, k) for k in range(ENTRIES)]
            for step in range(1, REACH + 1):
                first = np.flatnonzero(owner[step:] == owner[:-step])
                first = first[first < b - a]
                for place, sign in entries:
                    for word, beside in ((first, first + step), (first + step, first)):
                        table += np.bincount(rows[word] + place[beside], sign[beside], len(table)).astype(np.int64)


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    table = np.zeros(CONTEXT_ROWS * CONTEXT_DIMENSIONS, dtype=np.int64)
    for batch in batches:
        add_contexts(table, batch.column(0))
    if table.any():
        group = TaskContext.get().partitionId() // FAN_IN
        yield pa.RecordBatch.from_arrays(
            [pa.array(range(PARTS), pa.int32()), pa.array([group] * PARTS, pa.int32()), pa.array([x.tobytes() for x in np.split(table, PARTS)], pa.binary())],
            names=["part", "group", "sums"],
        )


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for part, values in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            more = np.frombuffer(values.as_buffer(), dtype=np.int64)
            sums[part] = sums[part] + more if part in sums else more
    if sums:
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([v.tobytes() for v in sums.values()], pa.binary())], names=["part", "sums"])


def context_vectors(docs: DataFrame, text: str = "text") -> np.ndarray:
    """(CONTEXT_ROWS, CONTEXT_DIMENSIONS) float32: unit context vectors from the texts of all ``docs``.

    What the driver reads has the size of the table (1 MB), whatever the input.
    """
    bound_arrow_batches(docs.sparkSession)
    found = docs.select(F.col(text)).mapInArrow(_contexts, "part int, group int, sums binary")
    once = found.repartition("part", "group").select("part", "sums").mapInArrow(_added, "part int, sums binary")
    table = np.zeros((PARTS, CONTEXT_ROWS * CONTEXT_DIMENSIONS // PARTS))
    for r in once.repartition(PARTS, "part").mapInArrow(_added, "part int, sums binary").collect():
        table[r["part"]] = np.frombuffer(r["sums"], dtype=np.int64)
    table = table.reshape(CONTEXT_ROWS, CONTEXT_DIMENSIONS)
    table -= table.mean(0)  # what all words have around them tells none apart
    return (table / np.maximum(np.sqrt((table**2).sum(1, keepdims=True)), 1e-9)).astype(np.float32)


def document_vectors(texts: pa.Array, contexts: np.ndarray) -> np.ndarray:
    """(texts, N_FEATURES) float32: pooled word vector, log length, norms, repeats, mean word length."""
    out = np.zeros((len(texts), N_FEATURES), dtype=np.float32)
    for low, high in portions(texts):
        data, offsets = buffers(texts.slice(low, high - low))
        out[low:high] = _pooled(data, *word_spans(data, offsets, ASCII_SPACE), contexts)
    return out


def _pooled(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, at: np.ndarray, contexts: np.ndarray) -> np.ndarray:
    n = len(at) - 1
    counts = np.diff(at)
    sums = np.zeros((n, DIMENSIONS))
    around = np.zeros((n, CONTEXT_DIMENSIONS))
    repeats = np.zeros(n)
    length = np.zeros(n)
    for a in range(int(at[0]), int(at[-1]), CHUNK_WORDS):  # one very long text comes in pieces
        b = min(a + CHUNK_WORDS, int(at[-1]))
        s, e = starts[a:b], ends[a:b]
        inside = np.diff(np.clip(at, a, b))
        owner = np.repeat(np.arange(n), inside)
        words = word_hashes(data, s, e, _IDENTITY)
        same = np.zeros(len(words), dtype=bool)
        same[1:] = (words[1:] == words[:-1]) & (owner[1:] == owner[:-1])
        repeats += np.bincount(owner, same, n)
        length += np.bincount(owner, e - s, n)
        held = np.flatnonzero(inside)
        first = np.cumsum(inside)[held] - inside[held]
        around[held] += np.add.reduceat(contexts[_context_rows(word_hashes(data, s, e))], first, axis=0)
        base = owner * DIMENSIONS
        for tag, code in ((1, words), (2, _shapes(data, s, e)), (3, _endings(data, s, e))):
            h = mix(code * np.uint64(8) + np.uint64(tag))
            for k in range(ENTRIES):
                bits = h >> np.uint64(16 * k)
                place = ((bits & np.uint64(0x7FFF)) % np.uint64(DIMENSIONS)).astype(np.int64)
                sign = ((bits >> np.uint64(15)) & np.uint64(1)).astype(np.float64) * 2 - 1
                sums += np.bincount(base + place, sign, n * DIMENSIONS).reshape(n, DIMENSIONS)
    each = np.maximum(counts, 1)
    mean, near = sums / each[:, None], around / each[:, None]
    return np.column_stack(
        [near, mean, np.log1p((near**2).sum(1)), np.log1p(counts), np.log1p((mean**2).sum(1)), repeats / each, length / each]
    ).astype(np.float32)


@dataclass
class QualityModel:
    """The trained network; without labels of both kinds it answers the share of label 1, or 0.5."""

    prior: float
    contexts: np.ndarray | None = None
    center: np.ndarray | None = None
    scale: np.ndarray | None = None
    layers: tuple[np.ndarray, np.ndarray, np.ndarray, float] | None = None
    temperature: float = 1.0

    def logits(self, x: np.ndarray) -> np.ndarray:
        w1, b1, w2, b2 = self.layers
        z = np.clip((x - self.center) / self.scale, -8, 8)
        return np.tanh(z @ w1 + b1) @ w2 + b2

    def scores(self, x: np.ndarray) -> np.ndarray:
        """Scores of document vectors."""
        return 1 / (1 + np.exp(-np.clip(self.logits(x.astype(np.float64)) / self.temperature, -40, 40)))


    def rate(self, texts: pa.Array) -> np.ndarray:
        if self.layers is None:
            return np.full(len(texts), self.prior)
        return self.scores(document_vectors(texts, self.contexts))


def fit_network(x: np.ndarray, y: np.ndarray, hidden: int = 24, epochs: int = 40, rate: float = 3e-3, decay: float = 1e-3, seed: int = 7) -> QualityModel:
    """Adam on the logistic loss over four fifths of the rows; the temperature over the last fifth."""
    if len(y) < 20 or y.min() == y.max():
        return QualityModel(float(y.mean()) if len(y) else 0.5)
    random = np.random.default_rng(seed)
    order = random.permutation(len(y))
    aside, used = order[: len(y) // 5], order[len(y) // 5 :]
    center, scale = x[used].mean(0), x[used].std(0) + 1e-6
    z, t = np.clip((x - center) / scale, -8, 8), y.astype(np.float64)
    weights = [random.normal(0, 1 / np.sqrt(x.shape[1]), (x.shape[1], hidden)), np.zeros(hidden), random.normal(0, 1 / np.sqrt(hidden), hidden), np.zeros(1)]
    first, second, step = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights], 0
    for _ in range(epochs):
        for batch in np.array_split(random.permutation(used), max(1, len(used) // 128)):
            inner = np.tanh(z[batch] @ weights[0] + weights[1])
            error = (1 / (1 + np.exp(-np.clip(inner @ weights[2] + weights[3], -40, 40))) - t[batch]) / len(batch)
            back = np.outer(error, weights[2]) * (1 - inner**2)
            slopes = [z[batch].T @ back + decay * weights[0], back.sum(0), inner.T @ error + decay * weights[2], np.array([error.sum()])]
            step += 1
            for w, g, m, v in zip(weights, slopes, first, second, strict=True):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                w -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    model = QualityModel(float(t.mean()), None, center, scale, (weights[0], weights[1], weights[2], float(weights[3][0])))
    held = aside if len(np.unique(t[aside])) > 1 else order
    logits = model.logits(x[held])
    losses = {}
    for temperature in np.geomspace(0.25, 8, 61):
        p = np.clip(1 / (1 + np.exp(-np.clip(logits / temperature, -40, 40))), 1e-9, 1 - 1e-9)
        losses[float(temperature)] = -(t[held] * np.log(p) + (1 - t[held]) * np.log(1 - p)).mean()
    model.temperature = min(losses, key=losses.get)
    return model


def _vectors(contexts):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = document_vectors(batch.column(2), contexts.value)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([r.tobytes() for r in x], pa.binary())], names=["label", "rank", "vector"])

    return run


def train_quality_model(docs: DataFrame, labelled: DataFrame, key: str = "doc_id", text: str = "text", label: str = "label", max_rows: int = MAX_TRAINING_ROWS) -> QualityModel:
    """Fit on rows of ``docs`` that ``labelled`` (key, label 0 or 1) marks, ``max_rows`` at most; context vectors on all of ``docs``.

    The bounded sample is that of the smallest hashes: of keys among the labels, then of key and text among the
    rows, so that rows which repeat a key do not crowd out others and the label has no say. Null keys, labels and
    other labels are left out; where a key is labelled twice the larger label counts.
    """
    sample = (
        labelled.where(F.col(key).isNotNull() & F.col(label).isin(0, 1))
        .groupBy(key)
        .agg(F.max(label).cast("int").alias("label"))
        .orderBy(F.xxhash64(key), key)
        .limit(max_rows)
    )
    # at most max_rows narrow rows, so their broadcast is bounded
    rows = docs.select(F.col(key), F.col(text).alias("text")).join(F.broadcast(sample), key)
    if not rows.limit(1).count():
        return QualityModel(0.5)
    contexts = context_vectors(docs, text)
    sent = docs.sparkSession.sparkContext.broadcast(contexts)
    ranked = rows.select("label", F.xxhash64(key, "text").alias("rank"), "text").mapInArrow(_vectors(sent), "label int, rank long, vector binary")
    table = ranked.orderBy("rank", "label", "vector").limit(max_rows).toArrow()
    y = np.array(table["label"].to_pylist())
    x = np.frombuffer(b"".join(table["vector"].to_pylist()), dtype=np.float32).reshape(len(y), N_FEATURES).astype(np.float64)
    model = fit_network(x, y)
    model.contexts = contexts
    return model


def _score(model, place: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = model.value.rate(batch.column(place))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores, pa.float64())], names=[*batch.schema.names, "score"])

    return run


def score_quality(docs: DataFrame, model: QualityModel, text: str = "text", score: str = "score") -> DataFrame:
    """``docs`` with a score from 0 to 1 appended (a column of that name is replaced); empty texts too."""
    bound_arrow_batches(docs.sparkSession)
    kept = docs.drop(score)
    sent = Shipped(docs.sparkSession, model)
    schema = T.StructType([*[T.StructField(f.name, f.dataType, True) for f in kept.schema], T.StructField(score, T.DoubleType())])
    return kept.mapInArrow(_score(sent, kept.columns.index(text)), schema)


def held_out(key: Column) -> Column:
    """Rows whose labels are never learned from."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def training_labels(labels: DataFrame) -> DataFrame:
    return labels.where(~held_out(F.col("doc_id"))).select("doc_id", F.col("quality").alias("label"))


def keep_quality(docs: DataFrame, model: QualityModel, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """Rows of ``docs`` that the model predicts as label 1.

    All rows if nothing was learned: below 20 usable labelled rows, or with one label only, the model has no layers.
    """
    if model.layers is None:
        return docs
    score = distinct_name(docs, "_score")
    return score_quality(docs, model, text, score).where(F.col(score) >= threshold).drop(score)


def op8_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = train_quality_model(docs, training_labels(labels))
    return score_quality(docs, model).select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted")
    )
