"""Quality classifier: random-indexing word vectors pooled per document, then a two-layer numpy network.

Words and their endings are hashed to rows. Each row has a sparse ternary index vector
made by a rule; its word vector adds the index vectors of its neighbours in all
documents. A document is the mean of its words' vectors, the mean's length,
its number of words, and how often a word's index vector is that of the word one to
four before. The network's logit is divided by a temperature fitted on
documents that training did not see.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ordkeys.llm.common import materialize

#: Rows for words, as many for endings; dimensions of a vector; nonzero entries of an index vector.
ROWS, DIMS, NONZERO = 8_192, 64, 6
#: Parts in which a table of sums is handed on; a divisor of 2 * ROWS.
SLICES = 1_024
#: How far back a word is compared with earlier ones.
AGAIN = 4
#: Bytes of an ending.
ENDING = 2
#: Most labelled documents that the network and its temperature are fitted on: those with the smallest hashes of doc_id. Word vectors come from all documents.
MAX_SAMPLE = 8_000
#: Least score of a document predicted to be good.
THRESHOLD = 0.7

_HIDDEN, _EPOCHS, _RATE, _DECAY = 32, 300, 0.02, 1e-4
#: Words of documents pooled at a time.
_CHUNK = 50_000


def index_vectors(rows: int = 2 * ROWS, dims: int = DIMS, nonzero: int = NONZERO) -> np.ndarray:
    """Sparse ternary vectors, the same wherever they are made."""
    rng = np.random.default_rng(7)
    out = np.zeros((rows, dims), np.int32)
    at = np.argsort(rng.random((rows, dims)), axis=1)[:, :nonzero]
    np.put_along_axis(out, at, np.where(np.arange(nonzero) % 2, -1, 1)[None, :].repeat(rows, 0), 1)
    return out


def word_rows(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Rows of the words and of their endings. bytes.split() parts at ASCII white space."""
    w = text.encode("utf-8", "surrogatepass").split() if text else []
    words = np.fromiter(map(crc32, w), np.uint32, len(w)) % ROWS
    ends = np.fromiter((crc32(x[-ENDING:]) for x in w), np.uint32, len(w)) % ROWS
    return words.astype(np.int64), ends.astype(np.int64) + ROWS


def context_sums(texts: list[str | None], index: np.ndarray) -> np.ndarray:
    """For each row the sum of the index vectors of the two words on either side, over all texts."""
    out = np.zeros(index.shape, np.int64)
    blank = len(index)  # a row of zeros; two stand between texts
    padded = np.concatenate((index, np.zeros((1, index.shape[1])))).astype(np.int8)
    gap = np.full(2, blank, np.int16)
    held = [(gap, gap)]
    for text in texts:
        words, ends = word_rows(text)
        held += [(words.astype(np.int16), ends.astype(np.int16)), (gap, gap)]
    all_words, all_ends = (np.concatenate(x) for x in zip(*held, strict=True))
    last = len(all_words) - 2
    for start in range(2, last, _CHUNK):
        stop = min(start + _CHUNK, last)
        near = padded[all_words[start - 2 : stop + 2]]
        around = near[:-4] + near[1:-3] + near[3:-1] + near[4:]
        for rows in (all_words[start:stop], all_ends[start:stop]):
            order = np.argsort(rows, kind="stable")
            found, first = np.unique(rows[order], return_index=True)
            sums = np.add.reduceat(around[order], first, axis=0, dtype=np.int32)
            real = found < blank
            out[found[real]] += sums[real]
    return out


def word_vectors(sums: np.ndarray, index: np.ndarray) -> np.ndarray:
    """Index vector plus the direction of its contexts; rows without contexts are their index vectors."""
    length = np.linalg.norm(sums.astype(np.float64), axis=1, keepdims=True)
    own = index / np.sqrt((index**2).sum(1, keepdims=True))
    return (own + 0.5 * sums / np.maximum(length, 1)).astype(np.float32)


def pooled(text: str | None, vectors: np.ndarray) -> np.ndarray:
    """Mean word vector, log of its length, log of the number of words, shares of words in the same row as the word 1 to 4 before."""
    words, ends = word_rows(text)
    total = np.zeros(2 * vectors.shape[1])
    for i in range(0, len(words), _CHUNK):
        a, b = words[i : i + _CHUNK], ends[i : i + _CHUNK]
        total += np.concatenate((vectors[a].sum(0, dtype=np.float64), vectors[b].sum(0, dtype=np.float64)))
    mean = total / max(1, len(words))
    again = [(words[k:] == words[:-k]).sum() / max(1, len(words) - k) for k in range(1, AGAIN + 1)]
    return np.concatenate((mean, [np.log(1e-3 + np.linalg.norm(mean)), np.log1p(len(words)), *again])).astype(np.float32)


@dataclass
class Network:
    """Two layers; the logit of label 1 over the temperature."""

    center: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float = 1.0

    def logits(self, x: np.ndarray) -> np.ndarray:
        z = (x - self.center) / self.scale
        return np.tanh(z @ self.w1 + self.b1) @ self.w2 + self.b2

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -40, 40)))


def train(x: np.ndarray, y: np.ndarray, *, hidden: int = _HIDDEN, epochs: int = _EPOCHS) -> Network:
    """Fit by Adam on four fifths; the temperature on the last fifth. With fewer than ten documents or one label, the score is the labels' mean for all."""
    dims = x.shape[1]
    if len(y) < 10 or y.min() == y.max():
        mean = float(np.clip(y.mean() if len(y) else 0.5, 1e-3, 1 - 1e-3))
        return Network(np.zeros(dims), np.ones(dims), np.zeros((dims, 1)), np.zeros(1), np.zeros(1), float(np.log(mean / (1 - mean))))
    held = np.arange(len(y)) % 5 == 4
    rng = np.random.default_rng(11)
    center, scale = x[~held].mean(0, dtype=np.float64), x[~held].std(0, dtype=np.float64) + 1e-6
    z, t = (x[~held] - center) / scale, y[~held].astype(np.float64)
    p = [rng.normal(0, 1 / np.sqrt(dims), (dims, hidden)), np.zeros(hidden), rng.normal(0, 1 / np.sqrt(hidden), hidden), np.zeros(1)]
    m, v = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p]
    for step in range(1, epochs + 1):
        h = np.tanh(z @ p[0] + p[1])
        d = (1 / (1 + np.exp(-np.clip(h @ p[2] + p[3], -40, 40))) - t) / len(t)
        back = np.outer(d, p[2]) * (1 - h**2)
        for i, g in enumerate((z.T @ back + _DECAY * p[0], back.sum(0), h.T @ d + _DECAY * p[2], np.array([d.sum()]))):
            m[i] = 0.9 * m[i] + 0.1 * g
            v[i] = 0.999 * v[i] + 0.001 * g * g
            p[i] = p[i] - _RATE * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.999**step)) + 1e-8)
    net = Network(center, scale, p[0], p[1], p[2], float(p[3][0]))
    logits, labels = net.logits(x[held]), y[held]
    loss = lambda temperature: np.logaddexp(0, np.where(labels == 1, -1, 1) * logits / temperature).mean()
    net.temperature = float(min(np.geomspace(0.25, 10, 60), key=loss))
    return net


@dataclass
class Classifier:
    vectors: np.ndarray
    network: Network

    def scores(self, texts: list[str | None]) -> np.ndarray:
        if not texts:
            return np.zeros(0)
        return self.network.scores(np.stack([pooled(t, self.vectors) for t in texts]))


def sample_of(docs: DataFrame, labels: DataFrame, *, max_sample: int = MAX_SAMPLE) -> DataFrame:
    """doc_id, text, label of at most max_sample labelled documents, those with the smallest hashes of doc_id.

    labels: doc_id, quality; rows with nulls are left out, repeated ids count once
    (the smaller label). Of documents that share an id, the one whose text has the
    smallest hash counts. So neither the ids, which are broadcast, nor the rows are
    more than max_sample.
    """
    ids = (
        labels.select("doc_id", F.col("quality").alias("label")).dropna()
        .groupBy("doc_id").agg(F.min("label").alias("label"))
        .orderBy(F.xxhash64(F.lit("sample"), "doc_id"), "doc_id").limit(max_sample)
    )
    found = docs.select("doc_id", "text").join(F.broadcast(materialize(ids, "sample-ids")), "doc_id")
    one = F.min_by(F.struct("text", "label"), F.struct(F.xxhash64("text"), "text")).alias("one")
    return found.groupBy("doc_id").agg(one).select("doc_id", "one.text", "one.label")


def corpus_vectors(docs: DataFrame) -> np.ndarray:
    """Word vectors with the contexts of all documents.

    Each task hands on its table of sums in SLICES parts. Parts of the same place are
    summed by one task, so that the driver gets each place once, however many tasks there are.
    """
    spark = docs.sparkSession
    index = index_vectors()
    shared = spark.sparkContext.broadcast(index)

    def handed(places: list[int], parts: list[np.ndarray]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(places, pa.int32()), pa.array([x.tobytes() for x in parts], pa.binary())], ["slice", "sums"])

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(shared.value.shape, np.int64)
        for batch in batches:
            total += context_sums(batch.column("text").to_pylist(), shared.value)
        parts = total.reshape(SLICES, -1)
        found = np.flatnonzero(parts.any(axis=1))
        if len(found):
            yield handed(found.tolist(), list(parts[found]))

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for place, x in zip(batch.column("slice").to_pylist(), batch.column("sums"), strict=True):
                part = np.frombuffer(x.as_buffer(), np.int64)
                if place in total:
                    total[place] += part
                else:
                    total[place] = part.copy()
        if total:
            yield handed(list(total), list(total.values()))

    sums = docs.select("text").mapInArrow(own, "slice int, sums binary")
    total = np.zeros((SLICES, index.size // SLICES), np.int64)
    for row in sums.repartition("slice").mapInArrow(summed, "slice int, sums binary").collect():  # at most SLICES
        total[row.slice] = np.frombuffer(row.sums, np.int64)
    shared.destroy()
    return word_vectors(total.reshape(index.shape), index)


def fit(docs: DataFrame, labels: DataFrame, *, max_sample: int = MAX_SAMPLE) -> Classifier:
    """Word vectors from all documents, network from a bounded sample of labelled ones; what comes to the driver is bounded by the sample and by ROWS * DIMS."""
    spark = docs.sparkSession
    sample = materialize(sample_of(docs, labels, max_sample=max_sample), "sample").repartition(8, "doc_id")
    vectors = corpus_vectors(docs)
    shared = spark.sparkContext.broadcast(vectors)

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = [pooled(t, shared.value).tobytes() for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(x, pa.binary()), batch.column("label")], ["doc_id", "x", "label"])

    kinds = dict(sample.dtypes)
    rows = sample.mapInArrow(features, f"doc_id {kinds['doc_id']}, x binary, label {kinds['label']}").toPandas()
    shared.destroy()
    rows = rows.sort_values(["doc_id", "x"], key=lambda c: c.map(lambda v: crc32(str(v).encode())) if c.name == "doc_id" else c)
    x = np.array([np.frombuffer(b, np.float32) for b in rows["x"]], np.float32).reshape(len(rows), 2 * DIMS + 2 + AGAIN)
    return Classifier(vectors, train(x, rows["label"].to_numpy()))


def score_documents(docs: DataFrame, model: Classifier, *, threshold: float = THRESHOLD) -> DataFrame:
    """Score of every whole text.

    docs: doc_id, text; other columns are ignored, and no input but the text counts.
    Returns doc_id, score (chance of label 1), predicted. Null and empty texts get
    the network's value for no words. One pass, no shuffle.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = dict(docs.dtypes)["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = shared.value.scores(batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(scores, pa.float64())], ["doc_id", "score"])

    scored = docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, score double")
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def good_documents(docs: DataFrame, model: Classifier, *, threshold: float = THRESHOLD) -> DataFrame:
    """The documents predicted to be good, with all their columns."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(shared.value.scores(batch.column("text").to_pylist()) >= threshold))

    return docs.mapInArrow(run, docs.schema)


def remainder(doc_id: Column, n: int) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % n


def training_labels(labels: DataFrame) -> DataFrame:
    """The labels that may be learnt from."""
    return labels.filter(remainder(F.col("doc_id"), 4) != 2)


def op7_quality_classifier(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = fit(docs, training_labels(spark.read.parquet(f"{sf_dir}/labels.parquet")))
    return score_documents(docs, model).select("doc_id", (remainder(F.col("doc_id"), 4) == 2).alias("held_out"), "score", "predicted")
