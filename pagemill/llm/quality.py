"""Quality: hashed word n-gram logistic regression, learnt by follow-the-regularised-leader, scored as sparse dot products."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagemill.llm.wordhash import held_out, labelled_sample, mixed, pieces, tokens

BITS = 20
#: The most labelled rows that are learnt from.
SAMPLE_ROWS = 12_000


def ngrams(texts: list[bytes], bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """(feature, text number) of every occurrence of a unigram, a bigram, and a token that repeats the one before."""
    h, _, doc = tokens(texts)
    pair = doc[1:] == doc[:-1]
    two = mixed(h[:-1] * np.uint64(3) + h[1:])[pair]
    again = (pair & (h[1:] == h[:-1])).nonzero()[0]
    feature = np.concatenate([h, two, np.full(len(again), 0x5EED, np.uint64)]) >> np.uint64(64 - bits)
    return feature.astype(np.int64), np.concatenate([doc, doc[1:][pair], doc[1:][again]])


def vector(text: bytes, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """A text's features and their values: counts over the root of the number of all, so that neither length rules."""
    f, _ = ngrams([text], bits)
    index, count = np.unique(f, return_counts=True)
    return index, count / np.sqrt(max(1, len(f)))


class Ftrl:
    """Per-coordinate FTRL-proximal for logistic loss; weights are zero until the gradients outweigh l1."""

    def __init__(self, bits: int = BITS, alpha: float = 0.5, beta: float = 1.0, l1: float = 0.1, l2: float = 1.0):
        self.z, self.n = np.zeros((1 << bits) + 1), np.zeros((1 << bits) + 1)  # the last is the bias
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2

    def weights(self, index: np.ndarray | slice = slice(None)) -> np.ndarray:
        z, n = self.z[index], self.n[index]
        w = -(z - np.sign(z) * self.l1) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2)
        return np.where(np.abs(z) <= self.l1, 0.0, w)

    def learn(self, index: np.ndarray, value: np.ndarray, label: int) -> None:
        index, value = np.append(index, len(self.z) - 1), np.append(value, 1.0)
        w = self.weights(index)
        g = (1 / (1 + np.exp(-np.clip(w @ value, -30, 30))) - label) * value
        self.z[index] += g - (np.sqrt(self.n[index] + g * g) - np.sqrt(self.n[index])) / self.alpha * w
        self.n[index] += g * g


def train(docs: DataFrame, labels: DataFrame, bound: int = SAMPLE_ROWS, epochs: int = 4, bits: int = BITS) -> np.ndarray:
    """The weights (the bias last), from a bounded sample of the labelled rows that are not held out.

    Features are computed on the executors; the driver takes the sample's vectors in hash order, so reruns agree.
    Without labelled rows all weights are zero, and every score is 0.5.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [vector(t or b"", bits) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("label"), pa.array([i.astype(np.int32) for i, _ in rows], pa.list_(pa.int32())), pa.array([v.astype(np.float32) for _, v in rows], pa.list_(pa.float32()))],
                ["doc_id", "label", "index", "value"],
            )

    drawn = labelled_sample(docs, labels, "quality", bound).select("doc_id", "label", F.col("text").cast("binary").alias("text"))
    rows = drawn.mapInArrow(run, "doc_id bigint, label int, index array<int>, value array<float>").toArrow()
    model = Ftrl(bits)
    if not rows.num_rows:
        return model.weights()
    index, value = rows.column("index").combine_chunks(), rows.column("value").combine_chunks()
    label, ids = np.asarray(rows.column("label")), np.asarray(rows.column("doc_id"))
    shuffled = np.random.default_rng(11).permutation(len(ids))
    order = np.argsort(ids, kind="stable")[shuffled]
    at, index, value = np.asarray(index.offsets), np.asarray(index.values), np.asarray(value.values)
    for _ in range(epochs):
        for i in order:
            s = slice(at[i], at[i + 1])
            model.learn(index[s], value[s].astype(np.float64), int(label[i] > 0))
    return model.weights()


def scores(weights: np.ndarray, texts: pa.Array, bits: int) -> np.ndarray:
    """The sigmoid of the bias and the dot product of each whole text's vector."""
    out = np.empty(len(texts))
    for at, part in pieces(texts):
        f, doc = ngrams(part, bits)
        n = np.bincount(doc, minlength=len(part))
        logit = weights[-1] + np.bincount(doc, weights[f], len(part)) / np.sqrt(np.maximum(n, 1))
        out[at : at + len(part)] = 1 / (1 + np.exp(-np.clip(logit, -30, 30)))
    return out


def with_score(docs: DataFrame, weights: np.ndarray, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, score) of every row."""
    bits = (len(weights) - 1).bit_length() - 1
    shared = docs.sparkSession.sparkContext.broadcast(weights.astype(np.float32))  # 4 bytes for each of 2**bits weights

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(scores(shared.value, b.column(1), bits))], ["doc_id", "score"])

    kind = docs.schema[doc_id].dataType.simpleString()
    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("binary").alias("text")).mapInArrow(run, f"doc_id {kind}, score double")


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, bound: int = SAMPLE_ROWS) -> DataFrame:
    """doc_id, held_out, score and predicted (1 if score >= threshold) of every row of docs.

    A null or empty text has no features and the bias as its score. Rows that repeat an id each come back; a null id
    is not held out and never learnt from. Other columns are not read. An empty table gives an empty table.
    """
    scored = with_score(docs, train(docs, labels, bound))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, bound: int = SAMPLE_ROWS) -> DataFrame:
    """The rows of docs, in their own columns, that the classifier does not reject (score below threshold)."""
    weights = train(docs, labels, bound)
    bits = (len(weights) - 1).bit_length() - 1
    shared = docs.sparkSession.sparkContext.broadcast(weights.astype(np.float32))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(b.schema.get_field_index("text")).cast(pa.binary())
            yield b.filter(pa.array(scores(shared.value, texts, bits) >= threshold))

    return docs.mapInArrow(run, docs.schema)
