"""Toxicity: non-negative positive-unlabelled learning of NumPy classifiers over words."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagemill.llm.wordhash import WORD, held_out, labelled_sample, pieces, tokens

BITS = 22
#: The most labelled rows that are learnt from.
LABELLED_ROWS = 24_000


#: Words also count by their beginnings of so many bytes, so that inflected forms share a weight.
PREFIXES = (4, 5, 6)


def words(texts: list[bytes], bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """(feature, text number) of every word and of its beginnings, with repeats."""
    h, kind, doc = tokens(texts, PREFIXES)
    real = kind == WORD
    return (h[real] >> np.uint64(64 - bits)).astype(np.int64), doc[real]


def _vectors(rows: DataFrame, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, feature) of the sets of words of a bounded sample in order of doc_id, and the rows' labels."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [np.unique(words([t or b""], bits)[0]).astype(np.int32) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("label"), pa.array(sets, pa.list_(pa.int32()))], ["doc_id", "label", "words"])

    got = rows.select("doc_id", "label", F.col("text").cast("binary").alias("text")).mapInArrow(run, "doc_id bigint, label int, words array<int>").toArrow()
    if not got.num_rows:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64)
    got = got.sort_by("doc_id").combine_chunks()
    sets = got.column("words").combine_chunks()
    return np.repeat(np.arange(len(sets)), np.diff(np.asarray(sets.offsets))), np.asarray(sets.values).astype(np.int64), np.asarray(got.column("label"))


def nnpu(row: np.ndarray, column: np.ndarray, labels: np.ndarray, prior: float, steps: int = 400, rate: float = 0.1, l2: float = 1e-4, seed: int = 0) -> tuple[np.ndarray, float]:
    """A linear model by the non-negative risk: prior * R+(pos) + max(0, R-(unl) - prior * R-(pos)), sigmoid loss.

    (row, column) are the ones of a 0-1 matrix with a row for each label; the positives are the rows with label 1, and
    all rows are the unlabelled text. When the part in the maximum falls below zero, a step ascends it instead, which
    keeps the model from fitting the unlabelled positives as negatives. Adam, on a bootstrap of both sets.
    """
    rng = np.random.default_rng(seed)
    n, size = len(labels), int(column.max(initial=-1)) + 1
    draw = lambda of: np.bincount(rng.choice(of, len(of)), minlength=n) / len(of)
    pos, unl = draw(np.flatnonzero(labels > 0)), draw(np.arange(n))
    w, b = np.zeros(size), -1.0
    m, v = np.zeros(size + 1), np.zeros(size + 1)
    for t in range(1, steps + 1):
        s = 1 / (1 + np.exp(-np.clip(np.bincount(row, w[column], n) + b, -30, 30)))
        slope = s * (1 - s)  # of the loss as negative; as positive its opposite
        grad = lambda d: np.append(np.bincount(column, d[row], size), d.sum())
        toward, against = grad(pos * slope), grad(unl * slope)
        negative = unl @ s - prior * (pos @ s)
        rest = against - prior * toward
        g = -prior * toward + rest if negative >= 0 else -rest
        g[:-1] += l2 * w
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        step = rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        w, b = w - step[:-1], b - step[-1]
    return w, b


def train(docs: DataFrame, labels: DataFrame, models: int = 3, bound: int = LABELLED_ROWS, bits: int = BITS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word features, weights of each model, biases) from a bounded sample of labelled rows outside the held-out ones.

    Positives are its confirmed toxic rows; its whole text, labels ignored, is the unlabelled text, so that the prior is
    the share of toxic rows of the very rows that it is used for. Words are weighed if they are surely commoner among
    the positives than among all. Without positives no word is weighed and scores stay below 0.5.
    """
    row, word, known = _vectors(labelled_sample(docs, labels, "toxic", bound), bits)
    none = np.empty(0, np.int64), np.zeros((1, 0)), np.array([-2.0])
    positives = int((known > 0).sum())
    if not positives:
        return none
    prior = min(max(positives / len(known), 0.001), 0.9)
    in_pos, in_all = np.bincount(word[known[row] > 0], minlength=1 << bits), np.bincount(word, minlength=1 << bits)
    p, u = (in_pos + 0.5) / (positives + 1), (in_all + 0.5) / (len(known) + 1)
    z = (p - u) / np.sqrt(u * (1 - u) * (1 / positives + 1 / len(known)))
    chosen = np.flatnonzero((in_pos >= 5) & (z > 6) & (p > 2 * u))
    if not len(chosen):
        return none
    column = np.searchsorted(chosen, word)
    column[column == len(chosen)] = 0
    real = chosen[column] == word
    found = [nnpu(row[real], column[real], known, prior, seed=k) for k in range(models)]
    return chosen, np.stack([w for w, _ in found]), np.array([b for _, b in found])


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """doc_id, held_out, score and predicted (1 if score >= threshold) of every row of docs.

    The score is the mean of the models' sigmoids over the set of words of the whole text. A null or empty text scores
    as one without weighed words. Rows that repeat an id each come back; a null id is not held out and never learnt
    from. Other columns are not read. An empty table gives an empty table.
    """
    chosen, weights, biases = train(docs, labels)
    shared = docs.sparkSession.sparkContext.broadcast((chosen, weights, biases))  # weights of words of the bounded sample

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chosen, weights, biases = shared.value
        slot = np.full(1 << BITS, -1, np.int32)
        slot[chosen] = np.arange(len(chosen))
        for b in batches:
            out = np.empty(b.num_rows)
            for at, texts in pieces(b.column(1)):
                f, doc = words(texts)
                s = slot[f]
                hit = np.unique(doc[s >= 0] * np.int64(max(1, len(chosen))) + s[s >= 0])
                row, col = hit // max(1, len(chosen)), hit % max(1, len(chosen))
                logits = [bias + np.bincount(row, w[col], len(texts)) for w, bias in zip(weights, biases, strict=True)]
                out[at : at + len(texts)] = np.mean([1 / (1 + np.exp(-np.clip(z, -30, 30))) for z in logits], axis=0)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out)], ["doc_id", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    scored = docs.select("doc_id", F.col("text").cast("binary").alias("text")).mapInArrow(run, f"doc_id {kind}, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
