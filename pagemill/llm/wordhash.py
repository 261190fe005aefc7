"""Hashes of the words of many texts at once, with NumPy, and bounded samples of labelled rows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACE, WORD, MARK = 0, 1, 2
_PIECE = 1 << 20
_BASE = 0x9E3779B97F4A7C15
_BYTES = np.arange(256)
_LETTER = ((_BYTES >= 48) & (_BYTES <= 57)) | ((_BYTES >= 65) & (_BYTES <= 90)) | ((_BYTES >= 97) & (_BYTES <= 122)) | (_BYTES >= 128)
_CLASS = np.where(_LETTER, WORD, np.where(_BYTES <= 32, SPACE, MARK)).astype(np.uint8)
_FOLD = np.where((_BYTES >= 65) & (_BYTES <= 90), _BYTES + 32, _BYTES).astype(np.uint64) + np.uint64(1)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


class _Tables:
    up: np.ndarray | None = None
    down: np.ndarray | None = None

    @classmethod
    def get(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if cls.up is None or len(cls.up) < n:
            size = max(n, 2 * _PIECE)
            cls.up, cls.down = _powers(_BASE, size), _powers(pow(_BASE, -1, 1 << 64), size)
        return cls.up, cls.down


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def tokens(texts: list[bytes], prefixes: tuple[int, ...] = ()) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, class, text number) of every token: runs of letters, digits and non-ASCII bytes, and runs of marks.

    A-Z count as a-z. The hash of a run is a polynomial in its bytes, from differences of one running sum. After the
    tokens come, for each length in prefixes, the beginnings of that many bytes of the longer tokens.
    """
    joined = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    kind = _CLASS[joined]
    edge = np.flatnonzero(np.concatenate([[True], kind[1:] != kind[:-1], [True]]))
    begin, end = edge[:-1], edge[1:]
    real = kind[begin] != SPACE
    begin, end = begin[real], end[real]
    up, down = _Tables.get(len(joined) + 1)
    run = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_FOLD[joined] * up[: len(joined)], dtype=np.uint64)])
    starts = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])[:-1]]) if texts else np.empty(0, np.int64)
    doc = np.searchsorted(starts, begin, "right") - 1
    found = [(mixed((run[end] - run[begin]) * down[begin]), kind[begin], doc)]
    for n in prefixes:
        longer = end - begin > n
        at = begin[longer]
        found.append((mixed((run[at + n] - run[at]) * down[at] + np.uint64(n)), kind[at], doc[longer]))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def pieces(texts: pa.Array) -> Iterator[tuple[int, list[bytes]]]:
    """(first row, texts) of runs of rows of about a MiB together; a longer text comes alone, whole; null is empty."""
    at, held, size = 0, [], 0
    for i, t in enumerate(texts):
        t = t.as_py() or b""
        if held and size + len(t) > _PIECE:
            yield at, held
            at, held, size = i, [], 0
        held.append(t)
        size += len(t)
    if held:
        yield at, held


def held_out(doc_id: Column) -> Column:
    """The rows whose labels are never learnt: crc32 of the id as text is a multiple of 5."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, bound: int) -> DataFrame:
    """(doc_id, text, label) of at most `bound` labelled rows that are not held out: those with the smallest hash.

    Only the bounded list of ids is broadcast. Conflicting labels of an id count as the largest; of rows that repeat an
    id the text with the smallest hash is taken, so that the bound holds for rows too.
    """
    known = labels.select("doc_id", F.col(label).cast("int").alias("label")).filter(F.col("doc_id").isNotNull() & F.col("label").isNotNull() & ~held_out(F.col("doc_id")))
    drawn = known.groupBy("doc_id").agg(F.max("label").alias("label")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(bound)
    found = docs.select("doc_id", "text").join(F.broadcast(drawn), "doc_id")
    return found.groupBy("doc_id").agg(F.min_by(F.coalesce("text", F.lit("")), F.xxhash64("text")).alias("text"), F.max("label").alias("label"))
