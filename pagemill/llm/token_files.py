"""Token ids in files of adaptively range-coded blocks.

A file row is a segment: whole documents in order, their ids cut into blocks of equal length. Every block starts from
the same empty model and has its own checksum, so blocks decode alone; here many blocks of a segment are coded together,
one NumPy step for the next id of each. An id's probability mixes three predictions: the id last seen after the same two
ids, the id last seen after the same one, and the frequencies of ids in the segment, which stand before its blocks.
The weights of the first two are their rates of hits so far, kept for each pair of their states of confidence, and are
renewed at steps that grow apart. A block that coding would not shorten is stored as it is. Segments too small for a
table of frequencies take all ids as equally frequent.
"""

from __future__ import annotations

import json
import os
import struct
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pagemill.llm.chunks import ChunkEncoder, byte_names
from pagemill.llm.shared import table_path

MAGIC, VERSION = b"PMTK", 3
#: ids of a segment (more only where one document has more), ids of a block, and blocks that are coded together
SEGMENT, BLOCK, LANES = 7_000_000, 1024, 7168
_HEAD = struct.Struct("<4sHHIIQIII")
_PLAIN = 1 << 31  # set in the length of a block that is stored as it is
_SLOTS, _STATES = 256, 32
_TOTAL_BITS = _FREQ_BITS = 16
_TOTAL = 1 << _TOTAL_BITS
_TABLE_PART = 32  # a table of frequencies may take so small a part of the plain ids
_LAST_RENEWAL = 256  # steps before the last renewal of the weights
_U = np.uint64
_WORD, _SMALL, _ALL = _U(32), _U(1 << 32), _U((1 << 64) - 1)


class _Frequencies:
    """The frequencies of 16-bit ids out of 2**16: all equal, or those of a packed table."""

    def __init__(self, table: bytes = b""):
        self.size = np.ones(_TOTAL, np.uint32)
        if table:
            raw = np.frombuffer(zlib.decompress(table), "<u2").reshape(2, -1)
            self.size = np.zeros(_TOTAL, np.uint32)
            self.size[np.cumsum(raw[0], dtype=np.int64)] = raw[1].astype(np.uint32) + 1
        self.start = np.cumsum(self.size, dtype=np.uint32) - self.size
        self.id = np.repeat(np.arange(_TOTAL, dtype=np.int32), self.size)

    @staticmethod
    def table(ids: np.ndarray) -> bytes:
        """The packed table of some ids' frequencies: steps between ids, frequencies less one. Empty where it is too large."""
        count = np.bincount(ids, minlength=_TOTAL)
        there = count.nonzero()[0]
        if not len(there):
            return b""
        size = 1 + count[there] * (_TOTAL - len(there)) // len(ids)
        size[size.argmax()] += _TOTAL - size.sum()
        packed = zlib.compress(np.concatenate([np.diff(there, prepend=0), size - 1]).astype("<u2").tobytes())
        return packed if len(packed) * _TABLE_PART <= 2 * len(ids) else b""


class _Model:
    """The predictions of many blocks, each in its lane."""

    def __init__(self, lanes: int):
        lane = np.arange(lanes)
        self.one, self.two = np.zeros(lanes * _SLOTS, np.int32), np.zeros(lanes * _SLOTS, np.int32)  # id and confidence
        self.slot, self.states = lane * _SLOTS, lane * _STATES
        # Hits of the first, of the second, and of neither, to begin with: 64 for each state of confidence.
        state = np.arange(_STATES)
        first = np.array([6, 24, 44, 56])[state >> 3]
        second = (64 - first) * np.where(state & 1, 0, np.array([4, 12, 24, 36])[state >> 1 & 3]) // 64
        self.seen = np.tile(np.stack([first, second, 64 - first - second], 1).astype(np.int32), (lanes, 1))
        self.x1 = self.mark = np.zeros(lanes, np.int64)
        self.where, self.missed = np.zeros((_LAST_RENEWAL, lanes), np.int32), np.zeros((_LAST_RENEWAL, lanes), np.int8)
        self.step, self.renew_at = 0, 16
        self._renew()

    def _renew(self) -> None:
        n = self.step
        if n:
            self.seen += 4 * np.bincount((self.where[:n] * 3 + self.missed[:n]).ravel(), minlength=self.seen.size).reshape(-1, 3)
            self.step, self.renew_at = 0, self.renew_at * 2
        rates = (self.seen << 16) // self.seen.sum(1, dtype=np.int32)[:, None]
        first = np.clip(rates[:, 0], 16, _TOTAL - 2048)
        self.first, self.both = first.astype(np.uint64), (first + np.clip(rates[:, 1], 16, _TOTAL - 1024 - first)).astype(np.uint64)

    def predict(self) -> tuple[np.ndarray, np.ndarray]:
        """The ends of the two candidates' intervals out of 2**16; at least 2**10 is left for other ids."""
        self.i2 = ((self.x1 ^ self.mark) & (_SLOTS - 1)) + self.slot
        self.i1 = (self.x1 & (_SLOTS - 1)) + self.slot
        e2, e1 = self.two.take(self.i2), self.one.take(self.i1)
        self.c2, self.c1, self.e2, self.e1 = e2 >> 5, e1 >> 5, e2, e1
        self.at = (e2 & 24) + (e1 & 6) + (self.c1 == self.c2) + self.states
        return self.first.take(self.at), self.both.take(self.at)

    def update(self, x: np.ndarray, miss: np.ndarray, other: np.ndarray) -> None:
        """Take in the lanes' ids, which of them the first candidate missed, and which of them both."""
        # An entry is an id and its confidence, which a hit raises up to 3 and a miss sets to 0.
        entry = x << 5
        self.two[self.i2] = np.where(miss, entry, np.minimum(self.e2 + 8, self.e2 | 24))
        self.one[self.i1] = np.where(x == self.c1, np.minimum(self.e1 + 2, self.e1 | 6), entry)
        self.mark, self.x1 = self.x1 * 37, x.astype(np.int64)
        if self.renew_at <= _LAST_RENEWAL:
            self.where[self.step] = self.at
            np.add(miss, other, out=self.missed[self.step], dtype=np.int8)
            self.step += 1
            if self.step == self.renew_at:
                self._renew()


def _interval(first: np.ndarray, both: np.ndarray, end: np.ndarray, miss: np.ndarray, other: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start, width) of the intervals that end at first, at both or at end."""
    start = np.where(other, both, first) * miss
    return start, np.where(miss, np.where(other, end, both), first) - start


def encode_blocks(ids: np.ndarray, table: bytes = b"") -> list[bytes]:
    """The coded bytes of each row of 16-bit ids (blocks x length), by a packed table of frequencies that has them all."""
    lanes, length = ids.shape
    model, frequencies, cap = _Model(lanes), _Frequencies(table), length + 4
    begin = np.arange(lanes) * cap + 1  # the word before takes no carry: a block's number is below 1
    out, at = np.zeros(lanes * cap + 1, np.uint32), begin.copy()
    low, width = np.zeros(lanes, np.uint64), np.full(lanes, _ALL)

    def carry(rows: np.ndarray) -> None:
        p = at[rows] - 1
        while len(p):
            out[p] += np.uint32(1)
            p = p[out[p] == 0] - 1

    for x in np.ascontiguousarray(ids.T.astype(np.int32)):
        first, both = model.predict()
        miss = x != model.c2
        other = miss & (x != model.c1)
        r = width >> _U(_TOTAL_BITS)
        add, width = _interval(r * first, r * both, r << _U(_TOTAL_BITS), miss, other)
        if len(e := other.nonzero()[0]):
            own, r = x.take(e), width.take(e) >> _U(_FREQ_BITS)
            add[e] += frequencies.start.take(own) * r
            width[e] = frequencies.size.take(own) * r
        low += add
        if len(over := (low < add).nonzero()[0]):
            carry(over)
        if len(n := (width < _SMALL).nonzero()[0]):
            value, p = low.take(n), at.take(n)
            out[p], at[n] = value >> _WORD, p + 1
            low[n] = value << _WORD
            width[n] <<= _WORD
        model.update(x, miss, other)
    low += _SMALL - _U(1)  # the only multiple of 2**32 that is surely inside the interval
    carry((low < _SMALL - _U(1)).nonzero()[0])
    out[at] = low >> _WORD
    return [out[b : e + 1].astype("<u4").tobytes() for b, e in zip(begin.tolist(), at.tolist(), strict=True)]


def decode_blocks(coded: list[bytes], length: int, table: bytes = b"") -> np.ndarray:
    """The ids (blocks x length) of blocks that were coded by the table."""
    lanes, frequencies = len(coded), _Frequencies(table)
    words = [np.frombuffer(c, "<u4") for c in coded]
    cap = max((len(w) for w in words), default=0) + 4
    data = np.zeros((lanes, cap), np.uint32)
    for row, w in zip(data, words, strict=True):
        row[: len(w)] = w
    data, last = data.ravel(), lanes * cap - 1
    model, at = _Model(lanes), np.arange(lanes) * cap + 2
    code, width = data[at - 2].astype(np.uint64) << _WORD | data[at - 1], np.full(lanes, _ALL)
    out = np.empty((length, lanes), np.int32)
    for t in range(length):
        first, both = model.predict()
        r = width >> _U(_TOTAL_BITS)
        first, both = r * first, r * both
        miss, other = code >= first, code >= both
        start, width = _interval(first, both, r << _U(_TOTAL_BITS), miss, other)
        code -= start
        x = np.where(miss, model.c1, model.c2)
        if len(e := other.nonzero()[0]):
            r, rest = width.take(e) >> _U(_FREQ_BITS), code.take(e)
            own = frequencies.id.take(np.minimum(rest // r, _U(_TOTAL - 1)).astype(np.int64))
            code[e], width[e], x[e] = rest - frequencies.start.take(own) * r, frequencies.size.take(own) * r, own
        if len(n := (width < _SMALL).nonzero()[0]):
            p = np.minimum(at.take(n), last)  # a damaged block may ask for more than there is
            code[n] = code.take(n) << _WORD | data.take(p)
            width[n] <<= _WORD
            at[n] = p + 1
        out[t] = x
        model.update(x, miss, other)
    return out.T


def pack(doc_ids: list[int | None], ids: list[bytes], kind: str = "<u2") -> bytes:
    """A segment of documents and their ids, little-endian integers of 16 or 32 bits; of the latter each half is coded."""
    tokens = np.frombuffer(b"".join(ids), kind)
    size = tokens.dtype.itemsize
    n = -(-len(tokens) // BLOCK)
    coded: list[bytes] = []
    tables: list[bytes] = []
    for half in range(size // 2):
        padded = np.zeros((n, BLOCK), "<u2")
        padded.reshape(-1)[: len(tokens)] = (tokens >> (16 * half) & 0xFFFF) if half or size > 2 else tokens
        tables.append(_Frequencies.table(padded.reshape(-1)))
        for at in range(0, n, LANES):
            part = padded[at : at + LANES]
            coded += [c if len(c) < 2 * BLOCK else row.tobytes() for c, row in zip(encode_blocks(part, tables[-1]), part, strict=True)]
    index = np.array([[len(c) | (_PLAIN if len(c) == 2 * BLOCK else 0), zlib.crc32(c)] for c in coded], "<u4").tobytes()
    known = np.array([d is not None for d in doc_ids], np.uint8).tobytes()
    docs = np.array([d or 0 for d in doc_ids], "<i8").tobytes() + np.array([len(i) // size for i in ids], "<u4").tobytes() + known
    body = docs + index + np.array([len(t) for t in tables], "<u4").tobytes() + b"".join(tables)
    return _HEAD.pack(MAGIC, VERSION, size // 2, BLOCK, len(doc_ids), len(tokens), n, len(body), zlib.crc32(body)) + body + b"".join(coded)


def unpack(segment: bytes) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    """(doc_ids, ids of each document, all ids) of a segment; a checksum that doesn't match is an error."""
    magic, version, halves, block, docs, tokens, n, body, crc = _HEAD.unpack_from(segment)
    at = _HEAD.size
    if magic != MAGIC or version != VERSION or zlib.crc32(segment[at : at + body]) != crc:
        raise ValueError("not a token segment, or its index is damaged")
    ids, count = np.frombuffer(segment, "<i8", docs, at), np.frombuffer(segment, "<u4", docs, at + 8 * docs)
    known = np.frombuffer(segment, np.uint8, docs, at + 12 * docs)
    index = np.frombuffer(segment, "<u4", 2 * n * halves, at + 13 * docs).reshape(-1, 2)
    lengths = np.frombuffer(segment, "<u4", halves, at + 13 * docs + 8 * n * halves)
    starts = at + body - int(lengths.sum()) + np.cumsum(lengths, dtype=np.int64) - lengths
    tables = [segment[s : s + k] for s, k in zip(starts.tolist(), lengths.tolist(), strict=True)]
    plain, sizes = index[:, 0] >= _PLAIN, (index[:, 0] & (_PLAIN - 1)).astype(np.int64)
    ends = at + body + np.cumsum(sizes)
    coded = [segment[e - size : e] for e, size in zip(ends.tolist(), sizes.tolist(), strict=True)]
    for i, c in enumerate(coded):
        if zlib.crc32(c) != index[i, 1]:
            raise ValueError(f"block {i} is damaged")
    out = np.empty((n * halves, block), np.uint32)
    for i in plain.nonzero()[0].tolist():
        out[i] = np.frombuffer(coded[i], "<u2")
    for half, table in enumerate(tables):
        rest = half * n + (~plain[half * n : half * n + n]).nonzero()[0]
        for k in range(0, len(rest), LANES):
            rows = rest[k : k + LANES]
            out[rows] = decode_blocks([coded[i] for i in rows.tolist()], block, table)
    all_ids = out[:n].reshape(-1)[:tokens]
    if halves == 2:
        all_ids = all_ids | out[n:].reshape(-1)[:tokens] << np.uint32(16)
    return [int(d) if k else None for d, k in zip(ids, known, strict=True)], count, all_ids


_encoders: dict[str, tuple[ChunkEncoder, str]] = {}


def library_encoder(path: str) -> tuple[ChunkEncoder, str]:
    """The worker's encoder by the tokenizers library, built once, and the kind of integer that its ids need.

    A byte-level tokenizer with the usual pattern cuts before every space or line break after a character that is no
    white space; pieces between such cuts are encoded once. Others encode whole texts, and so does a text that holds an
    added token's string, which the library finds before anything else.
    """
    if path not in _encoders:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        tokenizer = Tokenizer.from_file(path)
        if hasattr(tokenizer.model, "_resize_cache"):
            tokenizer.model._resize_cache(0)  # pieces are kept here, and the model's own cache costs more than it saves
        settings, (kind, code) = json.loads(tokenizer.to_str()), ("<u2", "H") if tokenizer.get_vocab_size() <= 1 << 16 else ("<u4", "I")
        before = settings["pre_tokenizer"] or {}
        known = before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space") and not settings["normalizer"]

        # A space before Latin letters is one pre-token, a line break before them another one. Such pieces go to the
        # library's model many at a time, by the characters that stand for their bytes; a piece's first token has its
        # only space or line break.
        words, names = Tokenizer(tokenizer.model), byte_names()
        words.pre_tokenizer = pre_tokenizers.Split(" ", "removed")
        named = "".join(chr(b) if b in b" \n" else names[b] for b in range(256))
        begins = np.zeros(tokenizer.get_vocab_size(), bool)
        begins[[i for token, i in tokenizer.get_vocab().items() if token[0] in (names[32], names[10])]] = True

        def encode(text: str) -> bytes:
            return array(code, tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

        def together(pieces: list[str]) -> dict[str, bytes]:
            found, plain = {}, [p for p in pieces if p[0] in " \n" and p[1:].isalpha() and (p.isascii() or max(p) < "\u0250")]
            for at in range(0, len(plain), 1024):
                part = plain[at : at + 1024]
                text = "".join(part)
                text = (text if text.isascii() else text.encode().decode("latin-1").translate(named)).replace(" ", " " + names[32]).replace("\n", f" {names[10]} ")
                ids = np.array(words.encode_batch_fast([text], add_special_tokens=False)[0].ids, kind)
                first = begins.take(ids).nonzero()[0]
                if len(first) == len(part):
                    raw, cuts = ids.tobytes(), [*(first * ids.itemsize).tolist(), ids.nbytes]
                    found.update((p, raw[b:e]) for p, b, e in zip(part, cuts, cuts[1:]))
            return found

        added = tuple(t["content"] for t in settings["added_tokens"])
        _encoders[path] = (ChunkEncoder(encode, kind, " \n", added, together) if known else ChunkEncoder(encode, kind, "")), kind
    return _encoders[path]


def write(docs: DataFrame, path: str, tokenizer: str, doc_id: str = "doc_id", text: str = "text", end: int = 0) -> None:
    """Write docs' ids at path as rows (part, segment, n_tokens, data), in ascending doc_id order.

    Each whole text's ids are followed by the id `end`; a null or empty text has only that. Rows without a doc_id come
    first; rows that share one are ordered by a hash of their texts. Spark's writer commits tasks, so a retried task
    leaves one copy. An empty table makes an empty one.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (encode, kind), part, number = library_encoder(tokenizer), TaskContext.get().partitionId(), 0
        held: tuple[list, list] = [], []
        held_n, last = 0, np.array([end], kind).tobytes()

        def flush() -> pa.RecordBatch:
            row = [[part], [number], [held_n], [pack(*held, kind)]]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(row, (pa.int32(), pa.int32(), pa.int64(), pa.binary()), strict=True)], ["part", "segment", "n_tokens", "data"])

        for b in batches:
            for d, ids in zip(b.column(0).to_pylist(), encode.column(b.column(1)), strict=True):
                ids += last
                n = len(ids) // len(last)
                if held[0] and held_n + n > SEGMENT:
                    yield flush()
                    held, held_n, number = ([], []), 0, number + 1
                held[0].append(d)
                held[1].append(ids)
                held_n += n
        if held[0]:
            yield flush()

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    ordered = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", F.xxhash64("text"))
    ordered.mapInArrow(run, "part int, segment int, n_tokens bigint, data binary").write.parquet(path)


def read(spark, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document in the files, from their decoded ids.

    start counts the ids of all documents before it: those of earlier parts, of earlier segments of the part, and of
    earlier documents of the segment. Only one row per part is ordered as a whole.
    """
    files = spark.read.schema("part int, segment int, n_tokens bigint, data binary").parquet(path)
    sizes = files.select("part", "segment", "n_tokens")
    parts = sizes.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    before = parts.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("part_start"))
    inside = F.coalesce(F.sum("n_tokens").over(Window.partitionBy("part").orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.select("part", "segment", inside.alias("inside")).join(before, "part").select("part", "segment", (F.col("inside") + F.col("part_start")).alias("segment_start"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in range(b.num_rows):
                doc_ids, count, ids = unpack(b.column(2)[row].as_py())
                raw, at = ids.astype("<u4").tobytes(), np.concatenate([[0], np.cumsum(count, dtype=np.int64)])
                crc = [zlib.crc32(raw[4 * s : 4 * e]) for s, e in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
                n = len(doc_ids)
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).take(pa.array([row] * n)), b.column(1).take(pa.array([row] * n)), pa.array(doc_ids, pa.int64()), pa.array(at[:-1]), pa.array(count.astype(np.int64)), pa.array(crc, pa.int64())],
                    ["part", "segment", "doc_id", "offset", "n_tokens", "ids_crc32"],
                )

    found = files.select("part", "segment", "data").mapInArrow(run, "part int, segment int, doc_id bigint, offset bigint, n_tokens bigint, ids_crc32 bigint")
    return found.join(starts, ["part", "segment"]).select("doc_id", (F.col("segment_start") + F.col("offset")).alias("start"), "n_tokens", "ids_crc32")


def write_and_read(docs: DataFrame, tokenizer: str) -> DataFrame:
    """What read() finds after write() of docs to a fresh table in the shared folder."""
    path = table_path(docs.sparkSession, "token-files")
    write(docs, path, tokenizer)
    return read(docs.sparkSession, path)
