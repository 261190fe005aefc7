"""Byte-level BPE by a sentencepiece model that is written out directly from a rank file.

Each byte has a printable character; a token's piece is its bytes' characters, its score its negative rank. With an
identity normaliser, sentencepiece then merges as the ranks say. Decoding maps the pieces' characters back to bytes.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagemill.llm.chunks import ChunkEncoder, byte_names


_TO_PIECE = byte_names()
CHARACTERS = list(_TO_PIECE.values())
_TO_BYTE = {ord(c): b for b, c in _TO_PIECE.items()}


def piece_of(token: bytes) -> str:
    return token.decode("latin-1").translate(_TO_PIECE)


def bytes_of(piece: str) -> bytes:
    return piece.translate(_TO_BYTE).encode("latin-1")


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}


def _varint(n: int) -> bytes:
    out = b""
    while n > 127:
        out += bytes([n & 127 | 128])
        n >>= 7
    return out + bytes([n])


def _field(number: int, value: int | float | bytes) -> bytes:
    if isinstance(value, bytes):
        return _varint(number << 3 | 2) + _varint(len(value)) + value
    if isinstance(value, float):
        return _varint(number << 3 | 5) + struct.pack("<f", value)
    return _varint(number << 3) + _varint(value & (1 << 64) - 1)


def sentencepiece_model(ranks: dict[bytes, int]) -> bytes:
    """A serialised model: piece i is the token of rank i, the last piece is the unknown one.

    Fixed values of the format: fields 1, 2 and 3 hold the pieces, the trainer's and the normaliser's settings; a
    piece has its text, score and kind (1 normal, 2 unknown); model kind 2 is BPE.
    """
    tokens = sorted(ranks, key=ranks.get)
    if [ranks[t] for t in tokens] != list(range(len(tokens))):
        raise ValueError("ranks must be 0, 1, 2, ... without gaps")
    pieces = [_field(1, piece_of(t).encode()) + _field(2, -float(r)) + _field(3, 1) for r, t in enumerate(tokens)]
    pieces.append(_field(1, b"<unk>") + _field(2, 0.0) + _field(3, 2))
    trainer = _field(3, 2) + _field(4, len(pieces)) + _field(40, len(tokens)) + _field(41, -1) + _field(42, -1) + _field(43, -1)
    normaliser = _field(1, b"identity") + _field(2, b"") + _field(3, 0) + _field(4, 0) + _field(5, 0)
    return b"".join(_field(1, p) for p in pieces) + _field(2, trainer) + _field(3, normaliser)


class Codec:
    """Encodes texts to ids, and ids to bytes, as 32-bit little-endian arrays."""

    def __init__(self, path: str, pattern: str):
        import sentencepiece

        self.ranks, self.pattern = read_ranks(path), regex.compile(pattern)
        self.model = sentencepiece.SentencePieceProcessor(model_proto=sentencepiece_model(self.ranks))
        self.vocabulary = [bytes_of(self.model.id_to_piece(i)) for i in range(len(self.ranks))]
        self.encode = ChunkEncoder(self._piecewise, "<u4")

    def _piecewise(self, text: str) -> bytes:
        out = []
        for token in map(str.encode, self.pattern.findall(text)):
            ids = self.model.encode(piece_of(token))
            if len(ids) > 1 and (whole := self.ranks.get(token)) is not None:
                ids = [whole]  # a token that no merges reach is still its pre-token's id
            out += ids
        return struct.pack(f"<{len(out)}I", *out)

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.vocabulary.__getitem__, np.frombuffer(ids, "<u4").tolist()))


_codecs: dict[tuple[str, str], Codec] = {}


def codec(path: str, pattern: str) -> Codec:
    """The worker's codec, built once."""
    if (path, pattern) not in _codecs:
        _codecs[path, pattern] = Codec(path, pattern)
    return _codecs[path, pattern]


def encode(docs: DataFrame, path: str, pattern: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns in keep and ids, the whole text's ids as 32-bit little-endian binary.

    A null or empty text has no ids. Special tokens' strings are ordinary text. Every row comes back.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path, pattern)
        try:
            for b in batches:
                for at in range(0, b.num_rows, 1000):
                    part = b.slice(at, 1000)
                    ids = list(own.encode.column(part.column(part.num_columns - 1)))
                    yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(ids, pa.binary())], [*keep, "ids"])
        finally:
            b = part = ids = None
            own.encode.rest()

    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep) + ", ids binary"
    return docs.select(*keep, F.col(text).alias("_text")).mapInArrow(run, schema)


def encode_decode(docs: DataFrame, path: str, pattern: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """As encode(), with decoded_sha256, the digest of the bytes that each row's ids decode to, in the same pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, sha = codec(path, pattern), hashlib.sha256
        try:
            for b in batches:
                for at in range(0, b.num_rows, 1000):
                    part = b.slice(at, 1000)
                    ids = list(own.encode.column(part.column(part.num_columns - 1)))
                    yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(ids, pa.binary()), pa.array([sha(own.decode(x)).hexdigest() for x in ids], pa.string())], [*keep, "ids", "decoded_sha256"])
        finally:
            b = part = ids = None
            own.encode.rest()

    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep) + ", ids binary, decoded_sha256 string"
    return docs.select(*keep, F.col(text).alias("_text")).mapInArrow(run, schema)


def digests(encoded: DataFrame, path: str, pattern: str, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns in keep, n_tokens, ids_sha256 and decoded_sha256 of encoded(ids)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, sha = codec(path, pattern), hashlib.sha256
        for b in batches:
            ids = b.column(b.num_columns - 1)
            raw = [x.as_py() for x in ids]
            out = [pa.array([len(x) // 4 for x in raw], pa.int64()), pa.array([sha(x).hexdigest() for x in raw]), pa.array([sha(own.decode(x)).hexdigest() for x in raw])]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], *out], [*keep, "n_tokens", "ids_sha256", "decoded_sha256"])

    schema = ", ".join(f"`{c}` {encoded.schema[c].dataType.simpleString()}" for c in keep) + ", n_tokens bigint, ids_sha256 string, decoded_sha256 string"
    return encoded.select(*keep, "ids").mapInArrow(run, schema)
