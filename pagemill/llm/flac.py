"""Media columns in FLAC: bytes as 8-bit mono samples, coded and decoded for many frames at once with NumPy.

A byte b is the sample b - 128. Every frame holds 576 samples under a constant, a fixed (orders 0 and 1) or a quantised
linear predictor (order 2), with Rice-coded residuals, or verbatim where that is shorter. The seek table has a point for
every frame, so that all frames of many streams decode together, each in its own lane. The decoder also takes fixed
orders up to 4, linear predictors up to order 32 and partitioned residuals; it checks both checksums of every frame.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagemill.llm.shared import table_path

FRAME, RATE = 576, 8000
#: Bytes of payload (a multiple of a frame) that are coded together and that are decoded together; longer ones are cut.
PIECE, DECODED = 1820 * FRAME, 3640 * FRAME
#: Fixed values of the format: the coefficients of the fixed predictors.
FIXED = ((), (1,), (2, -1), (3, -3, 1), (4, -6, 4, -1))
_PRECISION, _SHIFT = 10, 8
_POINT = np.dtype([("sample", ">u8"), ("offset", ">u8"), ("n", ">u2")])  # of the seek table


def _crc_table(poly: int, bits: int, width: int) -> np.ndarray:
    """What `width` message bits at the top of a register of `bits` bits leave in it."""
    r = np.arange(1 << width, dtype=np.uint32) << np.uint32(bits - width)
    for _ in range(width):
        r = np.where(r >> np.uint32(bits - 1) & 1, r << np.uint32(1) ^ np.uint32(poly), r << np.uint32(1)) & np.uint32((1 << bits) - 1)
    return r


_CRC8 = _crc_table(0x07, 8, 8).astype(np.uint8)
_CRC16 = _crc_table(0x8005, 16, 16).astype(np.uint16)  # for two bytes at a time


def _crc16(data: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """CRC-16 of data[begin:begin + size] for each lane; lanes end together, since leading zeros leave the register 0."""
    longest = int(size.max(initial=0) + 1) // 2 * 2
    end, crc = begin + size, np.zeros(len(begin), np.uint16)
    padded = np.concatenate([np.zeros(longest, np.uint8), data])
    for k in range(longest, 0, -2):
        at = end + (longest - k)
        word = padded[at].astype(np.uint16) * (k <= size) << np.uint16(8) | padded[at + 1] * (k - 1 <= size)
        crc = _CRC16[crc ^ word]
    return crc


def _number(n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Frame numbers in the format's extended UTF-8: (bytes up to 7, lengths)."""
    size = np.select([n < 1 << 7, n < 1 << 11, n < 1 << 16, n < 1 << 21, n < 1 << 26, n < 1 << 31], [1, 2, 3, 4, 5, 6], 7)
    out = np.zeros((len(n), 7), np.uint8)
    for s in np.unique(size).tolist():
        rows = np.flatnonzero(size == s)
        if s == 1:
            out[rows, 0] = n[rows]
            continue
        for j in range(s):
            bits = n[rows] >> (6 * (s - 1 - j))
            out[rows, j] = bits | (0xFF << (8 - s) & 0xFF) if j == 0 else bits & 63 | 128
    return out, size


def _folded(r: np.ndarray) -> np.ndarray:
    return (r << 1) ^ (r >> 15)


def _rice(u: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(parameter, bits) of each row of folded residuals under its best Rice parameter."""
    costs = np.stack([(u >> k).sum(1, dtype=np.int64) + u.shape[1] * (k + 1) for k in range(9)])
    k = costs.argmin(0)
    return k, np.take_along_axis(costs, k[None], 0)[0]


def _predictors(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first, second) quantised coefficients of the order-2 predictor of each row, by least squares on its products."""
    y = x.astype(np.float32)
    r0, r1, r2 = (y[:, 2:] ** 2).sum(1), (y[:, 2:] * y[:, 1:-1]).sum(1), (y[:, 2:] * y[:, :-2]).sum(1)
    det = np.maximum(r0 * r0 - r1 * r1, 1e-3 * r0 * r0 + 1)
    a1, a2 = r1 * (r0 - r2) / det, (r0 * r2 - r1 * r1) / det
    most = (1 << (_PRECISION - 1)) - 1
    quantised = [np.clip(np.rint(a * (1 << _SHIFT)), -most, most).astype(np.int32) for a in (a1, a2)]
    return quantised[0], quantised[1]


def _frames(x: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(the bytes of all frames, bytes of each) of rows of samples with their frame numbers."""
    n = len(x)
    # The residuals of each predictor, then the cheapest per frame.
    one = np.zeros_like(x)
    one[:, 1:] = np.diff(x, axis=1)
    c1, c2 = _predictors(x)
    two = np.zeros_like(x)
    guess = (c1[:, None] * x[:, 1:-1] + c2[:, None] * x[:, :-2]) >> _SHIFT
    two[:, 2:] = x[:, 2:] - np.clip(guess, -16000, 16000)
    folded = [_folded(x), _folded(one), _folded(two)]
    ricer = [_rice(u) for u in folded]
    head = (8 + 10, 8 + 10 + 8, 8 + 10 + 16 + 9 + 2 * _PRECISION)
    bits = np.stack([cost + extra for (_, cost), extra in zip(ricer, head, strict=True)] + [np.full(n, 8 + 8 * FRAME)])
    kind = bits.argmin(0)
    kind[(x == x[:, :1]).all(1)] = 4
    order = np.where(kind < 3, kind, 0)
    k = np.choose(np.minimum(kind, 2), [r[0] for r in ricer])
    coded = kind < 3
    u = np.where((kind == 0)[:, None], folded[0], np.where((kind == 1)[:, None], folded[1], folded[2])).astype(np.int32)
    # Every field as (value, width); a Rice code's zeros are the part of its width above k + 1 bits.
    kk = k[:, None]
    code, width = 1 << kk | u & ((1 << kk) - 1), (u >> kk) + 1 + kk
    raw = x & 0xFF
    warm = np.arange(FRAME)[None] < order[:, None]
    code, width = np.where(warm, 0, code), np.where(warm, 0, width)
    verbatim = kind == 3
    code[verbatim], width[verbatim] = raw[verbatim], 8
    code[kind == 4], width[kind == 4] = 0, 0
    code[kind == 4, 0], width[kind == 4, 0] = raw[kind == 4, 0], 8
    tag = np.choose(kind, [8, 9, 32 + 1, 1, 0]) << 1
    lpc = kind == 2
    most = (1 << _PRECISION) - 1
    wide = [(tag, 8), (raw[:, 0], 8 * (coded & (order > 0))), (raw[:, 1], 8 * lpc), (np.full(n, _PRECISION - 1), 4 * lpc), (np.full(n, _SHIFT), 5 * lpc)]
    wide += [(c1 & most, _PRECISION * lpc), (c2 & most, _PRECISION * lpc), (np.zeros(n, np.int64), 6 * coded), (k, 4 * coded)]
    fields = np.stack([np.broadcast_to(v, n) for v, _ in wide], 1).astype(np.int32)
    widths = np.stack([np.broadcast_to(w, n) for _, w in wide], 1).astype(np.int32)
    fields = np.where(widths > 0, fields, 0)
    code, width = np.concatenate([fields, code], 1), np.concatenate([widths, width], 1)
    digits, digit_n = _number(number)
    head_n = 4 + digit_n + 1
    total = head_n + (width.sum(1, dtype=np.int64) + 7) // 8 + 2
    begin = np.concatenate([[0], np.cumsum(total)[:-1]])
    end_bit = np.cumsum(width, 1, dtype=np.int64) + ((begin + head_n) * 8)[:, None]
    # A code of up to 10 significant bits that ends at a bit lies in the three bytes up to it.
    live = (code > 0) & (width > 0)
    value, end = code[live].astype(np.int64), end_bit[live]
    last = (end - 1) >> 3
    value <<= (-end) & 7
    length = int(total.sum())
    out = sum(np.bincount(np.maximum(last - j, 0), (value >> (8 * j)) & 255, length) for j in range(3)).astype(np.uint8)
    fixed = np.array([0xFF, 0xF8, 0x20, 0x02], np.uint8)
    top = np.concatenate([np.broadcast_to(fixed, (n, 4)), digits], 1)
    crc = np.zeros(n, np.uint8)
    for j in range(11):
        inside = j < head_n - 1
        out[(begin + j)[inside]] = top[inside, j]
        crc = np.where(inside, _CRC8[crc ^ top[:, j]], crc)
    out[begin + head_n - 1] = crc
    crc = _crc16(out, begin, total - 2)
    out[begin + total - 2], out[begin + total - 1] = crc >> 8, crc & 255
    return out, total


def encode(payloads: list[bytes]) -> list[bytes]:
    """A FLAC stream for each payload, whose length must be a positive multiple of 576.

    Frames are coded in runs of PIECE bytes, whatever payloads they belong to, so working memory doesn't grow with them.
    """
    sizes = np.array([len(p) for p in payloads], np.int64)
    if not len(sizes):
        return []
    if (sizes % FRAME).any() or not sizes.all():
        raise ValueError(f"payloads must be positive multiples of {FRAME} bytes")
    frames = sizes // FRAME
    first = np.concatenate([[0], np.cumsum(frames)])
    digests = [hashlib.md5() for _ in payloads]
    bodies: list[list[bytes]] = [[] for _ in payloads]
    totals: list[list[np.ndarray]] = [[] for _ in payloads]
    for at in range(0, int(first[-1]), PIECE // FRAME):
        stop = min(at + PIECE // FRAME, int(first[-1]))
        some = range(int(np.searchsorted(first, at, "right")) - 1, int(np.searchsorted(first, stop, "left")))
        cuts = [(i, max(at, int(first[i])), min(stop, int(first[i + 1]))) for i in some]
        raw = b"".join(payloads[i][(a - int(first[i])) * FRAME : (b - int(first[i])) * FRAME] for i, a, b in cuts)
        x = (np.frombuffer(raw, np.uint8).astype(np.int16) - 128).reshape(-1, FRAME)
        out, total = _frames(x, np.concatenate([np.arange(a, b) - first[i] for i, a, b in cuts]))
        ends = np.concatenate([[0], np.cumsum(total)])
        for i, a, b in cuts:
            digests[i].update(x[a - at : b - at].astype(np.int8).tobytes())
            totals[i].append(total[a - at : b - at])
            bodies[i].append(out[ends[a - at] : ends[b - at]].tobytes())
    streams = []
    for payload, digest, body, t in zip(payloads, digests, bodies, map(np.concatenate, totals), strict=True):
        info = struct.pack(">HH", FRAME, FRAME) + int(t.min()).to_bytes(3, "big") + int(t.max()).to_bytes(3, "big")
        info += (RATE << 44 | 7 << 36 | len(payload)).to_bytes(8, "big") + digest.digest()
        points = np.zeros(len(t), _POINT)
        points["sample"], points["offset"], points["n"] = np.arange(len(t)) * FRAME, np.cumsum(t) - t, FRAME
        # A metadata block is at most 2**24 - 1 bytes long, so many points take several blocks.
        most = ((1 << 24) - 1) // _POINT.itemsize
        tables = [points[k : k + most].tobytes() for k in range(0, len(t), most)]
        heads = [bytes([3 | (128 if k == len(tables) - 1 else 0)]) + len(table).to_bytes(3, "big") + table for k, table in enumerate(tables)]
        streams.append(b"".join([b"fLaC", b"\0", len(info).to_bytes(3, "big"), info, *heads, *body]))
    return streams


def _layout(stream: bytes) -> tuple[bytes, np.ndarray, np.ndarray, int]:
    """(stream info, first samples, byte offsets of the frames, samples) of a stream with a seek point per frame."""
    if stream[:4] != b"fLaC":
        raise ValueError("not a FLAC stream")
    at, info, tables, last = 4, b"", [], False
    while not last:
        last, kind, size = stream[at] > 127, stream[at] & 127, int.from_bytes(stream[at + 1 : at + 4], "big")
        body = stream[at + 4 : at + 4 + size]
        if kind == 0:
            info = body
        elif kind == 3:
            tables.append(np.frombuffer(body, _POINT))
        at += 4 + size
    packed = int.from_bytes(info[10:18], "big")
    points = np.concatenate(tables) if tables else None
    if points is None or (packed >> 36 & 31) != 7 or packed >> 41 & 7 or len(points) * FRAME != packed & (1 << 36) - 1:
        raise ValueError(f"only 8-bit mono streams with a seek point for every {FRAME} samples can be read")
    return info, points["sample"].astype(np.int64), points["offset"].astype(np.int64) + at, len(points) * FRAME


class _Bits:
    """A bit position in each lane over one byte array."""

    def __init__(self, data: np.ndarray, at: np.ndarray):
        padded = np.concatenate([data, np.zeros(16, np.uint8)])
        self.words = np.zeros(len(data) + 8, np.uint64)
        for j in range(8):
            self.words |= padded[j : j + len(self.words)].astype(np.uint64) << np.uint64(56 - 8 * j)
        self.at, self.last = at * 8, len(self.words) - 1

    def window(self) -> np.ndarray:
        """At least 57 bits from each position, at the top of a word."""
        return self.words[np.minimum(self.at >> 3, self.last)] << (self.at & 7).astype(np.uint64)

    def take(self, n: np.ndarray | int) -> np.ndarray:
        """The next n (at most 32) bits of each lane."""
        n = np.broadcast_to(n, self.at.shape)
        value = self.window() >> np.uint64(1) >> (63 - n).astype(np.uint64)
        self.at = self.at + n
        return value.astype(np.int64)

    def rice(self, k: np.ndarray, lanes: np.ndarray) -> np.ndarray:
        """The next Rice code of the lanes that are marked (0 elsewhere)."""
        w = self.window()
        zeros = 53 - np.frexp((w >> np.uint64(11)).astype(np.float64))[1]
        if (far := (zeros == 53) & lanes).any():  # so many zeros that the window holds nothing else
            while far.any():
                self.at = self.at + 53 * far
                more = 53 - np.frexp((self.window() >> np.uint64(11)).astype(np.float64))[1]
                zeros = zeros + more * far
                far &= more == 53
            self.at = self.at + (zeros % 53 + 1) * (lanes & (zeros >= 53)) + (zeros + 1) * (lanes & (zeros < 53))
            low = self.take(np.where(lanes, k, 0))
            return np.where(lanes, zeros << k | low, 0)
        if ((used := zeros + 1 + k) > 57).any():
            self.at = self.at + (zeros + 1) * lanes
            low = self.take(np.where(lanes, k, 0))
            return np.where(lanes, zeros << k | low, 0)
        low = (w << (zeros + 1).astype(np.uint64) >> np.uint64(1) >> (63 - k).astype(np.uint64)).astype(np.int64)
        self.at = self.at + used * lanes
        return (zeros << k | low) * lanes


def _signed(v: np.ndarray, bits: np.ndarray | int) -> np.ndarray:
    return v - ((v >> (np.maximum(bits, 1) - 1) & 1) << bits)


def _decode_frames(data: np.ndarray, begin: np.ndarray, end: np.ndarray, sample: np.ndarray) -> np.ndarray:
    """The bytes (frames x 576) of the frames at data[begin:end], which must start at the given samples."""
    # Headers
    lead = data[begin + 4]
    digit_n = np.select([lead < 0x80, lead < 0xE0, lead < 0xF0, lead < 0xF8, lead < 0xFC, lead < 0xFE], [1, 2, 3, 4, 5, 6], 7)
    head_n = 5 + digit_n
    crc, digits = np.zeros(len(begin), np.uint8), np.zeros((len(begin), 7), np.uint8)
    for j in range(int(head_n.max()) - 1):
        inside = j < head_n - 1
        byte = np.where(inside, data[np.minimum(begin + j, len(data) - 1)], 0).astype(np.uint8)
        crc = np.where(inside, _CRC8[crc ^ byte], crc)
        if j >= 4:
            digits[:, j - 4] = byte
    numbers, lengths = _number(sample // FRAME)
    good = (data[begin] == 0xFF) & (data[begin + 1] == 0xF8) & (data[begin + 2] == 0x20) & (data[begin + 3] == 0x02)
    good &= (lengths == digit_n) & (numbers == digits).all(1) & (crc == data[begin + head_n - 1])
    good &= _crc16(data, begin, end - begin - 2) == (data[end - 2].astype(np.uint16) << np.uint16(8) | data[end - 1])
    if not good.all():
        raise ValueError(f"{int((~good).sum())} damaged frames")
    bits = _Bits(data, begin + head_n)
    tag = bits.take(8)
    kind = tag >> 1
    constant, verbatim, fixed, lpc = kind == 0, kind == 1, (kind >= 8) & (kind <= 12), kind >= 32
    if (tag & 0x81).any() or not (constant | verbatim | fixed | lpc).all():
        raise ValueError("a subframe kind that isn't supported")
    order = np.where(fixed, kind - 8, np.where(lpc, kind - 31, 0))
    coded, n = fixed | lpc, len(kind)
    x = np.zeros((FRAME, n), np.int64)
    value = _signed(bits.take(8 * constant), 8 * constant)
    for j in range(int(order.max())):
        own = 8 * (j < order)
        x[j] = _signed(bits.take(own), own)
    coefficients, shift = np.zeros((max(1, int(order.max())), n), np.int64), np.zeros(n, np.int64)
    for o, c in enumerate(FIXED[: len(coefficients) + 1]):
        for j, v in enumerate(c):
            coefficients[j, fixed & (order == o)] = v
    if lpc.any():
        precision = bits.take(4 * lpc) + 1
        shift = bits.take(5 * lpc)
        for j in range(len(coefficients)):
            own = precision * (lpc & (j < order))
            read = _signed(bits.take(own), own)
            coefficients[j] = np.where(own > 0, read, coefficients[j])
    method = bits.take(2 * coded)
    parts = bits.take(4 * coded)
    if (method > 1).any():
        raise ValueError("a residual method that isn't supported")
    each, k = FRAME >> parts, np.zeros(n, np.int64)
    split = bool(parts.any())
    raw_lanes, plain = bool(verbatim.any()), not constant.any()
    width = 4 + method
    k = bits.take(width * coded)
    if (k == (1 << width) - 1)[coded].any():
        raise ValueError("an escaped residual partition isn't supported")
    all_coded, least, most = bool(coded.all()), int(order.min()), int(order.max())
    for i in range(FRAME):
        lanes = coded if i >= most else coded & (i >= order)
        if split and i:
            new = coded & (i % each == 0)
            if new.any():
                got = bits.take(width * new)
                if (got == (1 << width) - 1)[new].any():
                    raise ValueError("an escaped residual partition isn't supported")
                k = np.where(new, got, k)
        u = bits.rice(k, lanes)
        s = (u >> 1) ^ -(u & 1)
        if most:
            guess = coefficients[0] * x[i - 1] if i else 0
            for j in range(1, min(most, i)):
                guess = guess + coefficients[j] * x[i - 1 - j]
            s = s + (guess >> shift)
        if i < most:
            s = np.where(lanes, s, x[i])
        if raw_lanes:
            own = 8 * verbatim
            s = np.where(verbatim, _signed(bits.take(own), own), s)
        x[i] = s
    x = np.where(constant[None], value[None], x) if not plain else x
    if ((x < -128) | (x > 127)).any():
        raise ValueError("a sample is out of range")
    return (x.T + 128).astype(np.uint8)


def decode_blocks(streams: list[bytes]) -> Iterator[tuple[int, int, bytes]]:
    """(stream's number, first sample, payload bytes) of all streams in order, in runs of frames of DECODED bytes at most.

    A damaged header, frame or sample is an error, and so are samples that don't match their stream's digest; the
    latter is known only with a stream's last block.
    """
    layouts = [_layout(s) for s in streams]
    run: list[tuple[int, int, int]] = []  # (stream, first frame, frame after the last)
    held, most = 0, DECODED // FRAME
    digest = hashlib.md5()

    def flush() -> Iterator[tuple[int, int, bytes]]:
        nonlocal digest
        parts, begin, end, sample, base = [], [], [], [], 0
        for i, a, b in run:
            _, samples, offsets, _ = layouts[i]
            low, high = int(offsets[a]), int(offsets[b]) if b < len(offsets) else len(streams[i])
            parts.append(streams[i][low:high])
            begin.append(offsets[a:b] - low + base)
            end.append(np.append(offsets[a + 1 : b], high) - low + base)
            sample.append(samples[a:b])
            base += high - low
        payload = _decode_frames(np.frombuffer(b"".join(parts), np.uint8), *map(np.concatenate, (begin, end, sample)))
        at = 0
        for i, a, b in run:
            part = payload[at : at + b - a]
            at += b - a
            digest.update((part ^ 0x80).tobytes())
            if b == len(layouts[i][1]):
                if digest.digest() != layouts[i][0][18:34]:
                    raise ValueError("the samples don't match the stream's digest")
                digest = hashlib.md5()
            yield i, a * FRAME, part.tobytes()

    for i, (_, samples, _, _) in enumerate(layouts):
        a = 0
        while a < len(samples):
            b = min(len(samples), a + most - held)
            run.append((i, a, b))
            held += b - a
            a = b
            if held == most:
                yield from flush()
                run, held = [], 0
    if run:
        yield from flush()


def decode(streams: list[bytes]) -> list[bytes]:
    """The payload of each stream; damage is an error."""
    parts: list[list[bytes]] = [[] for _ in streams]
    for i, _, part in decode_blocks(streams):
        parts[i].append(part)
    return [b"".join(p) for p in parts]


def pad(raw: bytes) -> bytes:
    """raw and bytes 255 up to a positive multiple of 576."""
    return raw + b"\xff" * (-len(raw) % FRAME if raw else FRAME)


def _runs(sizes: list[int], most: int) -> Iterator[slice]:
    at, held = 0, 0
    for i, s in enumerate(sizes):
        if i > at and held + s > most:
            yield slice(at, i)
            at, held = i, 0
        held += s
    if at < len(sizes):
        yield slice(at, len(sizes))


def with_media(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns in keep, n_bytes (of the text) and media, the FLAC stream of the padded text (null: empty).

    Repeated rows each come back, an empty table gives an empty table, other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw = b.column(b.num_columns - 1)
            sizes = [len(v) if (v := x.as_buffer()) is not None else 0 for x in raw]
            for s in _runs(sizes, PIECE):
                part = b.slice(s.start, s.stop - s.start)
                media = encode([pad(x.as_py() or b"") for x in part.column(part.num_columns - 1)])
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(sizes[s], pa.int64()), pa.array(media, pa.binary())], [*keep, "n_bytes", "media"])

    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep) + ", n_bytes bigint, media binary"
    return docs.select(*keep, F.col(text).cast("binary").alias("_raw")).mapInArrow(run, schema)


class Feature:
    """Samples, mean, root mean square, peak and sign changes of a payload's samples, from exact sums over its blocks."""

    def __init__(self):
        self.n = self.total = self.squares = self.peak = self.changes = 0
        self.last: bool | None = None

    def update(self, block: bytes) -> None:
        x = np.frombuffer(block, np.uint8).astype(np.int32) - 128
        if not len(x):
            return
        below = x < 0
        self.changes += int((below[1:] != below[:-1]).sum()) + (self.last is not None and bool(below[0]) != self.last)
        self.n, self.total, self.squares = self.n + len(x), self.total + int(x.sum(dtype=np.int64)), self.squares + int((x * x).sum(dtype=np.int64))
        self.peak, self.last = max(self.peak, int(np.abs(x).max())), bool(below[-1])

    def text(self) -> str:
        return f"n={self.n};mean={self.total / self.n:.6f};rms={(self.squares / self.n) ** 0.5:.6f};peak={self.peak};changes={self.changes}"


def pcm_blocks(media: DataFrame, keep: tuple[str, ...] = ("doc_id",), block: int = 256 * FRAME) -> DataFrame:
    """The columns in keep, sample_offset, n_samples and pcm: each stream's samples (unsigned bytes) in blocks of `block`.

    A block can be sought by its offset; the last may be shorter, and a stream's blocks follow each other. Rows without
    media give no blocks, repeated rows each give theirs; an empty table gives none.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            column = b.column(b.num_columns - 1)
            for s in _runs([len(x.as_buffer()) for x in column], DECODED):
                part = b.slice(s.start, s.stop - s.start)
                held: list[tuple[int, int, bytes]] = []
                size = 0

                def flush() -> pa.RecordBatch:
                    rows = pa.array([i for i, _, _ in held], pa.int64())  # noqa: B023
                    data = [pa.array([at for _, at, _ in held], pa.int64()), pa.array([len(p) for _, _, p in held], pa.int64()), pa.array([p for _, _, p in held], pa.binary())]  # noqa: B023
                    return pa.RecordBatch.from_arrays([*(c.take(rows) for c in part.columns[:-1]), *data], [*keep, "sample_offset", "n_samples", "pcm"])  # noqa: B023

                for i, first, payload in _even(decode_blocks(part.column(part.num_columns - 1).to_pylist()), block):
                    held.append((i, first, payload))
                    size += len(payload)
                    if size >= DECODED:
                        yield flush()
                        held, size = [], 0
                if held:
                    yield flush()

    schema = ", ".join(f"`{c}` {media.schema[c].dataType.simpleString()}" for c in keep) + ", sample_offset bigint, n_samples bigint, pcm binary"
    return media.filter("media is not null").select(*keep, "media").mapInArrow(run, schema)


def _even(parts: Iterator[tuple[int, int, bytes]], block: int) -> Iterator[tuple[int, int, bytes]]:
    """Consecutive (stream, first sample, bytes) cut anew, so that all blocks of a stream but its last have `block` bytes."""
    own, start, held = -1, 0, b""
    for i, first, payload in parts:
        if i != own:
            if held:
                yield own, start, held
            own, start, held = i, first, b""
        held += payload
        while len(held) >= block:
            yield own, start, held[:block]
            start, held = start + block, held[block:]
    if held:
        yield own, start, held


def digests(media: DataFrame, keep: tuple[str, ...] = ("doc_id", "n_bytes")) -> DataFrame:
    """The columns in keep, and what is read back from media by its PCM blocks: sizes, digests and the feature of each row.

    A row's blocks follow each other in its partition, so sums run over them and no payload is held whole.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row, sha, tail, sums = None, hashlib.sha256(), b"", Feature()
        rows: list[pa.RecordBatch] = []
        out: list[tuple] = []

        def flush() -> pa.RecordBatch:
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.string())
            got = [pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)]
            columns = pa.Table.from_batches(rows).combine_chunks().to_batches()[0].columns
            return pa.RecordBatch.from_arrays([*columns, *got], [*keep, "media_bytes", "media_sha256", "payload_bytes", "payload_sha256", "tail_crc32", "feature"])

        for b in batches:
            offsets, pcm = b.column(b.num_columns - 2), b.column(b.num_columns - 1)
            for k, (offset, block) in enumerate(zip(offsets.to_pylist(), pcm, strict=True)):
                if not offset and row is not None:
                    rows.append(row)
                    out.append((sums.n, sha.hexdigest(), zlib.crc32(tail), sums.text()))
                    sha, tail, sums = hashlib.sha256(), b"", Feature()
                data = block.as_py()
                row = b.slice(k, 1).select(range(b.num_columns - 2)) if not offset else row
                sha.update(data)
                sums.update(data)
                tail = (tail + data[-32:])[-32:]
            if len(out) >= 1000:
                yield flush()
                rows, out = [], []
        if row is not None:
            rows.append(row)
            out.append((sums.n, sha.hexdigest(), zlib.crc32(tail), sums.text()))
            yield flush()

    stored = media.withColumns({"media_bytes": F.octet_length("media").cast("long"), "media_sha256": F.sha2("media", 256)})
    blocks = pcm_blocks(stored, (*keep, "media_bytes", "media_sha256")).drop("n_samples")
    schema = ", ".join(f"`{c}` {media.schema[c].dataType.simpleString()}" for c in keep)
    schema += ", media_bytes bigint, media_sha256 string, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, feature string"
    return blocks.mapInArrow(run, schema)


def stored(media: DataFrame) -> DataFrame:
    """media written as a table in the shared folder and read back.

    Rice codes of text leave repeats between streams, and seek tables are regular: zstd makes the table a tenth smaller
    than the default codec does.
    """
    path = table_path(media.sparkSession, "media")
    media.write.option("compression", "zstd").parquet(path)
    return media.sparkSession.read.schema(media.schema).parquet(path)
