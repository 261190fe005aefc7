"""Cutting texts where a byte-level BPE pattern always cuts, so that encodings of the pieces can be kept.

A token of such patterns holds white space only at its beginning, or nothing else (some also line breaks at their end);
so there is a cut before every space that follows a character that isn't white space, and with patterns without such
line breaks before every line break too. Pieces repeat far more often than texts do.
"""

from __future__ import annotations

import string
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex

#: A worker keeps pieces of about so many bytes in each of two generations, and no piece longer than so many characters.
KEPT_BYTES, KEPT_CHARS = 128 << 20, 200
#: bytes of texts whose pieces are looked up together
SLICE = 16 << 20
_ENTRY = 200  # bytes of a kept piece beside its characters and ids
#: Marks before which every pattern cuts if a letter or digit of ASCII, or a letter from U+00C0 to U+00FF, stands before them.
_IS_MARK = bytes(chr(b) in string.punctuation and chr(b) != "'" for b in range(256))
_IS_ALNUM = bytes(b < 128 and chr(b).isalnum() for b in range(256))
_STEP = 1 << 18  # pieces whose ids are put in place together


def byte_names() -> dict[int, str]:
    """The character that stands for each byte in byte-level BPE: itself if printable in Latin-1, else the next from U+0100 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    return {b: chr(b) if b in plain else chr(next(others)) for b in range(256)}


class _Kept(dict):
    """A piece, with the character before which it was cut -> its ids; None if it ends in white space."""

    def __init__(self, encode: Callable[[str], bytes]):
        self.encode, self.old, self.size = encode, {}, 0

    def __missing__(self, piece: str) -> bytes | None:
        if piece in self.old:
            found = self.old[piece]
        elif not piece or piece[-1].isspace():
            found = None if piece else b""
        else:
            found = self.encode(piece)
        self.keep(piece, found)
        return found

    def keep(self, piece: str, found: bytes | None) -> None:
        if len(piece) <= KEPT_CHARS:
            self.size += len(piece) + _ENTRY
            if self.size > KEPT_BYTES:
                self.old, self.size = dict(self), 0
                self.clear()
            self[piece] = found

    def find(self, pieces: list[str], together: Callable[[list[str]], dict[str, bytes]]) -> list[bytes | None]:
        """As a lookup of each piece; `together` may know the ids of some of those that are new."""
        found = list(map(self.get, pieces))  # None where a piece is new or old, or ends in white space
        missing = [i for i, f in enumerate(found) if f is None]
        again = [pieces[i] for i in missing]
        old = list(map(self.old.get, again))
        new = together([p for p, f in zip(again, old) if f is None])
        kept = {p: f for p, f in zip(again, old) if f is not None} | new
        for i, piece in zip(missing, again):
            found[i] = f if (f := kept.get(piece)) is not None else self[piece]
        self.keep_all(kept)
        return found

    def keep_all(self, found: dict[str, bytes]) -> None:
        if max(map(len, found), default=0) > KEPT_CHARS:
            found = {p: f for p, f in found.items() if len(p) <= KEPT_CHARS}
        self.size += sum(map(len, found)) + _ENTRY * len(found)
        if self.size > KEPT_BYTES:
            self.old, self.size = dict(self), 0
            self.clear()
        self.update(found)


def _strings(pieces: pa.StringArray) -> list[str]:
    """The array's strings, cut out of its decoded buffer."""
    ends = np.frombuffer(pieces.buffers()[1], np.int32)[pieces.offset : pieces.offset + len(pieces) + 1]
    data = np.frombuffer(pieces.buffers()[2], np.uint8)[ends[0] : ends[-1]]
    characters = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    text, ends = data.tobytes().decode(), characters.take(ends - ends[0]).tolist()
    return [text[b:e] for b, e in zip(ends, ends[1:])]


class ChunkEncoder:
    """Encodes whole texts piece by piece; `encode` gives a string's ids as bytes, `kind` is the ids' NumPy type.

    cuts: the characters before which the pattern cuts, of " " and "\\n"; without any, texts are encoded whole. Texts that
    hold a string in `whole` are encoded whole too. `together` gives the ids of those of many pieces that it can take.
    """

    def __init__(self, encode: Callable[[str], bytes], kind: str, cuts: str = " ", whole: tuple[str, ...] = (), together: Callable[[list[str]], dict[str, bytes]] = lambda _: {}):
        self.encode, self.kind, self.cuts, self.whole, self.kept, self.together = encode, np.dtype(kind), cuts, whole, _Kept(encode), together
        self.cut = regex.compile(rf"(?<=\S)(?=[{cuts}])") if cuts else None

    def __call__(self, text: str) -> bytes:
        return next(self.column(pa.array([text])))

    def rest(self) -> None:
        """To be called when a task ends: its worker lives on beside other work, so the pieces and Arrow's unused memory are given back."""
        self.kept = _Kept(self.encode)
        pa.default_memory_pool().release_unused()

    def column(self, texts: pa.Array) -> Iterator[bytes]:
        """Each text's ids; a null has none. Texts are taken in groups of SLICE bytes, a longer one alone."""
        texts = pc.fill_null(texts, "").cast(pa.large_string())
        if not self.cuts:
            yield from (self.encode(t.as_py()) for t in texts)
            return
        ends = np.frombuffer(texts.buffers()[1], "<i8")[texts.offset : texts.offset + len(texts) + 1] if len(texts) else []
        at = 0
        while at < len(texts):
            to = max(at + 1, int(np.searchsorted(ends, ends[at] + SLICE, side="right")) - 1)
            yield from self._group(texts.slice(at, to - at), ends[at : to + 1])
            at = to

    def _group(self, texts: pa.Array, ends: np.ndarray) -> Iterator[bytes]:
        """As column(), for texts that end at `ends` of their buffer: each different piece is looked up once."""
        if ends[0] == ends[-1]:
            yield from [b""] * len(texts)
            return
        data, rows = np.frombuffer(texts.buffers()[2], np.uint8)[ends[0] : ends[-1]], ends - ends[0]
        cut = np.zeros(len(data) + 1, bool)
        for c in self.cuts:
            cut[:-1] |= data == ord(c)
        raw = data.tobytes()
        mark, alnum = np.frombuffer(raw.translate(_IS_MARK), bool), np.frombuffer(raw.translate(_IS_ALNUM), bool)
        cut[1:-1] |= mark[1:] & alnum[:-1]
        cut[2:-1] |= mark[2:] & (data[:-2] == 0xC3) & (data[1:-1] != 0x97) & (data[1:-1] != 0xB7)  # but for two signs, letters
        cut[rows] = True
        cuts = np.flatnonzero(cut).astype(np.int32)
        pieces = pa.StringArray.from_buffers(len(cuts) - 1, pa.py_buffer(cuts), pa.py_buffer(data)).dictionary_encode()
        which, found = pieces.indices.to_numpy(), self.kept.find(_strings(pieces.dictionary), self.together)
        unsure = np.zeros(len(found), bool)
        for i in [i for i, f in enumerate(found) if f is None]:
            unsure[i], found[i] = True, b""
        size = np.fromiter(map(len, found), np.int32, len(found)) // self.kind.itemsize
        ids, start = np.frombuffer(b"".join(found), self.kind), np.cumsum(size) - size
        after = np.concatenate([[0], np.cumsum(size.take(which))])
        out = np.empty(after[-1], self.kind)
        for b in range(0, len(which), _STEP):
            part, to = which[b : b + _STEP], after[b : b + _STEP + 1]
            out[to[0] : to[-1]] = ids.take(np.repeat(start.take(part) - to[:-1], np.diff(to)) + np.arange(to[0], to[-1]))
        # A piece that ends in white space: what follows is no sure cut, and its text is cut by the pattern's rule.
        first = np.searchsorted(cuts, rows)
        doubts = np.concatenate([[0], np.cumsum(unsure.take(which))])[first]
        apart, whole = (doubts[1:] > doubts[:-1]).tolist(), np.zeros(len(texts), bool)
        for w in self.whole:
            whole |= pc.match_substring(texts, w).to_numpy(zero_copy_only=False)
        at = after[first].tolist()
        for i, (b, e) in enumerate(zip(at, at[1:])):
            if whole[i]:
                yield self.encode(texts[i].as_py())
            elif apart[i]:
                yield b"".join(map(self.encode, self.cut.split(texts[i].as_py())))
            else:
                yield out[b:e].tobytes()
