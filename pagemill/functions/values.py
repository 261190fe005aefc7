"""Typed values from stored bits and bytes."""

from __future__ import annotations

import ipaddress
import struct

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, DoubleType, StringType

#: Code pages and their encodings; ticks of 100 ns from 1601 to 1970.
CODE_PAGES = {1200: "utf-16-le", 1252: "cp1252", 20127: "ascii"}
EPOCH_TICKS = 116_444_736_000_000_000


@F.pandas_udf(DoubleType())
def bits_to_double(bits: pd.Series) -> pd.Series:
    """A signed long's 64 bits as a double, as date-times are stored; null stays null."""
    known = bits.notna()
    out = pd.Series(bits.fillna(0).to_numpy("int64").view("float64"), index=bits.index, dtype="Float64")
    return out.where(known)


def oa_date(days: Column) -> Column:
    """Days since 1899-12-30 as a timestamp without zone, to the microsecond."""
    return F.expr("timestamp_ntz'1899-12-30 00:00:00'") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), (F.round(days * 86400 * 1e6) / 1e6).cast("decimal(20,6)"))


def windows_time(ticks: Column) -> Column:
    """Ticks of 100 ns since 1601 as a timestamp without zone; sub-microseconds are cut."""
    micros = F.floor((ticks - F.lit(EPOCH_TICKS)).cast("decimal(20,0)") / 10).cast("long")
    return F.timestamp_micros(micros).cast("timestamp_ntz")


def day_of_year(year: Column, day: Column) -> Column:
    """The date of a year's day number (1 is January 1st); numbers beyond the year run into the next."""
    return F.date_add(F.make_date(year, F.lit(1), F.lit(1)), day - 1)


def decode_text(page: int = 1252, errors: str = "backslashreplace"):
    """A pandas UDF from stored text to str: odd UTF-16 is padded, bad bytes are escaped, trailing NULs go."""
    encoding = CODE_PAGES[page]

    def one(raw: bytes) -> str:
        if encoding == "utf-16-le" and len(raw) % 2:
            raw += b"\0"
        return raw.decode(encoding, errors).rstrip("\0")

    @F.pandas_udf(StringType())
    def decode(values: pd.Series) -> pd.Series:
        return values.map(one, na_action="ignore")

    return decode


def utf16_text(raw: Column) -> Column:
    """Strict UTF-16LE text without trailing NULs."""
    return F.rtrim(F.decode(raw, "UTF-16LE"), F.lit("\0"))


@F.pandas_udf(StringType())
def ip_text(raw: pd.Series) -> pd.Series:
    """4 or 16 bytes as an address's text; other lengths give null."""
    return raw.map(lambda b: str(ipaddress.ip_address(bytes(b))) if len(b) in (4, 16) else None, na_action="ignore")


@F.pandas_udf(StringType())
def sid_text(raw: pd.Series) -> pd.Series:
    """A security identifier's bytes as S-revision-authority-subauthorities; short input gives null."""

    def one(b: bytes) -> str | None:
        if len(b) < 8 or len(b) < 8 + 4 * b[1]:
            return None
        return "-".join(["S", str(b[0]), str(int.from_bytes(b[2:8], "big")), *map(str, struct.unpack_from(f"<{b[1]}I", b, 8))])

    return raw.map(one, na_action="ignore")


def guid_text(raw: Column) -> Column:
    """16 stored bytes as a lower-case GUID."""
    h = F.lower(F.hex(raw))

    def little(first: int, size: int) -> Column:
        return F.concat(*[F.substring(h, first + 2 * i, 2) for i in reversed(range(size))])

    return F.when(F.octet_length(raw) == 16, F.concat_ws("-", little(1, 4), little(9, 2), little(13, 2), F.substring(h, 17, 4), F.substring(h, 21, 12)))


def little_endian(raw: Column, signed: bool = False) -> Column:
    """1, 2, 4 or 8 bytes as a long (8 bytes are always signed)."""
    h = F.hex(raw)
    digits = F.concat(*[F.substring(h, 2 * i + 1, 2) for i in reversed(range(8))])
    wide = F.conv(digits, 16, 10).cast("decimal(20,0)")
    size = F.octet_length(raw)
    top = F.pow(F.lit(2), size * 8).cast("decimal(20,0)")
    minus = wide - top
    negative = (size == 8) | F.lit(signed)
    return F.when(size > 0, F.when(negative & (wide >= (top / 2)), minus).otherwise(wide).cast("long"))


@F.pandas_udf(DoubleType())
def floating(raw: pd.Series) -> pd.Series:
    """4 or 8 bytes as an IEEE number, a double; other lengths give null."""
    return raw.map(lambda b: struct.unpack("<f" if len(b) == 4 else "<d", b)[0] if len(b) in (4, 8) else None, na_action="ignore").astype("Float64")


def not_sentinel(value: Column, *sentinels) -> Column:
    """value, or null where it is one of the sentinels."""
    return F.when(~value.isin(*sentinels), value)


def _seven_bit(raw: bytes) -> bytes:
    bits = int.from_bytes(raw[1:], "little")
    n = (8 * (len(raw) - 2) + (raw[0] & 7) + 1) // 7 if len(raw) > 1 else 0  # the last byte uses that many bits
    return bytes(bits >> (7 * i) & 127 for i in range(n))


def _xpress(raw: bytes) -> bytes:
    """Plain LZ77 of the XPRESS family: flag words of 32 bits, 13-bit distances, lengths in nibbles, bytes and words."""
    out, at, nibble_at, flags, left = bytearray(), 0, None, 0, 0
    while at < len(raw):
        if not left:
            flags, left, at = int.from_bytes(raw[at : at + 4], "little"), 32, at + 4
        left -= 1
        if not flags >> left & 1:
            if at < len(raw):
                out.append(raw[at])
            at += 1
            continue
        if at >= len(raw):
            break
        token, at = int.from_bytes(raw[at : at + 2], "little"), at + 2
        length, distance = token & 7, (token >> 3) + 1
        if length == 7:
            if nibble_at is None:
                length, nibble_at, at = raw[at] & 15, at, at + 1
            else:
                length, nibble_at = raw[nibble_at] >> 4, None
            if length == 15:
                length, at = raw[at], at + 1
                if length == 255:
                    length, at = int.from_bytes(raw[at : at + 2], "little"), at + 2
                    if not length:
                        length, at = int.from_bytes(raw[at : at + 4], "little"), at + 4
                    length -= 22
                length += 15
            length += 7
        for _ in range(length + 3):
            out.append(out[-distance])
    return bytes(out)


def decompress_value(raw: bytes) -> bytes:
    """A stored value by the scheme in its first byte's upper five bits: 1 seven-bit, 2 seven-bit wide, 3 XPRESS."""
    if not raw:
        return raw
    scheme = raw[0] >> 3
    if scheme == 1:
        return _seven_bit(raw)
    if scheme == 2:
        return b"".join(bytes((b, 0)) for b in _seven_bit(raw))
    if scheme == 3:
        return _xpress(raw[3:])
    if scheme in (5, 6):
        raise NotImplementedError(f"compression scheme {scheme}")
    return raw


@F.pandas_udf(BinaryType())
def decompress(raw: pd.Series) -> pd.Series:
    return raw.map(lambda b: decompress_value(bytes(b)), na_action="ignore")


def decompressed_size(raw: Column) -> Column:
    """The size a stored value decompresses to: from its length for the seven-bit schemes, stored for XPRESS."""
    first = F.conv(F.hex(F.substring(raw, 1, 1)), 16, 10).cast("int")
    scheme = F.shiftright(first, 3)
    narrow = F.floor((first.bitwiseAND(F.lit(7)) + 8 * F.octet_length(raw)) / 7)
    return F.when(scheme == 1, narrow).when(scheme == 2, narrow * 2).when(scheme == 3, little_endian(F.substring(raw, 2, 2))).cast("long")
