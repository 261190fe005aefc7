"""Order-preserving key encodings as Column expressions on binary, so that byte order is value order.

A segment is 00 for null, else 7F and the value's bytes; empty text or binary is 7F 40. The builders take a Column and
return a binary Column. Only floats need Python: Spark SQL has no cast from a float to its bits.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

#: Prefixes of null, empty and data segments; the marker of a chunk with more behind it.
NULL, EMPTY, DATA, MORE = "00", "40", "7F", "09"
SIGN64 = -(1 << 63)


def _padded(value: Column, digits: int) -> Column:
    return F.lpad(F.hex(value), digits, "0")


def _segment(value: Column, body: Column) -> Column:
    """body: hex digits of a value that isn't null."""
    return F.unhex(F.when(value.isNull(), F.lit(NULL)).otherwise(F.concat(F.lit(DATA), body)))


def bit(value: Column) -> Column:
    return _segment(value, F.when(value, F.lit("FF")).otherwise(F.lit("00")))


def unsigned(value: Column, size: int) -> Column:
    """Unsigned integers of 1, 2 or 4 bytes, big-endian as they are."""
    return _segment(value, _padded(value.cast("long"), 2 * size))


def signed(value: Column, size: int) -> Column:
    """Signed integers of 2, 4 or 8 bytes, big-endian with the sign bit flipped."""
    wide = value.cast("long")
    flipped = wide.bitwiseXOR(F.lit(SIGN64)) if size == 8 else wide + (1 << (8 * size - 1))
    return _segment(value, _padded(flipped, 2 * size))


def raw_datetime(bits: Column) -> Column:
    """A date-time column's raw 64 bits: negative ones inverted, others with the sign bit flipped."""
    wide = bits.cast("long")
    return _segment(bits, _padded(F.when(wide < 0, F.bitwise_not(wide)).otherwise(wide.bitwiseXOR(F.lit(SIGN64))), 16))


@F.pandas_udf(LongType())
def double_bits(value: pd.Series) -> pd.Series:
    """The bits of doubles as longs; null stays null."""
    bits = pd.Series(value.to_numpy(np.float64, na_value=np.nan).view(np.int64)).astype("Int64")
    return bits.mask(value.isna().to_numpy())


@F.pandas_udf(LongType())
def float_bits(value: pd.Series) -> pd.Series:
    """The bits of floats as non-negative longs; null stays null."""
    bits = pd.Series(value.to_numpy(np.float32, na_value=np.nan).view(np.uint32).astype(np.int64)).astype("Int64")
    return bits.mask(value.isna().to_numpy())


def double(value: Column) -> Column:
    return raw_datetime(double_bits(value.cast("double")))


def single(value: Column) -> Column:
    bits = float_bits(value.cast("float"))
    return _segment(value, _padded(F.when(bits >= 1 << 31, F.bitwise_not(bits).bitwiseAND(F.lit((1 << 32) - 1))).otherwise(bits + (1 << 31)), 8))


def guid(value: Column) -> Column:
    """A GUID's text: node, clock, then the time's high, middle and low groups, in the order of the stored bytes."""
    plain = F.upper(F.regexp_replace(value, "[{}-]", ""))

    def little(first: int, size: int) -> Column:
        return F.concat(*[F.substring(plain, first + 2 * i, 2) for i in reversed(range(size))])

    return _segment(value, F.concat(F.substring(plain, 21, 12), F.substring(plain, 17, 4), little(13, 2), little(9, 2), little(1, 4)))


def binary_fixed(value: Column, most: int = 255) -> Column:
    digits = F.substring(F.hex(value), 1, 2 * most)
    return _segment(value, F.when(F.octet_length(value) == 0, F.lit(EMPTY)).otherwise(digits))


def binary_chunks(value: Column, most: int = 255) -> Column:
    """Variable binary: chunks of 8 bytes, each with 09 behind it if more follows, else the number of bytes used.

    An encoding that doesn't fit in `most` bytes (the prefix counts) is cut there, and no chunk of it is marked last.
    """
    digits, n = F.hex(value), F.octet_length(value)
    chunks = F.ceil(n / 8).cast("int")
    whole = chunks * 9 + 1 <= most

    def chunk(i: Column) -> Column:
        used = F.least(F.lit(8), n - (i - 1) * 8)
        last = (i == chunks) & (whole | (used < 8))
        return F.concat(F.rpad(F.substring(digits, (i - 1) * 16 + 1, F.lit(16)), 16, "0"), F.when(last, _padded(used.cast("long"), 2)).otherwise(F.lit(MORE)))

    body = F.substring(F.array_join(F.transform(F.sequence(F.lit(1), F.greatest(chunks, F.lit(1))), chunk), ""), 1, 2 * (most - 1))
    return _segment(value, F.when(n == 0, F.lit(EMPTY)).otherwise(body))


def text(value: Column, most: int = 255) -> Column:
    """ASCII and Western text: upper case as UTF-8 and 00."""
    kept = F.when(F.length(value) + 1 > most, F.substring(value, 1, most)).otherwise(value)
    return _segment(value, F.when(F.length(value) == 0, F.lit(EMPTY)).otherwise(F.concat(F.hex(F.encode(F.upper(kept), "UTF-8")), F.lit("00"))))


def composite(*segments: Column, most: int = 255) -> Column:
    """The segments of an index's columns in order, cut at the index's key size."""
    return F.substring(F.concat(*segments), 1, most)
