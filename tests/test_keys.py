"""Byte order of encoded keys is value order; chunks, conversions and choice of index."""

import datetime
import struct

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pagemill.errors import KeyNotFoundError
from pagemill.functions import keys, sortkeys, values
from pagemill.operators import longvalues
from pagemill.operators.lookup import KeyedFrame, best_index, equals

EXTREMES = [-(2**63), -(2**31) - 1, -1, 0, 1, 255, 2**31, 2**63 - 1]


def encoded(spark, column, rows, kind):
    df = spark.createDataFrame([(r,) for r in rows], f"v {kind}")
    return [bytes(r.k) for r in df.select(column(F.col("v")).alias("k")).collect()]


@pytest.mark.parametrize(
    ("column", "rows", "kind"),
    [
        (lambda v: keys.signed(v, 8), EXTREMES, "bigint"),
        (lambda v: keys.signed(v, 4), [-(2**31), -1337, 0, 7, 2**31 - 1], "int"),
        (lambda v: keys.signed(v, 2), [-32768, -1, 0, 32767], "int"),
        (lambda v: keys.unsigned(v, 4), [0, 1, 2**31, 2**32 - 1], "bigint"),
        (keys.raw_datetime, [-1, -(2**62), 0, 5, 2**62], "bigint"),
        (keys.double, [float("-inf"), -2.5, -0.5, 0.0, 1e-300, 1.0, 13371337.13371337, float("inf")], "double"),
        (keys.single, [-2.0, -1.0, 0.0, 1.0, 3.5], "float"),
        (keys.bit, [False, True], "boolean"),
        (keys.text, ["A", "AB", "b", "BB", "ca"], "string"),
        (keys.binary_chunks, [b"\0", b"a", b"a" * 8, b"a" * 9, b"b"], "binary"),
    ],
)
def test_order(spark, column, rows, kind):
    got = encoded(spark, column, rows, kind)
    if column is keys.raw_datetime:
        got, rows = got[2:], rows[2:]
    assert got == sorted(got) and len(set(got)) == len(rows)
    assert encoded(spark, column, [None], kind) == [b"\0"]


def test_known_bytes(spark):
    assert encoded(spark, keys.double, [1.0], "double") == [b"\x7f" + (struct.unpack(">Q", struct.pack(">d", 1.0))[0] ^ 1 << 63).to_bytes(8, "big")]
    assert encoded(spark, keys.text, ["", "ab"], "string") == [b"\x7f\x40", b"\x7fAB\0"]
    assert encoded(spark, keys.binary_chunks, [b"", b"12345678", b"123456789"], "binary") == [b"\x7f\x40", b"\x7f12345678\x08", b"\x7f12345678\x099" + b"\0" * 7 + b"\x01"]
    cut = encoded(spark, lambda v: keys.binary_chunks(v, 12), [b"x" * 20], "binary")[0]
    assert cut == b"\x7f" + b"x" * 8 + b"\x09" + b"xx"
    guid = encoded(spark, keys.guid, ["3f360af1-6766-46dc-9af2-0dacf295c2a1"], "string")[0]
    assert guid == b"\x7f" + bytes.fromhex("0dacf295c2a1" "9af2" "dc46" "6667" "f10a363f")


@settings(max_examples=25, deadline=None)
@given(st.lists(st.integers(-(2**63), 2**63 - 1), min_size=2, max_size=20, unique=True))
def test_order_of_any_longs(spark, rows):
    got = encoded(spark, lambda v: keys.signed(v, 8), rows, "bigint")
    assert [r for _, r in sorted(zip(got, rows, strict=True))] == sorted(rows)


def test_best_index(spark):
    rows = [("t", 1, "Id", ["Id"]), ("t", 2, "Bit", ["Bit"]), ("t", 3, "Both", ["Bit", "UnsignedByte"])]
    indexes = spark.createDataFrame(rows, "table_name string, position int, index_name string, columns array<string>")
    cases = [(["Id"], "Id"), (["Bit"], "Bit"), (["Bit", "UnsignedByte"], "Both"), (["UnsignedByte", "Bit"], "Both"), (["UnsignedByte"], None), (["Id", "Bit"], "Id"), (["Bit", "Other"], "Bit")]
    for wanted, name in cases:
        assert [r.index_name for r in best_index(indexes, wanted).collect()] == ([name] if name else [])


def test_lookup_edges(spark):
    df = spark.createDataFrame([(1, 1, "a", [1, 2]), (1, 1, None, [3]), (2, 0, "b", None)], "k int, n int, v string, s array<int>")
    f = KeyedFrame(df, ["k", "n"], ["v"])
    assert f.find_all(k=1, n=1).count() == 2
    assert [r.v for r in f.find_all(k=1, n=1, v=None).collect()] == [None]
    assert [r.v for r in f.find_all(k=1, n=1, s=2).collect()] == ["a"]
    assert [r.v for r in f.find_all(k=1, n=1, s=[3]).collect()] == [None]
    assert f.seek(k=3).count() == 0 and f.seek(k=1, n=2).first().k == 2
    assert f.prev_of(k=2).first().k == 1 and f.next_of(k=2).count() == 0
    assert [r.position for r in f.ordered().orderBy("position").collect()] == [1, 2, 3]
    with pytest.raises(KeyNotFoundError):
        f.search(strict=True, k=9, n=9)
    with pytest.raises(KeyError):
        f.find_all(k=1)
    with pytest.raises(KeyError):
        KeyedFrame(df, ["zz"])
    assert df.filter(equals(F.col("s"), None, True)).count() == 1


def test_conversions(spark):
    row = spark.range(1).select(
        values.oa_date(F.lit(36220.0)).alias("a"), values.oa_date(F.lit(-205470.0)).alias("b"), values.windows_time(F.lit(116444736000000010)).alias("c"),
        values.day_of_year(F.lit(2021), F.lit(366)).alias("d"), values.sid_text(F.unhex(F.lit("010100000000000512000000"))).alias("e"),
        values.ip_text(F.unhex(F.lit("C0A80001"))).alias("f"), values.guid_text(F.unhex(F.lit("f10a363f6667dc469af20dacf295c2a1"))).alias("g"),
        values.decode_text(1200)(F.unhex(F.lit("41004cd8"))).alias("h"), values.ip_text(F.unhex(F.lit("01"))).alias("i"),
    ).first()
    assert row.a == datetime.datetime(1999, 3, 1) and row.b == datetime.datetime(1337, 6, 9)
    assert row.c == datetime.datetime(1970, 1, 1, 0, 0, 0, 1) and row.d == datetime.date(2022, 1, 1)
    assert row.e == "S-1-5-18" and row.f == "192.168.0.1" and row.g == "3f360af1-6766-46dc-9af2-0dacf295c2a1" and row.i is None
    assert row.h == "A\\x4c\\xd8"


def seven_bit(text: bytes, scheme: int) -> bytes:
    bits = sum(b << 7 * i for i, b in enumerate(text))
    size = (7 * len(text) + 7) // 8
    return bytes([scheme << 3 | (7 * len(text) - 1) % 8]) + bits.to_bytes(size, "little")


@pytest.mark.parametrize("n", [1, 2, 7, 8, 9, 50])
def test_seven_bit(n):
    text = bytes(97 + i % 26 for i in range(n))
    assert values.decompress_value(seven_bit(text, 1)) == text
    assert values.decompress_value(seven_bit(text, 2)) == b"".join(bytes((b, 0)) for b in text)


def test_xpress():
    # Flags: three literals, then a match of distance 3 and length 7 + 15 + 3 + 8 extra.
    flags = (1 << 28).to_bytes(4, "little")
    stored = flags + b"abc" + ((2 << 3) | 7).to_bytes(2, "little") + b"\x0f" + b"\x08"
    out = values.decompress_value(b"\x18\0\0" + stored)
    assert out == (b"abc" * 20)[: 3 + 7 + 15 + 8 + 3]
    assert values.decompress_value(b"") == b"" and values.decompress_value(b"\x20x") == b"\x20x"
    with pytest.raises(NotImplementedError):
        values.decompress_value(b"\x28x")


def test_assemble_binary(spark):
    df = spark.createDataFrame([(1, bytes(range(256)) * 3), (2, b"x")], "k int, v binary")
    chunks = longvalues.split(df, "k", "v", 100)
    assert {r.k: bytes(r.value) for r in longvalues.assemble(chunks, "k").collect()} == {1: bytes(range(256)) * 3, 2: b"x"}


def test_sort_key(spark):
    table = {"a": (b"\x0e\x02", 2, 2), "A": (b"\x0e\x02", 2, 18), "b": (b"\x0e\x09", 2, 2)}
    df = spark.createDataFrame([("a",), ("A",), ("b",), (None,)], "v string")
    got = [r.k and bytes(r.k) for r in df.select(sortkeys.sort_key(table)("v").alias("k")).collect()]
    assert got[0] < got[1] < got[2] and got[3] is None
    assert df.filter(sortkeys.collated(F.col("v")) == "a").count() == 2
