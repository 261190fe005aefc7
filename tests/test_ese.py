"""Pages, trees and records of files that the test writer makes; not conformance to a real engine's files."""

import struct

import pytest
from pyspark.sql import functions as F

from ese_writer import LEAF, NEW, PARENT, ROOT, catalog_row, header, page, record, tagged
from pagemill.errors import InvalidDatabase
from pagemill.operators import catalog as C
from pagemill.sources import ese


def database(tmp_path, size):
    rows = [
        catalog_row(2, 1, 2, 5, "People"),
        catalog_row(2, 2, 1, 4, "Id"),
        catalog_row(2, 2, 2, 8, "Seen"),
        catalog_row(2, 2, 3, 1, "Flag"),
        catalog_row(2, 2, 128, 10, "Name", page=1252),
        catalog_row(2, 2, 129, 9, "Blob"),
        catalog_row(2, 2, 256, 12, "Notes", page=1252),
        catalog_row(2, 3, 1, 5, "IxId", flags=0x21, keys=struct.pack("<HH", 0, 1)),
        catalog_row(2, 3, 2, 9, "IxName", keys=struct.pack("<HHHH", 0, 128, 0, 1)),
    ]
    cat = page(size, ROOT | LEAF | NEW, [(bytes([i + 1]), r, 0, False) for i, r in enumerate(rows)])

    def person(i):
        small = size <= 8192
        extra = tagged([(256, None, f"note {i}".encode()), (257, 0x10, bytes([2]) + b"xxyyy")], small)
        return record([struct.pack("<i", -i), struct.pack("<q", 2**40 + i), b"\xff"], [f"name {i}".encode(), None if i % 2 else b"\x01\x02"], extra, [3] if i == 3 else ())

    def key(i):
        return b"\x7f\x80\x00\x00" + bytes([i])

    branch = page(size, ROOT | PARENT, [(key(3), struct.pack("<I", 6), 0, False), (b"", struct.pack("<I", 7), 0, False)])
    left = page(size, LEAF | NEW, [(key(i), person(i), 4, i == 2) for i in (1, 2)], prefix=key(0)[:4], nxt=7)
    right = page(size, LEAF | NEW, [(key(i), person(i), 0, False) for i in (3, 4)])
    empty = page(size, 0, [])
    raw = header(size) * 2 + empty * 3 + cat + branch + left + right
    path = tmp_path / f"db{size}.edb"
    path.write_bytes(raw)
    return str(path)


@pytest.mark.parametrize("size", [4096, 8192, 32768])
def test_decode(spark, tmp_path, size):
    files = ese.read_files(spark, database(tmp_path, size))
    head = ese.headers(files).first()
    assert head.valid and head.page_size == size and head.state == 3
    headed = ese.page_headers(ese.pages(files))
    assert [(r.pgno, r.node_count, r.is_root, r.is_leaf) for r in headed.filter("pgno >= 4").orderBy("pgno").collect()] == [(4, 9, True, True), (5, 2, True, False), (6, 2, False, True), (7, 2, False, True)]
    nodes = ese.nodes(headed)
    rows = ese.catalog(nodes)
    assert rows.filter("Type = 1").first().Name == "People"
    columns = {r.name: r for r in C.columns(rows).collect()}
    assert columns["Seen"].offset == 4 and columns["Flag"].offset == 12 and columns["Name"].storage == "variable" and columns["Notes"].storage == "tagged"
    found = {r.index_name: r for r in C.indexes(rows).collect()}
    assert found["IxName"].columns == ["Name", "Id"] and found["IxId"].is_primary and not found["IxName"].is_primary
    assert C.primary_index(C.indexes(rows)).first().index_name == "IxId"
    people = ese.read_table(nodes, rows, "People").orderBy("key").collect()
    assert [p.Id for p in people] == [-1, -2, -3, -4]
    assert [p.Seen - 2**40 for p in people] == [1, 2, 3, 4]
    assert [p.Flag for p in people] == [True, True, None, True]
    assert [p.Name for p in people] == [f"name {i}" for i in (1, 2, 3, 4)]
    assert [p.Blob and bytes(p.Blob) for p in people] == [None, b"\x01\x02", None, b"\x01\x02"]
    leaves = ese.leaf_nodes(nodes, rows.filter("Type = 1").select("path", F.col("ColtypOrPgnoFDP").alias("root")))
    assert [r.is_deleted for r in leaves.orderBy("key").collect()] == [False, True, False, False]
    fields = ese.tagged_fields(leaves).withColumn("v", ese.multi_values(F.col("raw"), F.col("field_flags")))
    got = {(bytes(r.key)[-1], r.column_id): [bytes(x) for x in r.v] for r in fields.collect()}
    assert got[1, 256] == [b"note 1"] and got[4, 257] == [b"xx", b"yyy"] and len(got) == 8
    with pytest.raises(KeyError):
        ese.read_table(nodes, rows, "Nobody")


def test_invalid(spark, tmp_path):
    (tmp_path / "bad.edb").write_bytes(header(4096, magic=1) * 3)
    with pytest.raises(InvalidDatabase):
        ese.open_database(spark, str(tmp_path / "bad.edb"))
    (tmp_path / "old.edb").write_bytes(header(4096, major=8) * 3)
    with pytest.raises(InvalidDatabase):
        ese.open_database(spark, str(tmp_path / "old.edb"))


@pytest.mark.parametrize(("state", "reserved", "count"), [(0x2069, 2, 0x69), (0x0069, 1, 0x69)])
def test_tag_state(spark, state, reserved, count):
    buf = bytearray(4096)
    struct.pack_into("<H", buf, 34, state)
    df = spark.createDataFrame([("p", 4096, 1, bytes(buf))], "path string, page_size int, pgno int, buf binary")
    row = ese.page_headers(df).first()
    assert (row.reserved_tags, row.tag_count) == (reserved, count)


def test_many_values(spark):
    raw = struct.pack("<HHH", 6, 8, 8) + b"ab" + b"xyz"
    df = spark.createDataFrame([(raw, 0x08), (b"one", 0)], "raw binary, f int")
    got = [[bytes(x) for x in r.v] for r in df.select(ese.multi_values(F.col("raw"), F.col("f")).alias("v")).collect()]
    assert got == [[b"ab", b"", b"xyz"], [b"one"]]


def test_defaults_and_floating(spark):
    """Columns beyond a record's last take their default, explicit nulls stay null; IEEE columns come back as numbers."""
    records = [record([struct.pack("<f", 1.5), struct.pack("<d", -2.25)], [b"x", None], fixed_null=()), record([struct.pack("<f", 0.5)], [b"y"], fixed_null=(1,)), b"\0"]
    rows = spark.createDataFrame([(i, r) for i, r in enumerate(records)], "i int, data binary")
    defaults = {"A": struct.pack("<f", 9), "B": struct.pack("<d", 7.5), "D": b"dflt"}
    stored = ese.fields(rows, [(1, "A", 0, 4), (2, "B", 4, 8), (128, "C", None, None), (129, "D", None, None)], defaults)
    codes = {"A": 6, "B": 7, "C": 10, "D": 10}
    got = [tuple(r) for r in stored.orderBy("i").select(*[ese.typed(F.col(n), c, 1252) for n, c in codes.items()]).collect()]
    assert got == [(1.5, -2.25, "x", None), (None, 7.5, "y", "dflt"), (None, None, None, None)]


def test_read_table_uses_the_catalogs_defaults(spark, tmp_path):
    size = 4096
    rows = [catalog_row(2, 1, 2, 5, "T"), catalog_row(2, 2, 1, 4, "Id"), catalog_row(2, 2, 2, 7, "Score", default=struct.pack("<d", 2.5)), catalog_row(2, 2, 128, 10, "Name", page=1252, default=b"none")]
    raw = header(size) * 2 + page(size, 0, []) * 3 + page(size, ROOT | LEAF | NEW, [(bytes([i + 1]), r, 0, False) for i, r in enumerate(rows)])
    raw += page(size, ROOT | LEAF | NEW, [(b"\x01", record([struct.pack("<i", 1)], []), 0, False), (b"\x02", record([struct.pack("<i", 2), struct.pack("<d", 0.5)], [None]), 0, False)])
    (tmp_path / "d.edb").write_bytes(raw)
    nodes = ese.nodes(ese.page_headers(ese.pages(ese.read_files(spark, str(tmp_path / "d.edb")))))
    got = ese.read_table(nodes, ese.catalog(nodes), "T").orderBy("key").select("Id", "Score", "Name").collect()
    assert [tuple(r) for r in got] == [(1, 2.5, "none"), (2, 0.5, None)]


def test_read_table_over_two_files_with_long_values(spark, tmp_path):
    """Tagged, compressed, separated and multi-valued columns and their defaults, of two files whose tables share a number."""
    size = 4096
    lid = struct.pack("<I", 0x0102)
    for n in (1, 2):
        rows = [catalog_row(2, 1, 2, 5, "T"), catalog_row(2, 2, 1, 4, "Id"), catalog_row(2, 2, 2, 3, "Part"), catalog_row(2, 2, 256, 12, "Note", page=1252, default=b"none"), catalog_row(2, 2, 257, 17, "Many")]
        rows += [catalog_row(2, 2, 258, 11, "Long"), catalog_row(2, 4, 1, 6, "LV"), catalog_row(3, 1, 3, 7, "Other"), catalog_row(3, 2, 1, 4, "Id")]
        fixed = lambda i: [struct.pack("<i", 10 * n + i), struct.pack("<h", -i)]  # noqa: B023, E731
        pair = bytes([2]) + struct.pack("<HH", 7, 65535)
        people = [
            record(fixed(1), [], tagged([(256, 1, f"note {n}".encode()), (257, 0x10, pair), (258, 5, lid)], True)),
            record(fixed(2), [], tagged([(257, None, struct.pack("<H", 9)), (258, 3, bytes([0x0F]) + _seven(b"squeezed"))], True)),
            record(fixed(3), []),
        ]
        text = b"a" * 40 + str(n).encode()
        long = [(lid[::-1], struct.pack("<II", 1, len(text)), 0, False), (lid[::-1] + struct.pack(">I", 0), text[:30], 0, False), (lid[::-1] + struct.pack(">I", 30), text[30:], 0, False)]
        raw = header(size) * 2 + page(size, 0, []) * 3 + page(size, ROOT | LEAF | NEW, [(bytes([i + 1]), r, 0, False) for i, r in enumerate(rows)])
        raw += page(size, ROOT | LEAF | NEW, [(bytes([i + 1]), r, 0, False) for i, r in enumerate(people)]) + page(size, ROOT | LEAF | NEW, long) + page(size, ROOT | LEAF | NEW, [])
        (tmp_path / f"f{n}.edb").write_bytes(raw)
    nodes = ese.nodes(ese.page_headers(ese.pages(ese.read_files(spark, str(tmp_path / "*.edb")))))
    rows = ese.catalog(nodes)
    assert sorted((r.table_name, r.name, r.offset) for r in C.columns(rows).collect() if r.storage == "fixed") == sorted([("T", "Id", 0), ("T", "Part", 4), ("Other", "Id", 0)] * 2)
    got = ese.read_table(nodes, rows, "T", multi=["Many"]).orderBy("Id").collect()
    assert [(r.Id, r.Part, r.Note, r.Many, r.Long and bytes(r.Long)) for r in got] == [
        row for n in (1, 2) for row in ((10 * n + 1, -1, f"note {n}", [7, 65535], b"a" * 40 + str(n).encode()), (10 * n + 2, -2, "none", [9], b"squeezed"), (10 * n + 3, -3, "none", None, None))
    ]


def _seven(text):
    """Seven bits a character, lowest first; the first byte's low bits hold the bits used of the last byte, less one."""
    bits = sum(b << (7 * i) for i, b in enumerate(text))
    return bits.to_bytes(-(-7 * len(text) // 8), "little")
