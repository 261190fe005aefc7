"""Every registered query of the keyed-lookup library against DuckDB, at the smallest scale."""

import os
from pathlib import Path

import pytest

from pagemill.plans import catalogue

duckdb = pytest.importorskip("duckdb")
DATA = Path(os.environ.get("PAGEMILL_TEST_DATA", "/root/testdata/sf0.001"))
pytestmark = pytest.mark.skipif(not DATA.is_dir(), reason="no test tables")
EMPTY = {"search_miss", "seek_past_end"}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for table in DATA.glob("*.parquet"):
        con.sql(f"CREATE VIEW {table.stem} AS SELECT * FROM '{table}'")
    return con


@pytest.mark.parametrize("name", sorted(catalogue.queries()))
def test_query_equals_sql(spark, duck, name):
    df = catalogue.queries()[name](spark, str(DATA))
    columns = sorted(df.columns)
    mine = sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)
    theirs = duck.sql(catalogue.oracle_sql()[name])
    assert sorted(theirs.columns) == columns
    order = [theirs.columns.index(c) for c in columns]
    rows = duck.execute(catalogue.oracle_sql()[name]).fetchall()
    assert mine == sorted((tuple(r[i] for i in order) for r in rows), key=repr)
    assert bool(mine) == (name not in EMPTY)


def test_point_search_reaches_the_scan(spark):
    plan = catalogue.queries()["search_exact"](spark, str(DATA))._jdf.queryExecution().toString()
    assert "EqualTo(o_orderkey,7)" in plan


def test_activity_counts_every_event(spark, duck):
    """The day columns reach over the whole year: no event of a day after the 20th is left out."""
    df = catalogue.queries()["ual_activity_year"](spark, str(DATA))
    assert sum(r["count"] for r in df.collect()) == duck.execute("SELECT count(ts) FROM events").fetchone()[0]


def test_srum_times_from_stored_bits(spark):
    """A TimeStamp read from a file holds the bits of a double; nulls stay null, and the last id row in order counts."""
    import datetime
    import struct

    from pagemill.plans import srum

    bits = struct.unpack("<q", struct.pack("<d", 36220.25))[0]
    rows = spark.createDataFrame([(1, bits), (2, None)], "i int, TimeStamp bigint")
    got = {r.i: r.TimeStamp for r in srum.timed(rows, srum.PROVIDERS["network_data"]).collect()}
    assert got == {1: datetime.datetime(1999, 3, 1, 6), 2: None}
    ids = spark.createDataFrame([(7, 0, "old".encode("utf-16-le"), 1), (7, 0, "new".encode("utf-16-le"), 2)], "IdIndex int, IdType int, IdBlob binary, key int")
    assert srum.id_map(ids, "key").first().id_text == "new"
    with pytest.raises(ValueError):
        srum.entries({"MSysObjects": ids})
