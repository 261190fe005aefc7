"""The registered queries of the keyed-lookup library and their SQL, each over its whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pagemill.functions import keys, values
from pagemill.operators import catalog, longvalues
from pagemill.operators.lookup import KeyedFrame, best_index
from pagemill.plans import srum, ual

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def _query(name: str, sql: str | None = None):
    def add(f):
        _QUERIES[name] = lambda spark, sf_dir: f(lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet"))
        if sql is not None:
            _SQL[name] = sql
        return f

    return add


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines of every order with its neighbours' quantities: a lookup and a cursor in one."""
    return queries()["cursor_neighbours"](spark, sf_dir)


LINES = ("l_orderkey", "l_linenumber")
TIES = ("l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_shipdate")


def _lines(t) -> KeyedFrame:
    return KeyedFrame(t("lineitem"), LINES, TIES)


def _a_line(t) -> tuple[int, int]:
    """The key that most lines share, so that no search is empty at any scale."""
    row = t("lineitem").groupBy(*LINES).count().orderBy(F.desc("count"), *LINES).first()
    return row.l_orderkey, row.l_linenumber


A_LINE = "(SELECT l_orderkey k, l_linenumber n FROM lineitem GROUP BY ALL ORDER BY count(*) DESC, 1, 2 LIMIT 1)"


# Scans and projections


@_query("scan_table", "SELECT * FROM nation")
def scan_table(t):
    return t("nation")


@_query("project_columns", "SELECT o_orderkey, o_custkey, o_totalprice FROM orders")
def project_columns(t):
    return t("orders").select("o_orderkey", "o_custkey", "o_totalprice")


@_query(
    "record_as_dict",
    "UNPIVOT (SELECT s_suppkey, s_name, CAST(s_nationkey AS VARCHAR) AS nation, CAST(s_suppkey * 2 AS VARCHAR) AS twice FROM supplier) ON s_name, nation, twice INTO NAME column_name VALUE stored",
)
def record_as_dict(t):
    rows = t("supplier").select("s_suppkey", "s_name", F.col("s_nationkey").cast("string").alias("nation"), (F.col("s_suppkey") * 2).cast("string").alias("twice"))
    return rows.unpivot("s_suppkey", ["s_name", "nation", "twice"], "column_name", "stored").filter("stored is not null")


@_query(
    "page_arithmetic",
    "SELECT o_orderkey, o_orderkey // 4096 AS pgno, (o_orderkey // 4096) + 2 AS physical, o_orderkey & 4095 AS tag_count, CASE WHEN o_orderkey >> 12 = 0 THEN 1 ELSE o_orderkey >> 12 END AS reserved, (o_orderkey & 2) <> 0 AS is_leaf FROM orders",
)
def page_arithmetic(t):
    k = F.col("o_orderkey")
    high = F.shiftright(k, 12)
    page = F.floor(k / 4096).cast("long")
    return t("orders").select("o_orderkey", page.alias("pgno"), (page + 2).alias("physical"), k.bitwiseAND(F.lit(4095)).alias("tag_count"), F.when(high == 0, 1).otherwise(high).alias("reserved"), (k.bitwiseAND(F.lit(2)) != 0).alias("is_leaf"))


# Searches


@_query("search_exact", "SELECT * FROM orders WHERE o_orderkey = 7")
def search_exact(t):
    return KeyedFrame(t("orders"), ["o_orderkey"]).search(o_orderkey=7)


@_query("search_miss", "SELECT * FROM orders WHERE o_orderkey = -7")
def search_miss(t):
    return KeyedFrame(t("orders"), ["o_orderkey"]).search(o_orderkey=-7)


@_query("find_all_duplicates", f"SELECT l.* FROM lineitem l, {A_LINE} a WHERE l_orderkey = k AND l_linenumber = n")
def find_all_duplicates(t):
    k, n = _a_line(t)
    return _lines(t).find_all(l_orderkey=k, l_linenumber=n)


@_query("find_all_residual", f"SELECT l.* FROM lineitem l, {A_LINE} a WHERE l_orderkey = k AND l_linenumber = n AND l_returnflag IS NOT DISTINCT FROM 'A'")
def find_all_residual(t):
    k, n = _a_line(t)
    return _lines(t).find_all(l_orderkey=k, l_linenumber=n, l_returnflag="A")


@_query("find_first", f"SELECT l.* FROM lineitem l, {A_LINE} a WHERE l_orderkey = k AND l_linenumber = n ORDER BY {', '.join(TIES)} LIMIT 1")
def find_first(t):
    k, n = _a_line(t)
    return _lines(t).find(l_orderkey=k, l_linenumber=n)


@_query(
    "residual_member",
    "WITH o AS (SELECT l_orderkey, list(DISTINCT l_linenumber) ns FROM lineitem GROUP BY 1) SELECT l_orderkey FROM o WHERE list_contains(ns, 3)",
)
def residual_member(t):
    sets = t("lineitem").groupBy("l_orderkey").agg(F.collect_set("l_linenumber").alias("ns"))
    from pagemill.operators.lookup import equals

    return sets.filter(equals(F.col("ns"), 3, is_array=True)).select("l_orderkey")


@_query("seek_ge", "SELECT * FROM orders WHERE o_orderkey >= 1000 ORDER BY o_orderkey LIMIT 1")
def seek_ge(t):
    return KeyedFrame(t("orders"), ["o_orderkey"]).seek(o_orderkey=1000)


@_query("seek_past_end", "SELECT * FROM orders WHERE o_orderkey >= 9000000000 ORDER BY o_orderkey LIMIT 1")
def seek_past_end(t):
    return KeyedFrame(t("orders"), ["o_orderkey"]).seek(o_orderkey=9_000_000_000)


@_query("cursor_next", f"SELECT l.* FROM lineitem l, {A_LINE} a WHERE (l_orderkey, l_linenumber) > (k, n) ORDER BY l_orderkey, l_linenumber, {', '.join(TIES)} LIMIT 1")
def cursor_next(t):
    k, n = _a_line(t)
    return _lines(t).next_of(l_orderkey=k, l_linenumber=n)


@_query("cursor_prev", "SELECT * FROM orders WHERE o_orderkey < 1000 ORDER BY o_orderkey DESC LIMIT 1")
def cursor_prev(t):
    return KeyedFrame(t("orders"), ["o_orderkey"]).prev_of(o_orderkey=1000)


@_query(
    "cursor_neighbours",
    f"SELECT l_orderkey, l_linenumber, l_quantity, lag(l_quantity) OVER w AS prev_l_quantity, lead(l_quantity) OVER w AS next_l_quantity FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, {', '.join(TIES)})",
)
def cursor_neighbours(t):
    return _lines(t).neighbours("l_quantity", ["l_orderkey"]).select("l_orderkey", "l_linenumber", "l_quantity", "prev_l_quantity", "next_l_quantity")


@_query("ordered_iteration", "SELECT event_id, row_number() OVER (ORDER BY ts, event_id) AS position FROM events")
def ordered_iteration(t):
    return KeyedFrame(t("events"), ["ts"], ["event_id"]).ordered().select("event_id", "position")


@_query(
    "bookmark_join",
    "SELECT l_orderkey, l_linenumber, o_custkey, o_orderdate FROM lineitem JOIN orders ON l_orderkey = o_orderkey",
)
def bookmark_join(t):
    index = t("lineitem").select("l_orderkey", "l_linenumber")
    return KeyedFrame(t("orders"), ["o_orderkey"]).resolve(index, {"l_orderkey": "o_orderkey"}).select("l_orderkey", "l_linenumber", "o_custkey", "o_orderdate")


# Keys


def _hex(column, name="key"):
    return F.hex(column).alias(name)


@_query("key_longlong", "SELECT o_orderkey, '7F' || printf('%016X', CAST(o_orderkey * 1000003 AS HUGEINT) + 9223372036854775808) AS key FROM orders")
def key_longlong(t):
    return t("orders").select("o_orderkey", _hex(keys.signed(F.col("o_orderkey") * 1000003, 8)))


@_query("key_long", "SELECT s_suppkey, '7F' || printf('%08X', s_suppkey - 50 + 2147483648) AS key FROM supplier")
def key_long(t):
    return t("supplier").select("s_suppkey", _hex(keys.signed(F.col("s_suppkey") - 50, 4)))


@_query("key_short", "SELECT p_partkey, '7F' || printf('%04X', p_size - 25 + 32768) AS key FROM part")
def key_short(t):
    return t("part").select("p_partkey", _hex(keys.signed(F.col("p_size") - 25, 2)))


@_query("key_unsigned", "SELECT p_partkey, '7F' || printf('%02X', p_size) AS k1, '7F' || printf('%04X', p_size * 1000) AS k2, '7F' || printf('%08X', p_partkey) AS k4 FROM part")
def key_unsigned(t):
    return t("part").select("p_partkey", _hex(keys.unsigned(F.col("p_size"), 1), "k1"), _hex(keys.unsigned(F.col("p_size") * 1000, 2), "k2"), _hex(keys.unsigned(F.col("p_partkey"), 4), "k4"))


@_query("key_bit_null", "SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN '00' WHEN o_orderstatus = 'F' THEN '7FFF' ELSE '7F00' END AS key FROM orders")
def key_bit_null(t):
    return t("orders").select("o_orderkey", _hex(keys.bit(F.when(F.col("o_orderkey") % 3 != 0, F.col("o_orderstatus") == "F"))))


@_query("key_datetime", "SELECT o_orderkey, '7F' || CASE WHEN x < 0 THEN printf('%016X', -x - 1) ELSE printf('%016X', CAST(x AS HUGEINT) + 9223372036854775808) END AS key FROM (SELECT o_orderkey, (o_orderkey - 5000) * 1000000007 AS x FROM orders)")
def key_datetime(t):
    return t("orders").select("o_orderkey", _hex(keys.raw_datetime((F.col("o_orderkey") - 5000) * 1000000007)))


@_query("key_ascii_text", "SELECT c_custkey, '7F' || hex(encode(upper(c_name))) || '00' AS key FROM customer")
def key_ascii_text(t):
    return t("customer").select("c_custkey", _hex(keys.text(F.col("c_name"))))


@_query(
    "key_binary_chunks",
    "SELECT p_partkey, CASE WHEN n = 0 THEN '7F40' ELSE '7F' || list_aggregate(list_transform(range(1, c + 1), lambda i: rpad(substr(h, (i - 1) * 16 + 1, 16), 16, '0') || CASE WHEN i = c THEN printf('%02X', n - (i - 1) * 8) ELSE '09' END), 'string_agg', '') END AS key FROM (SELECT p_partkey, hex(encode(p_name)) AS h, octet_length(encode(p_name)) AS n, (octet_length(encode(p_name)) + 7) // 8 AS c FROM part)",
)
def key_binary_chunks(t):
    return t("part").select("p_partkey", _hex(keys.binary_chunks(F.col("p_name").cast("binary"))))


@_query(
    "key_guid",
    "SELECT o_orderkey, '7F' || upper(substr(h, 21, 12) || substr(h, 17, 4) || substr(h, 15, 2) || substr(h, 13, 2) || substr(h, 11, 2) || substr(h, 9, 2) || substr(h, 7, 2) || substr(h, 5, 2) || substr(h, 3, 2) || substr(h, 1, 2)) AS key FROM (SELECT o_orderkey, md5(CAST(o_orderkey AS VARCHAR)) AS h FROM orders)",
)
def key_guid(t):
    h = F.md5(F.col("o_orderkey").cast("string"))
    text = F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.substring(h, 13, 4), F.substring(h, 17, 4), F.substring(h, 21, 12))
    return t("orders").select("o_orderkey", _hex(keys.guid(text)))


@_query("key_double_order", "SELECT c_custkey, row_number() OVER (ORDER BY c_acctbal, c_custkey) AS position FROM customer")
def key_double_order(t):
    # The bits have no SQL; their order has.
    coded = t("customer").select("c_custkey", keys.double(F.col("c_acctbal")).alias("key"))
    return KeyedFrame(coded, ["key"], ["c_custkey"]).ordered().select("c_custkey", "position")


@_query("key_composite_order", "SELECT p_partkey, row_number() OVER (ORDER BY upper(p_name), p_size, p_partkey) AS position FROM part")
def key_composite_order(t):
    coded = t("part").select("p_partkey", keys.composite(keys.text(F.col("p_name")), keys.signed(F.col("p_size"), 4)).alias("key"))
    return KeyedFrame(coded, ["key"], ["p_partkey"]).ordered().select("p_partkey", "position")


# Catalog


@_query(
    "catalog_fold",
    "SELECT event_id, last_value(CASE WHEN event_id % 5 = 0 THEN event_type END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id) AS table_name FROM events",
)
def catalog_fold(t):
    rows = t("events").withColumn("kind", F.when(F.col("event_id") % 5 == 0, catalog.TABLE).otherwise(catalog.COLUMN))
    return catalog.fold(rows, "event_id", "kind", "event_type", "user_id").select("event_id", "table_name")


@_query(
    "fixed_offsets",
    "SELECT l_orderkey, l_linenumber, l_partkey, coalesce(sum(l_linenumber) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS column_offset FROM lineitem",
)
def fixed_offsets(t):
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice").rowsBetween(Window.unboundedPreceding, -1)
    return t("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.coalesce(F.sum("l_linenumber").over(w), F.lit(0)).cast("long").alias("column_offset"))


@_query(
    "best_index",
    "WITH i AS (SELECT n_regionkey, n_nationkey, n_name, [CASE WHEN n_nationkey % 2 = 0 THEN 'Id' ELSE 'Bit' END, CASE WHEN n_nationkey % 3 = 0 THEN 'Byte' ELSE 'Id' END, 'Long'] AS c FROM nation), s AS (SELECT *, CASE WHEN NOT list_contains(['Byte', 'Id'], c[1]) THEN 0 WHEN NOT list_contains(['Byte', 'Id'], c[2]) THEN 1 ELSE 2 END AS score FROM i) SELECT CAST(n_regionkey AS VARCHAR) AS table_name, max(score) AS score, arg_max(n_name, score * 1000 - n_nationkey) AS index_name FROM s WHERE score > 0 GROUP BY n_regionkey",
)
def best_index_query(t):
    n = F.col("n_nationkey")
    columns = F.array(F.when(n % 2 == 0, "Id").otherwise("Bit"), F.when(n % 3 == 0, "Byte").otherwise("Id"), F.lit("Long"))
    return best_index(t("nation").select(F.col("n_regionkey").cast("string").alias("table_name"), n.alias("position"), F.col("n_name").alias("index_name"), columns.alias("columns")), ["Byte", "Id"])


@_query(
    "index_key_columns",
    "SELECT n_nationkey, n_nationkey * 7 + 1 AS first_id, n_nationkey * 300 + 2 AS second_id FROM nation",
)
def index_key_columns(t):
    def word(c):
        h = F.lpad(F.hex(c.cast("long")), 4, "0")
        return F.concat(F.substring(h, 3, 2), F.substring(h, 1, 2))

    n = F.col("n_nationkey")
    packed = F.unhex(F.concat(F.lit("0000"), word(n * 7 + 1), F.lit("0000"), word(n * 300 + 2)))
    cut = t("nation").select("n_nationkey", packed.alias("p"))
    return cut.select("n_nationkey", values.little_endian(F.substring("p", 3, 2)).cast("int").alias("first_id"), values.little_endian(F.substring("p", 7, 2)).cast("int").alias("second_id"))


# Long values


@_query(
    "long_value_chunks",
    "SELECT doc_id, chunk_no::INTEGER AS chunk_no, sha256(substr(text, (chunk_no * 200 + 1)::BIGINT, 200)) AS chunk_sha256 FROM (SELECT doc_id, text, unnest(range(0, (length(text) + 199) // 200)) AS chunk_no FROM documents)",
)
def long_value_chunks(t):
    return longvalues.split(t("documents"), "doc_id", "text", 200).select("doc_id", "chunk_no", F.sha2(F.col("chunk").cast("binary"), 256).alias("chunk_sha256"))


@_query("long_value_assemble", "SELECT doc_id, sha256(text) AS value_sha256 FROM documents WHERE length(text) > 0")
def long_value_assemble(t):
    chunks = longvalues.split(t("documents"), "doc_id", "text", 200)
    return longvalues.assemble(chunks, key="doc_id").select("doc_id", F.sha2(F.col("value").cast("binary"), 256).alias("value_sha256"))


@_query(
    "long_value_span",
    "SELECT doc_id, o AS chunk_offset, coalesce(lead(o) OVER (PARTITION BY doc_id ORDER BY o), n) - o AS span FROM (SELECT doc_id, length(text) AS n, unnest(range(0, length(text), 200)) AS o FROM documents)",
)
def long_value_span(t):
    sized = longvalues.split(t("documents").select("doc_id", "text"), "doc_id", "text", 200).join(t("documents").select("doc_id", F.length("text").alias("n")), "doc_id")
    return sized.select("doc_id", F.col("chunk_offset").cast("long").alias("chunk_offset"), longvalues.expected_span("doc_id", "chunk_offset", "n").cast("long").alias("span"))


@_query("multi_values", "SELECT l_orderkey, string_agg(CAST(l_linenumber AS VARCHAR), ',' ORDER BY l_linenumber) AS line_numbers, count(*) AS n FROM lineitem GROUP BY l_orderkey")
def multi_values(t):
    lists = t("lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_list("l_linenumber")).alias("v"))
    return lists.select("l_orderkey", F.array_join(F.transform("v", lambda x: x.cast("string")), ",").alias("line_numbers"), F.size("v").cast("long").alias("n"))


@_query("checksum_xor", "SELECT o_custkey, xor(bit_xor(o_orderkey), 2309737967) AS checksum FROM orders GROUP BY o_custkey")
def checksum_xor(t):
    return t("orders").groupBy("o_custkey").agg(longvalues.xor_checksum(F.col("o_orderkey")).alias("checksum"))


@_query("decompressed_size", "SELECT p_partkey, (5 + 8 * (octet_length(encode(p_name)) + 1)) // 7 AS size FROM part")
def decompressed_size(t):
    stored = F.concat(F.unhex(F.lit("0D")), F.col("p_name").cast("binary"))  # scheme 1, five
    return t("part").select("p_partkey", values.decompressed_size(stored).alias("size"))


# Times and conversions


@_query("oa_date", "SELECT o_orderkey, TIMESTAMP '1899-12-30' + to_microseconds(CAST(round((o_orderkey % 50000 + 0.25) * 86400000000) AS BIGINT)) AS at FROM orders")
def oa_date(t):
    return t("orders").select("o_orderkey", values.oa_date(F.col("o_orderkey") % 50000 + 0.25).alias("at"))


@_query("windows_time", "SELECT o_orderkey, make_timestamp((o_orderkey * 123456789 + 132000000000000000 - 116444736000000000) // 10) AS at FROM orders")
def windows_time(t):
    return t("orders").select("o_orderkey", values.windows_time(F.col("o_orderkey") * 123456789 + 132000000000000000).alias("at"))


@_query("day_of_year", "SELECT o_orderkey, CAST(make_date(2000 + (o_orderkey % 25)::INTEGER, 1, 1) + CAST(o_orderkey % 400 AS INTEGER) AS DATE) AS at FROM orders")
def day_of_year(t):
    k = F.col("o_orderkey")
    return t("orders").select("o_orderkey", values.day_of_year((k % 25 + 2000).cast("int"), (k % 400 + 1).cast("int")).alias("at"))


@_query("sentinel_null", "SELECT p_partkey, CASE WHEN p_size NOT IN (1, 25) THEN p_size END AS p_size FROM part")
def sentinel_null(t):
    return t("part").select("p_partkey", values.not_sentinel(F.col("p_size"), 1, 25).alias("p_size"))


@_query("text_utf16", "SELECT c_custkey, c_name FROM customer")
def text_utf16(t):
    stored = F.encode(F.concat("c_name", F.lit("\0")), "UTF-16LE")
    return t("customer").select("c_custkey", values.utf16_text(stored).alias("c_name"))


@_query("ip_text", "SELECT c_custkey, '10.' || (c_custkey // 65536) % 256 || '.' || (c_custkey // 256) % 256 || '.' || c_custkey % 256 AS address FROM customer")
def ip_text(t):
    stored = F.unhex(F.concat(F.lit("0A"), F.lpad(F.hex("c_custkey"), 6, "0")))
    return t("customer").select("c_custkey", values.ip_text(stored).alias("address"))


@_query("sid_text", "SELECT c_custkey, 'S-1-5-21-' || c_custkey AS sid FROM customer")
def sid_text(t):
    h = F.lpad(F.hex("c_custkey"), 8, "0")
    little = F.concat(F.substring(h, 7, 2), F.substring(h, 5, 2), F.substring(h, 3, 2), F.substring(h, 1, 2))
    stored = F.unhex(F.concat(F.lit("01020000000000051500" + "0000"), little))
    return t("customer").select("c_custkey", values.sid_text(stored).alias("sid"))


@_query("compat_hex", "SELECT p_partkey, lower(hex(encode(p_name))) AS stored FROM part")
def compat_hex(t):
    return t("part").select("p_partkey", F.lower(F.hex(F.col("p_name").cast("binary"))).alias("stored"))


@_query("double_bits_round_trip", "SELECT c_custkey, c_acctbal FROM customer")
def double_bits_round_trip(t):
    return t("customer").select("c_custkey", values.bits_to_double(keys.double_bits(F.col("c_acctbal"))).alias("c_acctbal"))


# Profiles


@_query(
    "ual_activity",
    "SELECT user_id, dayofmonth(ts)::INTEGER AS day, CAST(make_date(2024, 1, 1) + (dayofmonth(ts) - 1)::INTEGER AS DATE) AS date, count(*) AS count FROM events WHERE dayofmonth(ts) <= 20 GROUP BY user_id, dayofmonth(ts)",
)
def ual_activity(t):
    days = list(range(1, 21))
    wide = t("events").withColumn("d", F.dayofmonth("ts")).groupBy("user_id").pivot("d", days).agg(F.count(F.lit(1)))
    named = wide.select("user_id", F.lit(2024).alias("y"), *[F.coalesce(F.col(f"`{d}`"), F.lit(0)).alias(f"Day{d}") for d in days])
    return ual.activity(named, ["user_id"], "y").select("user_id", "day", "date", "count")


@_query(
    "ual_activity_year",
    "SELECT user_id, dayofyear(ts)::INTEGER AS day, CAST(ts AS DATE) AS date, count(*) AS count FROM events WHERE ts IS NOT NULL GROUP BY user_id, dayofyear(ts), CAST(ts AS DATE)",
)
def ual_activity_year(t):
    days = list(range(1, 367))
    wide = t("events").withColumn("d", F.dayofyear("ts")).groupBy("user_id", F.year("ts").alias("y")).pivot("d", days).agg(F.count(F.lit(1)))
    named = wide.select("user_id", "y", *[F.col(f"`{d}`").alias(f"Day{d}") for d in days])
    return ual.activity(named, ["user_id"], "y").select("user_id", "day", "date", "count")


@_query(
    "srum_resolve_ids",
    "SELECT o_orderkey, c_name AS AppId, n_name AS UserId FROM (SELECT o_orderkey, o_custkey, o_custkey % 30 AS u FROM orders) o LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON u = n_nationkey",
)
def srum_resolve_ids(t):
    entries = t("orders").select("o_orderkey", F.col("o_custkey").alias("AppId"), (F.col("o_custkey") % 30).alias("UserId"))
    apps = t("customer").select(F.col("c_custkey").alias("IdIndex"), F.col("c_name").alias("id_text"))
    users = t("nation").select(F.col("n_nationkey").alias("IdIndex"), F.col("n_name").alias("id_text"))
    return srum.resolve(srum.resolve(entries, apps, ("AppId",)), users, ("UserId",))


@_query(
    "srum_entries",
    "SELECT 'nation' AS provider, n_nationkey AS id, n_name AS name, NULL::DOUBLE AS balance FROM nation UNION ALL SELECT 'supplier', s_suppkey, s_name, s_acctbal FROM supplier",
)
def srum_entries(t):
    tables = {
        "nation": t("nation").select(F.col("n_nationkey").cast("long").alias("id"), F.col("n_name").alias("name")),
        "supplier": t("supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), F.col("s_acctbal").alias("balance")),
        "MSysObjects": t("region").select(F.col("r_regionkey").cast("long").alias("id")),
    }
    return srum.entries(tables).select("provider", "id", "name", "balance")


@_query("id_map_last_wins", "SELECT c_nationkey AS IdIndex, arg_max(c_name, c_custkey) AS id_text FROM customer GROUP BY c_nationkey")
def id_map_last_wins(t):
    blob = F.encode(F.concat("c_name", F.lit("\0")), "UTF-16LE")
    rows = t("customer").select(F.col("c_nationkey").alias("IdIndex"), F.lit(0).alias("IdType"), blob.alias("IdBlob"), "c_custkey")
    return srum.id_map(rows, "c_custkey")
