"""Pages, nodes and records of extensible-storage database files, decoded by DataFrame expressions.

A file is read whole by Spark's binaryFile source and cut into pages; everything below that is columns: page headers,
tags, nodes (key, data, child), leaves reached from a root by joins on page numbers, and record fields by the layout
that the catalog gives. No index is rebuilt: searches are filters on the decoded rows.

A Column of bytes is cut with substring and read little-endian by way of its hex digits. Files up to 2 GB.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagemill.errors import InvalidDatabase
from pagemill.functions import values as V
from pagemill.operators import longvalues
from pagemill.sources.shared import cut

#: Fixed values of the format: the header's magic, the catalog's root, page flags and tag flags.
MAGIC, CATALOG_ROOT, MAJOR = 0x89ABCDEF, 4, 9
ROOT, LEAF, PARENT, EMPTY, SPACE_TREE, INDEX, LONG_VALUE = 1, 2, 4, 8, 0x20, 0x40, 0x80
VERSION, DELETED, COMPRESSED = 1, 2, 4
#: Fixed values of the format: the catalog's own columns as (id, name, type code).
CATALOG = (
    (1, "ObjidTable", 4), (2, "Type", 3), (3, "Id", 4), (4, "ColtypOrPgnoFDP", 4), (5, "SpaceUsage", 4), (6, "Flags", 4), (7, "PagesOrLocale", 4),
    (8, "RootFlag", 1), (9, "RecordOffset", 3), (10, "LCMapFlags", 4), (11, "KeyMost", 17), (12, "LVChunkMax", 4), (128, "Name", 10), (129, "Stats", 9),
    (130, "TemplateTable", 10), (131, "DefaultValue", 9), (132, "KeyFldIDs", 9), (133, "VarSegMac", 9), (134, "ConditionalColumns", 9), (135, "TupleLimits", 9),
    (136, "Version", 9), (137, "SortID", 9),
)
SMALL_PAGE = 8192


def u(buf: Column, at: Column | int, size: int) -> Column:
    """The little-endian unsigned integer of `size` bytes (up to 7) at byte offset `at` of buf, as a long."""
    at = F.lit(at) if isinstance(at, int) else at
    h = F.hex(F.substring(buf, at + 1, F.lit(size)))
    return F.conv(F.concat(*[F.substring(h, 2 * i + 1, 2) for i in reversed(range(size))]), 16, 10).cast("long")


def cut_bytes(buf: Column, at: Column, size: Column) -> Column:
    return F.substring(buf, (at + 1).cast("int"), F.greatest(size, F.lit(0)).cast("int"))


def hold(df: DataFrame, **columns: Column) -> DataFrame:
    """df with further columns that later expressions refer to, rather than repeat: a generated row is never inlined."""
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))


def has(flags: Column, mask: int) -> Column:
    return flags.bitwiseAND(F.lit(mask)) != 0


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, size, content) of each file of a path or pattern."""
    return spark.read.format("binaryFile").load(path).select("path", F.col("length").alias("size"), "content")


def headers(files: DataFrame) -> DataFrame:
    """path, size, checksum, magic, version, state, update_major, page_size and valid of each file.

    A page size of 0 stands for 4096; a file is valid if the magic and the major format number fit.
    """
    c = F.col("content")
    size = u(c, 236, 4)
    return files.select(
        "path", "size", u(c, 0, 4).alias("checksum"), u(c, 4, 4).alias("magic"), u(c, 8, 4).alias("version"), u(c, 52, 4).alias("state"),
        u(c, 232, 4).alias("update_major"), F.when(size == 0, 4096).otherwise(size).cast("int").alias("page_size"),
    ).withColumn("valid", (F.col("magic") == MAGIC) & (F.col("update_major") >= MAJOR))


def open_database(spark: SparkSession, path: str) -> DataFrame:
    """headers() of the files; InvalidDatabase if one isn't a database (one number per run comes to the driver)."""
    found = headers(read_files(spark, path))
    if bad := found.filter(~F.coalesce("valid", F.lit(False))).count():
        raise InvalidDatabase(f"{bad} files at {path}")
    return found


def pages(files: DataFrame) -> DataFrame:
    """(path, page_size, pgno, buf) of every logical page from 1; page 1 is the third physical one."""
    sized = files.join(headers(files).filter("valid").select("path", "page_size"), "path")
    n = F.floor(F.col("size") / F.col("page_size")).cast("int") - 2
    numbered = sized.filter(n > 0).select("path", "page_size", "content", F.explode(F.sequence(F.lit(1), n)).alias("pgno"))
    return numbered.select("path", "page_size", "pgno", F.substring("content", (F.col("pgno") + 1) * F.col("page_size") + 1, F.col("page_size")).alias("buf"))


def page_headers(found: DataFrame) -> DataFrame:
    """pages() with prev_page, next_page, owner, flags, reserved_tags, tag_count, node_count and the flags' predicates."""
    b = F.col("buf")
    state = u(b, 34, 2)
    out = hold(found, prev_page=u(b, 16, 4), next_page=u(b, 20, 4), owner=u(b, 24, 4), flags=u(b, 36, 4), _state=state)
    reserved = F.shiftright("_state", 12)
    out = out.withColumn("reserved_tags", F.when(reserved == 0, 1).otherwise(reserved).cast("int")).withColumn("tag_count", F.col("_state").bitwiseAND(F.lit(0xFFF)).cast("int"))
    names = {"is_root": ROOT, "is_leaf": LEAF, "is_parent": PARENT, "is_empty": EMPTY, "is_space_tree": SPACE_TREE, "is_index": INDEX, "is_long_value": LONG_VALUE}
    out = out.withColumn("node_count", F.col("tag_count") - F.col("reserved_tags")).withColumns({n: has(F.col("flags"), m) for n, m in names.items()})
    return out.withColumn("is_branch", ~F.col("is_leaf")).drop("_state")


def tags(headed: DataFrame) -> DataFrame:
    """path, pgno, tag_no, tag_size, tag_offset, tag_flags and data of every tag of page_headers(), slot 0 included."""
    small = F.col("page_size") <= SMALL_PAGE
    numbered = headed.filter("tag_count > 0").withColumn("tag_no", F.explode(F.sequence(F.lit(0), F.col("tag_count") - 1)))
    at = F.col("page_size") - (F.col("tag_no") + 1) * 4
    mask = F.when(small, 0x1FFF).otherwise(0x7FFF)
    raw = hold(numbered, _cb=u(F.col("buf"), at, 2), _ib=u(F.col("buf"), at + 2, 2))
    sized = raw.withColumn("tag_size", F.col("_cb").bitwiseAND(mask)).withColumn("tag_offset", F.col("_ib").bitwiseAND(mask))
    body = hold(sized, data=cut_bytes(F.col("buf"), F.when(small, 40).otherwise(80) + F.col("tag_offset"), F.col("tag_size")))
    second = F.when(F.octet_length("data") >= 2, u(F.col("data"), 1, 1)).otherwise(0)
    return body.withColumn("tag_flags", F.when(small, F.shiftright("_ib", 13)).otherwise(F.shiftright(second.cast("long"), 5))).drop("_cb", "_ib", "buf")


def nodes(headed: DataFrame) -> DataFrame:
    """path, pgno, node_no, is_root, is_leaf, page_size, next_page, key, data, child and is_deleted of every node.

    The key is the stored prefix's part (of slot 0's data, on pages that aren't roots; filled with zeros) and the
    suffix; a branch node's child is the page number in its data. Empty slots give no nodes. The nodes are decoded once,
    into the shared folder, since trees and records read them again and again.
    """
    all_tags = tags(headed)
    prefix = F.when(~F.col("is_root"), F.col("data"))
    prefixes = all_tags.filter("tag_no = 0").select("path", "pgno", prefix.alias("page_prefix"))
    real = all_tags.filter("tag_no >= reserved_tags and tag_size > 0").join(prefixes, ["path", "pgno"])
    d = F.col("data")
    squeezed = has(F.col("tag_flags"), COMPRESSED) & (F.octet_length(d) >= 2)
    prefix_n = F.when(squeezed, u(d, 0, 2).bitwiseAND(F.lit(0x1FFF))).otherwise(0)
    start = F.when(squeezed, 2).otherwise(0)
    shaped = hold(real, _p=prefix_n, _at=start)
    shaped = hold(shaped, _s=F.when(F.octet_length(d) >= F.col("_at") + 2, u(d, F.col("_at"), 2).bitwiseAND(F.lit(0x1FFF))).otherwise(0))
    head = F.rpad(F.hex(cut_bytes(F.coalesce("page_prefix", F.lit("").cast("binary")), F.lit(0), F.col("_p"))), (2 * F.col("_p")).cast("int"), F.lit("0"))
    body = F.col("_at") + 2 + F.col("_s")
    keyed = hold(shaped.withColumnRenamed("data", "_d"), key=F.unhex(F.concat(head, F.hex(cut_bytes(F.col("_d"), F.col("_at") + 2, F.col("_s"))))), data=cut_bytes(F.col("_d"), body, F.octet_length("_d") - body))
    child = F.when(F.col("is_branch") & (F.octet_length("data") >= 4), u(F.col("data"), 0, 4))
    decoded = keyed.select(
        "path", "pgno", (F.col("tag_no") - F.col("reserved_tags")).alias("node_no"), "is_root", "is_leaf", "page_size", "next_page", "key", "data", child.alias("child"), has(F.col("tag_flags"), DELETED).alias("is_deleted")
    )
    return cut(decoded)


def leaf_nodes(found: DataFrame, roots: DataFrame) -> DataFrame:
    """(path, root, key, data, ...) of every leaf node below each root of roots(path, root).

    One join of page numbers per level of the tree; pages that were visited don't come again, so damaged files end.
    """
    links = cut(found.filter("child is not null").select("path", F.col("pgno").alias("parent"), "child").distinct())
    front = roots.select("path", "root", F.col("root").cast("long").alias("page"))
    seen = cut(front)
    front = seen
    while True:
        below = front.join(links, (front.path == links.path) & (front.page == links.parent)).select(front.path, "root", F.col("child").alias("page"))
        front = cut(below.distinct().join(seen, ["path", "root", "page"], "left_anti"))
        if front.isEmpty():
            break
        seen = cut(seen.unionByName(front))
    leaves = found.filter("is_leaf").join(seen.withColumnRenamed("page", "pgno"), ["path", "pgno"])
    return leaves


def fields(rows: DataFrame, layout: Iterable[tuple[int, str, int | None, int | None]], defaults: dict[str, bytes] | None = None) -> DataFrame:
    """rows(data) with each column's stored bytes under its name: (id, name, offset, size) of fixed and variable columns.

    A fixed column is null if its bit is set, a variable one if its end has the high bit; beyond the record's last a
    column has its default's bytes, or null if it has none; a record of under 4 bytes has only nulls.
    """
    d = F.col("data")
    long_enough = F.octet_length(d) >= 4
    head = hold(rows, _fixed=F.when(long_enough, u(d, 0, 1)).otherwise(0), _variable=F.when(long_enough, u(d, 1, 1)).otherwise(127), _end=F.when(long_enough, u(d, 2, 2)).otherwise(0))
    bitmap = F.col("_end") - F.floor((F.col("_fixed") + 7) / 8)
    count = F.greatest(F.col("_variable") - 127, F.lit(0))
    body = F.col("_end") + 2 * count
    out = {}
    for number, name, offset, size in layout:
        default = F.when(long_enough, F.unhex(F.lit(bytes(value).hex()))) if (value := (defaults or {}).get(name)) else F.lit(None).cast("binary")
        if number <= 127:
            null = has(u(d, bitmap + (number - 1) // 8, 1), 1 << ((number - 1) % 8))
            out[name] = F.when(F.col("_fixed") >= number, F.when(~null, cut_bytes(d, F.lit(4 + offset), F.lit(size)))).otherwise(default)
        elif number <= 255:
            i = number - 128
            end = u(d, F.col("_end") + 2 * i, 2)
            begin = u(d, F.col("_end") + 2 * (i - 1), 2).bitwiseAND(F.lit(0x7FFF)) if i else F.lit(0)
            out[name] = F.when(F.col("_variable") >= number, F.when(~has(end, 0x8000), cut_bytes(d, body + begin, end - begin))).otherwise(default)
    if not out:
        return head.drop("_fixed", "_variable", "_end")
    held = hold(head, **{f"_f{i}": c for i, c in enumerate(out.values())})
    return held.withColumns({n: F.col(f"_f{i}") for i, n in enumerate(out)}).drop("_fixed", "_variable", "_end", *[f"_f{i}" for i in range(len(out))])


def tagged_fields(rows: DataFrame, nulls: bool = False) -> DataFrame:
    """rows with (column_id, field_flags, raw) for each tagged field that isn't null, multi-values still packed.

    With nulls, fields that are null come too, with a null raw.

    Offsets are relative to the tagged area; a field ends where the next begins. On small pages bit 0x4000 of the
    offset word announces a flags byte and 0x2000 a null; on large pages the byte is always there.
    """
    d = F.col("data")
    long_enough = F.octet_length(d) >= 4
    count = F.greatest(F.when(long_enough, u(d, 1, 1)).otherwise(127) - 127, F.lit(0))
    end = F.when(long_enough, u(d, 2, 2)).otherwise(0)
    rows = hold(rows, _v=count, _e=end)
    last = F.when(F.col("_v") > 0, u(d, F.col("_e") + 2 * F.col("_v") - 2, 2).bitwiseAND(F.lit(0x7FFF))).otherwise(0)
    rows = hold(rows, _area=F.col("_e") + 2 * F.col("_v") + last).filter(F.octet_length(d) >= F.col("_area") + 4)
    small = F.col("page_size") <= SMALL_PAGE
    mask = F.when(small, 0x1FFF).otherwise(0x7FFF)
    fields_n = (u(d, F.col("_area") + 2, 2).bitwiseAND(mask) / 4).cast("int")
    each = hold(rows, _n=fields_n).filter("_n > 0").withColumn("_i", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)))
    word = u(d, F.col("_area") + 4 * F.col("_i") + 2, 2)
    after = F.when(F.col("_i") + 1 < F.col("_n"), u(d, F.col("_area") + 4 * F.col("_i") + 6, 2).bitwiseAND(mask)).otherwise(F.octet_length(d) - F.col("_area"))
    each = hold(each, column_id=u(d, F.col("_area") + 4 * F.col("_i"), 2).cast("int"), _w=word, _to=after, _from=word.bitwiseAND(mask))
    extra = ~small | has(F.col("_w"), 0x4000)
    each = hold(each, field_flags=F.when(extra, u(d, F.col("_area") + F.col("_from"), 1)).otherwise(0).cast("int"))
    null = F.when(small, has(F.col("_w"), 0x2000)).otherwise(has(F.col("field_flags"), 0x20))
    start = F.col("_from") + F.when(extra, 1).otherwise(0)
    value = cut_bytes(d, F.col("_area") + start, F.col("_to") - start)
    kept = each.withColumn("raw", F.when(~null, value)) if nulls else each.filter(~null).withColumn("raw", value)
    return kept.drop("_v", "_e", "_area", "_n", "_i", "_w", "_to", "_from")


def multi_values(raw: Column, flags: Column) -> Column:
    """The stored values of a tagged field as an array of binary: one, two by a length byte, or many by offsets."""
    first = u(raw, 0, 1)
    two = F.array(cut_bytes(raw, F.lit(1), first), cut_bytes(raw, 1 + first, F.octet_length(raw) - 1 - first))
    n = (u(raw, 0, 2).bitwiseAND(F.lit(0x7FFF)) / 2).cast("int")

    def at(i: Column) -> Column:
        return F.when(i < n, u(raw, 2 * i, 2).bitwiseAND(F.lit(0x7FFF))).otherwise(F.octet_length(raw))

    many = F.transform(F.sequence(F.lit(0), n - 1), lambda i: cut_bytes(raw, at(i), at(i + 1) - at(i)))
    return F.when(has(flags, 0x10), two).when(has(flags, 0x08), many).otherwise(F.array(raw))


def typed(raw: Column, code: int, page: int | None = None) -> Column:
    """A stored value as its type: bits are true only for FF, currency is unscaled, date-times stay raw bits."""
    if code == 1:
        return F.hex(raw) == "FF"
    if code in (2, 14, 17):
        return V.little_endian(raw)
    if code in (3, 4, 5, 8, 15):
        return V.little_endian(raw, signed=True)
    if code in (6, 7):
        return V.floating(raw)
    if code in (10, 12):
        return V.decode_text(page or 20127)(raw)
    if code == 16:
        return V.guid_text(raw)
    return raw


def catalog(found: DataFrame) -> DataFrame:
    """The rows of the catalog of nodes(), typed, one for each table, column, index, long value and callback."""
    from pagemill.operators.catalog import TYPE_SIZES

    roots = found.select("path").distinct().withColumn("root", F.lit(CATALOG_ROOT))
    layout, offset = [], 0
    for number, name, code in CATALOG:
        size = TYPE_SIZES.get(code)
        layout.append((number, name, offset, size))
        offset += size if number <= 127 else 0
    stored = fields(leaf_nodes(found, roots), layout)
    return stored.select("path", "key", *[typed(F.col(name), code, 1252).alias(name) for _, name, code in CATALOG])


def long_values(found: DataFrame, roots: DataFrame) -> DataFrame:
    """(path, root, lid, value) of the values in the long-value trees at roots(path, root), lid as the records hold it.

    A node whose key without its last four bytes, the offset, is a key itself is a chunk of the value of that key, whose
    node holds the value's size; a chunk shorter or longer than its span is compressed.
    """
    leaves = leaf_nodes(found, roots).filter("not is_deleted").select("path", "root", "key", "data")
    n = F.octet_length("key")
    nodes = leaves.withColumns({"lid": F.substring("key", F.lit(1), F.greatest(n - 4, F.lit(0))), "offset": F.conv(F.hex(F.substring("key", F.greatest(n - 3, F.lit(1)), F.lit(4))), 16, 10).cast("long")})
    names = leaves.select("path", "root", F.col("key").alias("lid"), u(F.col("data"), 4, 4).alias("size"))
    chunks = nodes.join(names, ["path", "root", "lid"]).withColumn("value", F.struct("path", "root", "lid"))
    spanned = chunks.select("value", F.col("offset").alias("chunk_offset"), "data", longvalues.expected_span("value", "offset", "size").alias("span"))
    whole = F.octet_length("data") == F.col("span")
    plain = spanned.select("value", "chunk_offset", F.when(whole, F.col("data")).otherwise(V.decompress(F.when(~whole, F.col("data")))).alias("chunk"))
    found_values = longvalues.assemble(plain.withColumnRenamed("value", "of"), "of").select("of.*", "value")
    return found_values.withColumn("lid", F.unhex(F.array_join(F.reverse(F.regexp_extract_all(F.hex("lid"), F.lit("(..)"))), "")))


def tagged_values(leaves: DataFrame, trees: DataFrame | None) -> DataFrame:
    """(path, pgno, node_no, column_id, place, value) of each value of each tagged field, resolved and decompressed.

    trees: long_values() of the table, if it has any. Of a pair of values only the first can be compressed; of more, one
    is separated if its offset is marked. A field that is null comes once, with a null value.
    """
    each = tagged_fields(leaves, nulls=True).select("path", "pgno", "node_no", "column_id", "field_flags", "raw")
    each = hold(each, _all=F.when(F.col("raw").isNotNull(), multi_values(F.col("raw"), F.col("field_flags"))))
    flat = each.select("path", "pgno", "node_no", "column_id", "field_flags", "raw", F.posexplode_outer("_all").alias("place", "value")).fillna(0, ["place"])
    flags = F.col("field_flags")
    marked = has(u(F.col("raw"), 2 * F.col("place"), 2), 0x8000)
    separated = F.when(has(flags, 0x10), False).when(has(flags, 0x08), marked).otherwise(has(flags, 0x04))
    squeezed = has(flags, 0x02) & ~separated & (~has(flags, 0x18) | (F.col("place") == 0))
    flat = flat.withColumns({"_far": F.coalesce(separated, F.lit(False)), "_squeezed": F.coalesce(squeezed, F.lit(False))})
    here = F.when(F.col("_squeezed"), V.decompress(F.when(F.col("_squeezed"), F.col("value")))).when(~F.col("_far"), F.col("value"))
    if trees is None:
        return flat.select("path", "pgno", "node_no", "column_id", "place", here.alias("value"))
    far = trees.select(F.col("path").alias("_path"), F.col("lid").alias("_lid"), F.col("value").alias("_long"))
    joined = flat.join(far, F.col("_far") & (F.col("path") == F.col("_path")) & (F.col("value") == F.col("_lid")), "left")
    return joined.select("path", "pgno", "node_no", "column_id", "place", F.when(F.col("_far"), F.col("_long")).otherwise(here).alias("value"))


def read_table(found: DataFrame, rows: DataFrame, table: str, multi: Iterable[str] = ()) -> DataFrame:
    """A table's records with all columns typed, from nodes() and catalog(): fixed, variable, tagged and long ones.

    Columns beyond a record's last, and tagged ones that it doesn't hold, take their default. A tagged column gives its
    first value, one named in multi an array of all. The layout is metadata: it comes to the driver, one row per column;
    files whose layouts of the table differ raise ValueError. An unknown name raises KeyError.
    """
    from pagemill.operators import catalog as C

    own = rows.filter((F.col("Type") == C.TABLE) & (F.col("Name") == table))
    roots = cut(own.select("path", F.col("ColtypOrPgnoFDP").alias("root"), "ObjidTable"))
    if roots.isEmpty():
        raise KeyError(table)
    layouts: dict[str, list] = {}
    for c in C.columns(rows).filter(F.col("table_name") == table).orderBy("id").collect():
        layouts.setdefault(c.path, []).append(c)
    layout, *others = layouts.values() or [[]]
    if any([c[1:] for c in x] != [c[1:] for c in layout] for x in others):
        raise ValueError(f"files differ in the layout of {table}")
    near, far = [c for c in layout if c.storage != "tagged"], [c for c in layout if c.storage == "tagged"]
    defaults = {c.name: c.default_value for c in near if c.default_value}
    leaves = leaf_nodes(found, roots.select("path", "root"))
    out = fields(leaves, [(c.id, c.name, c.offset, c["size"]) for c in near], defaults)
    kept = [typed(F.col(f"`{c.name}`"), c.type_code, c.code_page).alias(c.name) for c in near]
    if not far:
        return out.select("path", "key", *kept)
    long_roots = rows.filter(F.col("Type") == C.LONG_VALUE).join(roots.select("path", "ObjidTable"), ["path", "ObjidTable"], "left_semi").select("path", F.col("ColtypOrPgnoFDP").alias("root"))
    values = tagged_values(leaves, None if long_roots.isEmpty() else long_values(found, long_roots))
    kinds = {(c.type_code, c.code_page if c.type_code in (10, 12) else None) for c in far}
    name = lambda code, page: f"_t{code}_{page}"
    values = cut(values.withColumns({name(*k): typed(F.col("value"), *k) for k in kinds}))
    whole = []
    for i, c in enumerate(far):
        t = F.col(name(c.type_code, c.code_page if c.type_code in (10, 12) else None))
        mine = F.col("column_id") == c.id
        listed = F.sort_array(F.collect_list(F.when(mine & F.col("value").isNotNull(), F.struct("place", t.alias("v")))))
        whole += [F.transform(listed, lambda x: x.v).alias(f"_v{i}"), F.max(F.when(mine, 1)).alias(f"_h{i}")]
    record = ["path", "pgno", "node_no"]
    joined = out.join(values.groupBy(*record).agg(*whole), record, "left")
    for i, c in enumerate(far):
        default = F.array(typed(F.unhex(F.lit(bytes(c.default_value).hex())), c.type_code, c.code_page)) if c.default_value else None
        every = F.when(F.col(f"_h{i}") == 1, F.when(F.size(f"_v{i}") > 0, F.col(f"_v{i}")))
        every = every.otherwise(default) if default is not None else every
        kept.append((every if c.name in multi else F.get(every, F.lit(0))).alias(c.name))
    return joined.select("path", "key", *kept)
