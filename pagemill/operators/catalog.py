"""The catalog of a database as relations: tables, columns and indexes from one stream of typed rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Kinds of catalog rows, column ids' classes, and sizes of the fixed column types by code.
TABLE, COLUMN, INDEX, LONG_VALUE, CALLBACK = 1, 2, 3, 4, 5
FIXED_UP_TO, VARIABLE_UP_TO = 127, 255
TYPE_NAMES = {
    0: "Nil", 1: "Bit", 2: "UnsignedByte", 3: "Short", 4: "Long", 5: "Currency", 6: "IEEESingle", 7: "IEEEDouble", 8: "DateTime",
    9: "Binary", 10: "Text", 11: "LongBinary", 12: "LongText", 13: "SLV", 14: "UnsignedLong", 15: "LongLong", 16: "GUID", 17: "UnsignedShort",
}
TYPE_SIZES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 6: 4, 7: 8, 8: 8, 14: 4, 15: 8, 16: 16, 17: 2}
PRIMARY = 0x20


def file_of(rows: DataFrame) -> list[str]:
    """The column that tells the rows' files apart, where there is one: every key of the catalog begins with it."""
    return [c for c in ("path",) if c in rows.columns]


def attach(rows: DataFrame, group: str = "ObjidTable") -> DataFrame:
    """Every column, index and long-value row with table_name, the name of the table row of its group (in its file)."""
    keys = [*file_of(rows), group]
    names = rows.filter(F.col("Type") == TABLE).groupBy(*keys).agg(F.max_by("Name", "Id").alias("table_name"))
    return rows.filter(F.col("Type") != TABLE).join(names, keys)


def fold(rows: DataFrame, order: str, kind: str, name: str, within: str) -> DataFrame:
    """Rows with the name of the last table row (kind 1) at or before them in order, among rows that agree in within."""
    w = Window.partitionBy(within).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return rows.withColumn("table_name", F.last(F.when(F.col(kind) == TABLE, F.col(name)), ignorenulls=True).over(w))


def lookup(numbers: dict[int, object], code: str):
    return F.element_at(F.create_map(*[F.lit(x) for pair in numbers.items() for x in pair]), F.col(code))


def columns(rows: DataFrame) -> DataFrame:
    """path (if rows have one), table_name, id, name, type, storage, size, offset, code page and default of every column row.

    A fixed column's offset is the sum of the sizes of the fixed columns before it; a size in SpaceUsage counts more
    than its type's. An empty default is none.
    """
    own = attach(rows).filter(F.col("Type") == COLUMN)
    storage = F.when(F.col("Id") <= FIXED_UP_TO, "fixed").when(F.col("Id") <= VARIABLE_UP_TO, "variable").otherwise("tagged")
    size = F.when(F.coalesce("SpaceUsage", F.lit(0)) != 0, F.col("SpaceUsage")).otherwise(lookup(TYPE_SIZES, "ColtypOrPgnoFDP"))
    w = Window.partitionBy(*file_of(rows), "ObjidTable", F.col("Id") <= FIXED_UP_TO).orderBy("Id").rowsBetween(Window.unboundedPreceding, -1)
    return own.withColumn("size", size).select(
        *file_of(rows),
        "table_name",
        F.col("Id").alias("id"),
        F.col("Name").alias("name"),
        lookup(TYPE_NAMES, "ColtypOrPgnoFDP").alias("type"),
        F.col("ColtypOrPgnoFDP").alias("type_code"),
        storage.alias("storage"),
        "size",
        F.when(F.col("Id") <= FIXED_UP_TO, F.coalesce(F.sum("size").over(w), F.lit(0))).alias("offset"),
        F.col("PagesOrLocale").alias("code_page"),
        F.when(F.octet_length("DefaultValue") > 0, F.col("DefaultValue")).alias("default_value"),
    )


def indexes(rows: DataFrame) -> DataFrame:
    """path (if rows have one), table_name, position, index_name, root page, is_primary and the key columns (ids and names) of every index row.

    KeyFldIDs repeats (u16 flags, u16 column id); a length that isn't a multiple of 4 gives no columns.
    """
    own = attach(rows).filter(F.col("Type") == INDEX)
    h = F.hex("KeyFldIDs")

    def column_id(i):
        at = i * 8 + 5
        return F.conv(F.concat(h.substr(at + 2, F.lit(2)), h.substr(at, F.lit(2))), 16, 10).cast("int")

    n = F.coalesce(F.octet_length("KeyFldIDs"), F.lit(0))
    ids = F.when((n > 0) & (n % 4 == 0), F.transform(F.sequence(F.lit(0), (n / 4).cast("int") - 1), column_id)).otherwise(F.array().cast("array<int>"))
    table = [*file_of(rows), "table_name"]
    known = columns(rows).select(*table, F.col("id").alias("column_id"), F.col("name").alias("column_name"))
    flat = own.withColumn("position", F.row_number().over(Window.partitionBy(*file_of(rows), "ObjidTable").orderBy("Id"))).withColumn("ids", ids)
    named = flat.select(*table, "Id", F.posexplode("ids").alias("k", "column_id")).join(known, [*table, "column_id"])
    keys = named.groupBy(*table, "Id").agg(F.transform(F.sort_array(F.collect_list(F.struct("k", "column_name"))), lambda x: x.column_name).alias("columns"))
    flags = F.col("Flags").bitwiseAND(F.lit(PRIMARY)) != 0
    return flat.join(keys, [*table, "Id"], "left").select(*table, "position", F.col("Name").alias("index_name"), F.col("ColtypOrPgnoFDP").alias("root_page"), flags.alias("is_primary"), F.col("ids").alias("column_ids"), F.coalesce("columns", F.array().cast("array<string>")).alias("columns"))


def primary_index(found: DataFrame) -> DataFrame:
    """The first primary index of each table of indexes()."""
    return found.filter("is_primary").groupBy(*file_of(found), "table_name").agg(F.min_by("index_name", "position").alias("index_name"))
