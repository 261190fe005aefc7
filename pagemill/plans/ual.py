"""User access logging: typed records and dated day counts, from its tables as DataFrames."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagemill.functions.values import day_of_year, ip_text, windows_time

#: System tables and time columns.
SYSTEM_TABLES = ("MSysObjects", "MSysObjectsShadow", "MSysObjids", "MSysLocales")
TIMES = ("CreationTime", "FirstSeen", "InsertDate", "LastAccess", "LastSeen")


def day_columns(df: DataFrame) -> list[str]:
    return [c for c in df.columns if re.fullmatch(r"Day\d+", c)]


def typed(df: DataFrame) -> DataFrame:
    """Records with times and addresses as values, and activity_counts: (date, count) of the days that aren't 0 or null.

    The year is LastAccess's; a record without it has no counts. The day columns go.
    """
    days = day_columns(df)
    out = df
    for c in TIMES:
        if c in df.columns and dict(df.dtypes)[c] == "bigint":
            out = out.withColumn(c, windows_time(F.col(c)))
    if "Address" in df.columns:
        out = out.withColumn("Address", ip_text("Address"))
    if days and "LastAccess" in df.columns:
        year = F.year("LastAccess")
        each = F.array(*[F.struct(day_of_year(year, F.lit(int(c[3:]))).alias("date"), F.col(c).cast("long").alias("count")) for c in sorted(days, key=lambda c: int(c[3:]))])
        out = out.withColumn("activity_counts", F.when(F.col("LastAccess").isNotNull(), F.filter(each, lambda x: x["count"] != 0)).otherwise(F.filter(each, lambda x: F.lit(False))))
    return out.drop(*days)


def activity(df: DataFrame, ids: list[str], year: str) -> DataFrame:
    """The long form: (ids, day, date, count) of each day column that isn't 0 or null."""
    days = day_columns(df)
    long = df.unpivot([*ids, year], days, "day", "count").filter("count is not null and count <> 0")
    number = F.substring("day", 4, 10).cast("int")
    return long.select(*ids, number.alias("day"), day_of_year(F.col(year), number).alias("date"), F.col("count").cast("long").alias("count"))
