"""Searches over a table with a declared key: exact, seek, neighbours, ordered iteration, and index choice."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagemill.errors import KeyNotFoundError
from pagemill.sources.shared import cut


def equals(column: Column, value, is_array: bool = False) -> Column:
    """Residual equality: null equals null, an array column holds a scalar or equals a list."""
    if is_array and value is not None and not isinstance(value, (list, tuple)):
        return F.coalesce(F.array_contains(column, value), F.lit(False))
    return column.eqNullSafe(F.array(*map(F.lit, value)) if isinstance(value, (list, tuple)) else F.lit(value))


class KeyedFrame:
    """A DataFrame with an ordered list of key columns; they need not be unique. Every search is one declarative plan.

    Equality and range conditions on the key are plain comparisons, so they reach the scan of a columnar source. Rows
    with equal keys are ordered by `ties`; without ties their order is not defined, and searches return one of them.
    """

    def __init__(self, df: DataFrame, key: Sequence[str], ties: Sequence[str] = ()):
        missing = [c for c in [*key, *ties] if c not in df.columns]
        if missing:
            raise KeyError(f"no such columns: {missing}")
        self.df, self.key, self.order = df, list(key), [*key, *ties]

    def _is_array(self, column: str) -> bool:
        return self.df.schema[column].dataType.typeName() == "array"

    def _match(self, values: dict) -> Column:
        unknown = [c for c in values if c not in self.df.columns]
        if unknown:
            raise KeyError(f"no such columns: {unknown}")
        return reduce(Column.__and__, [self.df[c] == F.lit(v) if c in self.key and v is not None else equals(self.df[c], v, self._is_array(c)) for c, v in values.items()])

    def _beyond(self, values: dict, inclusive: bool, forward: bool) -> Column:
        """The rows at or after (before) a position, which gives a leading part of the order."""
        columns = self.order[: len(values)]
        if set(columns) != set(values):
            raise KeyError(f"a position needs leading columns of {self.order}")
        found = F.lit(inclusive)
        for c in reversed(columns):
            beyond = self.df[c] > F.lit(values[c]) if forward else self.df[c] < F.lit(values[c])
            found = beyond | ((self.df[c] == F.lit(values[c])) & found)
        first = self.df[columns[0]]  # implied, but simple enough to be pushed to the scan
        bound = first >= F.lit(values[columns[0]]) if forward else first <= F.lit(values[columns[0]])
        return bound & found

    def find_all(self, **values) -> DataFrame:
        """All rows that equal the key columns' values (all are needed) and any other columns' values."""
        missing = [c for c in self.key if c not in values]
        if missing:
            raise KeyError(f"the key needs {missing}")
        return self.df.filter(self._match(values))

    def search(self, strict: bool = False, **values) -> DataFrame:
        """The first row of find_all; strict raises KeyNotFoundError where there is none."""
        found = self.find_all(**values).orderBy(*self.order).limit(1)
        if strict and found.isEmpty():
            raise KeyNotFoundError(str(values))
        return found

    find = search

    def seek(self, **values) -> DataFrame:
        """The first row whose key is at or after the values; none past the end."""
        return self.df.filter(self._beyond(values, True, True)).orderBy(*self.order).limit(1)

    def next_of(self, **values) -> DataFrame:
        return self.df.filter(self._beyond(values, False, True)).orderBy(*self.order).limit(1)

    def prev_of(self, **values) -> DataFrame:
        return self.df.filter(self._beyond(values, False, False)).orderBy(*[F.col(c).desc() for c in self.order]).limit(1)

    def neighbours(self, column: str, within: Sequence[str]) -> DataFrame:
        """Every row with prev_<column> and next_<column> in key order among the rows that agree in `within`."""
        w = Window.partitionBy(*within).orderBy(*[c for c in self.order if c not in within])
        return self.df.withColumn(f"prev_{column}", F.lag(column).over(w)).withColumn(f"next_{column}", F.lead(column).over(w))

    def ordered(self, position: str = "position") -> DataFrame:
        """Every row with its position (from 1) in key order.

        A range shuffle sorts each partition; a partition's rows are numbered within it and shifted by the counts
        of the partitions before it, so only one row per partition is ordered as a whole.
        """
        ranged = self.df.repartitionByRange(*self.order).sortWithinPartitions(*self.order)
        placed = cut(ranged.withColumn("_part", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id()))
        counts = placed.groupBy("_part").agg(F.count("*").alias("_n"))
        before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
        shifts = cut(counts.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_shift")))
        # The low 33 bits of the id count a partition's rows from 0.
        row = F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
        return placed.join(shifts, "_part").withColumn(position, (row + F.col("_shift") + 1).cast("long")).drop("_part", "_at", "_shift")

    def resolve(self, index: DataFrame, bookmark: dict[str, str]) -> DataFrame:
        """Rows of this table by the bookmarks of an index's entries: bookmark maps index columns to key columns."""
        on = reduce(Column.__and__, [index[i] == self.df[k] for i, k in bookmark.items()])
        return index.join(self.df, on)


def best_index(indexes: DataFrame, columns: DataFrame | Sequence[str]) -> DataFrame:
    """The index whose leading columns are longest contained in the columns, the first declared on ties.

    indexes has table_name, position, index_name and columns (an array in key order). The result has a row for each
    table with a fit: table_name, index_name and score.
    """
    wanted = F.array(*map(F.lit, columns))
    prefix = F.aggregate(
        "columns",
        F.struct(F.lit(0).alias("n"), F.lit(True).alias("on")),
        lambda a, c: F.struct((a.n + (a.on & F.array_contains(wanted, c)).cast("int")).alias("n"), (a.on & F.array_contains(wanted, c)).alias("on")),
    ).n
    scored = indexes.withColumn("score", prefix).filter("score > 0")
    return scored.groupBy("table_name").agg(F.max_by("index_name", F.struct("score", -F.col("position"))).alias("index_name"), F.max("score").alias("score"))
