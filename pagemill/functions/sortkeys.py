"""Unicode sort keys with an injected weight table, and collation for ordering only."""

from __future__ import annotations

from collections.abc import Mapping

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

#: Fixed values of the key's layout: between levels, and at the end.
LEVEL, END = b"\x01", b"\x00"


def sort_key(weights: Mapping[str, tuple[bytes, int, int]], ignore_case: bool = False, ignore_marks: bool = False):
    """A pandas UDF from text to its sort key: primary weights, then diacritic and case weights without trailing twos.

    weights maps a character to (primary bytes, diacritic, case). The table isn't part of this package: results equal a
    given system's only with that system's weights. A character without weights raises KeyError.
    """

    def trimmed(level: list[int]) -> bytes:
        while level and level[-1] <= 2:
            level.pop()
        return bytes(level)

    def one(value: str | None) -> bytes | None:
        if value is None:
            return None
        found = [weights[c] for c in value]
        marks = b"" if ignore_marks else trimmed([d for _, d, _ in found])
        cases = b"" if ignore_case else trimmed([c for _, _, c in found])
        return b"".join(p for p, _, _ in found) + LEVEL + marks + LEVEL + cases + LEVEL + LEVEL + END

    @F.pandas_udf(BinaryType())
    def key(values: pd.Series) -> pd.Series:
        return values.map(one, na_action="ignore")

    return key


def collated(value: Column, ignore_case: bool = True) -> Column:
    """value under a Unicode collation: compares and orders as text does, without a key to store."""
    return F.collate(value, "UNICODE_CI" if ignore_case else "UNICODE")
