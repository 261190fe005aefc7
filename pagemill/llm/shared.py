"""What the operators share: the cluster's shared folder, and checkpoints in it."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: The white space of the text contracts, and A-Z with its lower case.
BLANKS = " \t\n\x0b\f\r"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"


def shared_dir(spark: SparkSession) -> str:
    """The session's checkpoint folder, which all executors see; a temporary one only where none is set."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(spark.conf.get("spark.checkpoint.dir", None) or tempfile.mkdtemp(prefix="pagemill-"))
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """df computed once and kept in the shared folder: later reads survive the loss of any executor."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def table_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder for a written table."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def slices(column, rows: int = 500, most: int = 4 << 20):
    """(first row, rows) of runs of an Arrow column of strings or bytes: up to `rows` and about `most` bytes; a longer value comes alone."""
    at, held = 0, 0
    for i, value in enumerate(column):
        buffer = value.as_buffer()
        size = len(buffer) if buffer is not None else 0
        if i > at and (i - at >= rows or held + size > most):
            yield at, i - at
            at, held = i, 0
        held += size
    if at < len(column):
        yield at, len(column) - at
