"""Line dedup against levelled sorted runs of line hashes; DataFrame functions only.

A run is a written table of (h1, h2, first) sorted by hash: a 128-bit hash of a line's key and the smallest doc_id that
holds it. Documents arrive in batches of ascending doc_id. A batch's keys are merge-anti-joined with the runs, what
remains is new and becomes a run of level 0; when a level has `fanout` runs they are merged into one run of the next.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagemill.llm.shared import BLANKS, LOWER, UPPER, cut, table_path


def line_key(line: Column) -> Column:
    """A line without \\x20 and \\x09-\\x0D at its ends, A-Z in lower case."""
    return F.translate(F.trim(line, F.lit(BLANKS)), UPPER, LOWER)


class LineRuns:
    """The runs of all batches so far. Every run is a table in the shared folder, so a lost executor costs nothing."""

    def __init__(self, spark: SparkSession, fanout: int = 2):
        self.spark, self.fanout, self.levels = spark, fanout, []

    def _write(self, keys: DataFrame) -> DataFrame:
        path = table_path(self.spark, "line-run")
        keys.sortWithinPartitions("h1", "h2").write.parquet(path)
        return self.spark.read.schema(keys.schema).parquet(path)

    def runs(self) -> list[DataFrame]:
        return [run for level in self.levels for run in level]

    def add(self, keys: DataFrame) -> None:
        """Take in a batch's (h1, h2, doc_id) rows, whose doc_id are above those of every batch before."""
        new = keys.groupBy("h1", "h2").agg(F.min("doc_id").alias("first"))
        for run in self.runs():
            new = new.join(run.hint("merge"), ["h1", "h2"], "left_anti")
        self._push(0, self._write(new))

    def _push(self, level: int, run: DataFrame) -> None:
        if level == len(self.levels):
            self.levels.append([])
        self.levels[level].append(run)
        if len(self.levels[level]) >= self.fanout:
            merged = reduce(DataFrame.unionByName, self.levels[level])
            self.levels[level] = []
            self._push(level + 1, self._write(merged.repartition("h1")))

    def firsts(self) -> DataFrame:
        """(h1, h2, first) of every key, each once."""
        return reduce(DataFrame.unionByName, self.runs())


def dedup_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_chars: int = 10, batches: int = 4, fanout: int = 2) -> DataFrame:
    """docs with n_lines, n_dropped and kept, the text without the lines that an earlier document holds.

    Lines are cut at \\n; a null or empty text is one empty line. A line whose key has at least min_chars code points
    loses its place in every document but the smallest doc_id that holds it (there, repeats stay); other lines stay.
    Rows that share a doc_id count as one document; rows without a doc_id keep all their lines and claim none. An
    empty table gives an empty table. Other columns pass through, but for those named n_lines, n_dropped or kept,
    which are replaced.
    """
    spark = docs.sparkSession
    body = F.coalesce(F.col(text), F.lit(""))
    lines = docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(body).alias("th"), F.posexplode(F.split(body, "\n", -1)).alias("pos", "line"))
    keyed = lines.filter("doc_id is not null").select("doc_id", "th", "pos", line_key(F.col("line")).alias("key")).filter(F.length("key") >= min_chars)
    held = cut(keyed.select("doc_id", "th", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), "key").alias("h2")))
    cuts = held.select(F.percentile_approx("doc_id", [k / batches for k in range(1, batches)], 1000).alias("c")).first().c or []
    runs, low = LineRuns(spark, fanout), None
    for high in [*sorted(set(cuts)), None]:
        part = held if low is None else held.filter(F.col("doc_id") > low)
        runs.add(part if high is None else part.filter(F.col("doc_id") <= high))
        low = high
    late = held.join(runs.firsts().hint("merge"), ["h1", "h2"]).filter("doc_id <> first")
    drops = late.groupBy(F.col("doc_id").alias("_doc"), F.col("th").alias("_th")).agg(F.collect_list("pos").alias("_pos"))
    rows = docs.withColumn("_hash", F.xxhash64(body))
    joined = rows.join(drops, (rows[doc_id] == drops._doc) & (rows._hash == drops._th), "left")
    split = F.split(body, "\n", -1)
    none = F.array().cast("array<int>")
    gone = F.array_distinct(F.coalesce("_pos", none))
    stay = F.array_except(F.sequence(F.lit(0), F.size("_lines") - 1), F.col("_gone"))
    return (
        joined.withColumn("_lines", split)
        .withColumn("_gone", gone)
        .withColumn("n_lines", F.size("_lines").cast("long"))
        .withColumn("n_dropped", F.size("_gone").cast("long"))
        .withColumn("kept", F.when(F.size("_gone") == 0, body).otherwise(F.array_join(F.transform(stay, lambda i: F.get("_lines", i)), "\n")))
        .drop("_hash", "_doc", "_th", "_pos", "_lines", "_gone")
    )
