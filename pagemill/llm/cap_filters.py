"""Embedding near-duplicates by spherical-cap filters.

A filter is a direction, the sum of one codeword from each block of a random product code on the rotated coordinates. A
vector passes the filters whose score exceeds a threshold; they are listed by a decoder that drops partial sums that
can't reach it. Vectors that share a filter are compared in double precision. A pair that shares several is counted in
the first of them only. Identical vectors are compared as one.
"""

from __future__ import annotations

from collections.abc import Iterator
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagemill.llm.components import connected_components
from pagemill.llm.shared import cut
from pagemill.llm.simhash import _Sets

BLOCKS, SEED = 3, 42


class ProductCode:
    """BLOCKS blocks of `words` random unit codewords each, on randomly rotated coordinates."""

    def __init__(self, dim: int, words: int, seed: int = SEED):
        rng = np.random.default_rng([seed, dim, words])
        self.rotation = np.linalg.qr(rng.standard_normal((dim, dim)))[0]
        self.cuts = np.linspace(0, dim, min(BLOCKS, dim) + 1).astype(int)
        self.words, self.scale = words, np.sqrt(dim / (len(self.cuts) - 1))
        self.codes = []
        for a, b in zip(self.cuts[:-1], self.cuts[1:], strict=True):
            c = rng.standard_normal((words, b - a))
            self.codes.append(c / np.linalg.norm(c, axis=1, keepdims=True))

    def decode(self, unit: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
        """(row, filter) of all filters whose score reaches the threshold, in units of a random direction's deviation."""
        x = unit @ self.rotation
        scores = [x[:, a:b] @ c.T * self.scale for a, b, c in zip(self.cuts[:-1], self.cuts[1:], self.codes, strict=True)]
        best = np.cumsum([s.max(1) for s in scores[::-1]], 0)[::-1]  # what the blocks from each one on can add
        row, code, total = np.arange(len(x)), np.zeros(len(x), np.int64), np.zeros(len(x))
        for k, s in enumerate(scores):
            rest = best[k + 1][row] if k + 1 < len(scores) else 0
            sums = total[:, None] + s[row]
            i, j = np.nonzero(sums >= (threshold - rest)[:, None] if k + 1 < len(scores) else sums >= threshold)
            row, code, total = row[i], code[i] * self.words + j, sums[i, j]
        return row, code


def filters(unit: np.ndarray, code: ProductCode, threshold: float, least: int) -> list[np.ndarray]:
    """The filters of each row, ascending; the threshold sinks for rows with fewer than `least` until they have them."""
    out: list[np.ndarray] = [np.empty(0, np.int64)] * len(unit)
    todo = np.arange(len(unit))
    while len(todo):
        row, found = code.decode(unit[todo], threshold)
        n = np.bincount(row, minlength=len(todo))
        order = np.lexsort((found, row))
        for i, part in enumerate(np.split(found[order], np.cumsum(n)[:-1])):
            out[todo[i]] = part
        few = n < min(least, code.words ** len(code.codes))
        todo, threshold = todo[few], threshold - 0.25
    return out


def _route(rows: DataFrame, words: int, passed: float, least: int) -> DataFrame:
    """A row (label, rep, copies, vector, filters) for each distinct vector, vector as doubles of length one."""
    threshold = NormalDist().inv_cdf(1 - min(0.5, passed / words**BLOCKS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes: dict[int, ProductCode] = {}
        for b in batches:
            for at in range(0, b.num_rows, 512):
                part = b.slice(at, 512)
                vectors = [np.asarray(v.values, np.float64) for v in part.column(part.num_columns - 1)]
                lists: list[np.ndarray] = [np.empty(0, np.int64)] * len(vectors)
                units = [v / np.abs(v).max() for v in vectors]
                units = [v / np.linalg.norm(v) for v in units]
                for dim in {len(v) for v in vectors}:
                    own = [i for i, v in enumerate(vectors) if len(v) == dim]
                    code = codes.setdefault(dim, ProductCode(dim, words))
                    for i, f in zip(own, filters(np.stack([units[i] for i in own]), code, threshold, least), strict=True):
                        lists[i] = f
                yield pa.RecordBatch.from_arrays(
                    [*part.columns[:-1], pa.array([u.tobytes() for u in units], pa.binary()), pa.array(lists, pa.list_(pa.int64()))],
                    ["label", "rep", "copies", "dim", "unit", "filters"],
                )

    return rows.mapInArrow(run, "label bigint, rep bigint, copies bigint, dim int, unit binary, filters array<bigint>")


def _shared_before(lists: list[np.ndarray], at: int) -> np.ndarray:
    """Which pairs of rows share a filter before `at`."""
    before = [f[: np.searchsorted(f, at)] for f in lists]
    _, column = np.unique(np.concatenate(before), return_inverse=True)
    held = np.zeros((len(lists), int(column.max(initial=-1)) + 1), np.float32)
    held[np.repeat(np.arange(len(lists)), [len(f) for f in before]), column] = 1
    return held @ held.T > 0


def _search(least_cosine: float):
    def run(group: pa.Table) -> pa.Table:
        """For each bucket (or pair of its blocks): every vector's links that are first shared here, and spanning links."""
        group = group.combine_chunks()
        cols = {c: np.asarray(group.column(c)) for c in ("label", "dim", "filter", "lo", "hi", "block", "rep", "copies")}
        order = np.lexsort((cols["rep"], cols["hi"], cols["lo"], cols["filter"], cols["dim"], cols["label"]))
        key = np.stack([cols[c][order] for c in ("label", "dim", "filter", "lo", "hi")], 1)
        edges = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]).any(1), [True]])) if len(key) else np.empty(0, int)
        units, lists = group.column("unit"), group.column("filters")
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for a, b in zip(edges[:-1], edges[1:], strict=False):
            if b - a < 2:
                continue
            rows = order[a:b]
            x = np.stack([np.frombuffer(units[int(i)].as_py(), np.float64) for i in rows])
            near = x @ x.T >= least_cosine
            block = cols["block"][rows]
            if key[a, 3] != key[a, 4]:
                near &= block[:, None] != block[None, :]
            np.fill_diagonal(near, False)
            if not near.any():
                continue
            near &= ~_shared_before([np.asarray(lists[int(i)].values) for i in rows], int(key[a, 2]))
            links = near @ cols["copies"][rows]
            sets = _Sets(len(rows))
            sets.join(*np.nonzero(np.triu(near)))
            rep = cols["rep"][rows]
            some = links > 0
            out.append((rep[some], links[some], rep[sets.label[some]]))
        got = [np.concatenate(c) if out else np.empty(0, np.int64) for c in (zip(*out, strict=True) if out else ((), (), ()))]
        return pa.table({n: pa.array(c, pa.int64()) for n, c in zip(("rep", "links", "root"), got, strict=True)})

    return run


def near_duplicates(
    vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label", cosine: float = 0.98, passed: float = 24.0, least: int = 12, bucket: int = 2048
) -> DataFrame:
    """vec_id, n_links, component_id and kept of every row: links between rows of equal labels with at least the cosine.

    passed is the mean number of filters of a random vector, least the fewest of any; both rule the share of links found
    (over 0.999 of those at the least cosine, see the tests). Filters grow in number with the table, so that buckets
    don't; a bucket of more than `bucket` vectors is compared in pairs of blocks, each in its own group. Vectors that
    are null, empty, zero, or hold null or non-finite components, and rows without a label, link with nothing; so do
    vectors of different lengths. Rows without a vec_id link like others, but can't name a component. Repeated rows
    are links of each other. Other columns are not read; an empty table gives an empty table.
    """
    e = F.col(embedding)
    sound = F.col(label).isNotNull() & (F.size(e) > 0) & F.forall(e, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists(e, lambda v: v != 0)
    keyed = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(label).cast("long").alias("label"), e.alias("e"), F.coalesce(sound, F.lit(False)).alias("sound"))
    keyed = keyed.withColumns({"h1": F.xxhash64("e"), "h2": F.xxhash64(F.lit(1), "e")})
    ids = cut(keyed.select("vec_id", "label", "sound", "h1", "h2"))
    distinct = cut(keyed.filter("sound").groupBy("label", "h1", "h2").agg(F.min("vec_id").alias("least_id"), F.count("*").alias("copies"), F.first("e").alias("e")))
    distinct = distinct.withColumn("rep", F.coalesce("least_id", -F.abs("h1") - 1))
    n = distinct.count()
    words = max(12, round((n * passed / 64) ** (1 / BLOCKS)))
    listed = cut(_route(distinct.select("label", "rep", "copies", F.size("e").alias("dim"), "e"), words, passed, least))
    passing = listed.withColumn("filter", F.explode("filters"))
    sizes = passing.groupBy("label", "dim", "filter").agg(F.count("*").alias("rows"))
    large = cut(sizes.filter(F.col("rows") > bucket).withColumn("blocks", F.ceil(F.col("rows") / bucket).cast("int")).drop("rows"))
    few = large.count() <= 10_000
    joined = passing.join(F.broadcast(large) if few else large, ["label", "dim", "filter"], "left")
    blocks = F.coalesce("blocks", F.lit(1))
    own = joined.withColumn("block", F.pmod(F.xxhash64("rep"), blocks).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    paired = own.select("label", "dim", "filter", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"), "block", "rep", "copies", "unit", "filters")
    groups = max(1, round(n * passed / 4096))
    spread = paired.withColumn("bin", F.pmod(F.xxhash64("label", "dim", "filter", "lo", "hi"), F.lit(groups)))
    found = cut(spread.groupBy("bin").applyInArrow(_search(cosine), "rep bigint, links bigint, root bigint"))
    counts = found.groupBy("rep").agg(F.sum("links").alias("links"))
    reached = connected_components(found, "rep", "root")
    classes = distinct.select("label", "h1", "h2", "rep", "least_id", "copies").join(counts, "rep", "left").join(reached, F.col("rep") == F.col("node"), "left")
    # A component whose smallest node stands for rows without ids takes the smallest real id instead.
    named = classes.withColumn("root", F.coalesce("component", "rep"))
    names = named.groupBy("root").agg(F.min("least_id").alias("name"))
    known = cut(named.join(names, "root").select(F.col("label").alias("l"), F.col("h1").alias("k1"), F.col("h2").alias("k2"), "name", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n")))
    rows = ids.join(known, F.col("sound") & (F.col("label") == F.col("l")) & (F.col("h1") == F.col("k1")) & (F.col("h2") == F.col("k2")), "left")
    component = F.when(F.col("n").isNotNull(), F.col("name")).otherwise(F.col("vec_id"))
    return rows.select("vec_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))
