"""Mixing sources to target weights by a splitting tree over source blocks; DataFrame functions only.

Each source's documents are dealt into blocks of about equal words by a hash of their id, a random permutation that
reruns repeat. A source whose target is r times its size has a quota of floor(r) times all its blocks and of a part of
them once more. The tree splits the quotas among output shards: at each node the left half's count of every source is a
hypergeometric draw, given the counts of the sources before it. A shard draws as many of the next blocks of each source's
permutation as its quota says, so shards are disjoint and what no quota reaches isn't drawn; of the block at the end of a
source's quota only the documents before its target are. Rows of a shard are ordered by a hash.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagemill.llm.shared import cut

#: The weights of the sources in code point order, repeating.
WEIGHTS = (3, 1, 2)
#: A table with a row per source is broadcast only up to so many rows.
BROADCAST_ROWS = 10_000
#: Words of an output shard, about, and blocks that it is made of; sources that a node of the tree splits in one row.
SHARD_WORDS, SHARD_BLOCKS, NODE_SOURCES = 4_000_000, 64, 64
WORD = r"[^\x20\x09-\x0D]+"


def source_targets(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """(source, source_size, target) of sized(source, size).

    Sources in code point order, null last, take the weights in turn and share `share` of all sizes by weight; what
    exceeds cap times a source's size is shared again by weight among the others. Filled in closed form: in ascending
    order of cap * size / weight, a source is full while its level is below that of what is left. One row per source
    is the only thing that is ordered as a whole.
    """
    sums = sized.groupBy("source").agg(F.sum("size").cast("long").alias("source_size"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int"))
    ranked = sums.withColumn("w", weight).withColumn("most", F.lit(cap) * F.col("source_size")).withColumn("level", F.col("most") / F.col("w"))
    before = Window.orderBy("level", F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    left = F.lit(share) * F.sum("source_size").over(whole) - F.coalesce(F.sum("most").over(before), F.lit(0.0))
    open_w = F.sum("w").over(whole) - F.coalesce(F.sum("w").over(before), F.lit(0.0))
    filled = ranked.withColumn("water", left / open_w).withColumn("full", F.col("level") <= F.col("water"))
    water = F.max(F.when(~F.col("full"), F.col("water"))).over(whole)  # that of the first that is not full
    return filled.select("source", "source_size", F.when(F.col("full"), F.col("most")).otherwise(F.col("w") * water).alias("target"))


def let(value: Column, body) -> Column:
    """body(value) with value computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def hypergeometric(k: Column, n: Column, total: Column, u: Column) -> Column:
    """A draw: how many of k marked among total are in a sample of n, by inverting the distribution at u in [0, 1).

    Weights follow from that of the mode, 1, by the ratios of neighbours; they are summed from the mode upwards, then
    downwards, as far as 12 deviations (at least 40 counts) from it, beyond which no double differs. The draw is the
    count at which the running sum passes u's part of the whole.
    """
    low, high = F.greatest(F.lit(0), n + k - total).cast("int"), F.least(k, n).cast("int")
    share = k / F.greatest(total, F.lit(1))
    mode = F.least(F.greatest(F.floor((k + 1.0) * (n + 1.0) / (total + 2.0)).cast("int"), low), high)
    reach = (F.lit(40) + 12 * F.sqrt(n * share * (1 - share))).cast("int")

    def up(i: Column) -> Column:
        """The weight of i + 1 over that of i."""
        return ((k - i) * (n - i)) / ((i + 1.0) * (total - k - n + i + 1))

    def walk(steps: Column, ratio, start: Column, mark: Column | None) -> Column:
        """(weight, sum, steps whose sums the mark has passed) after all steps outwards from the mode."""

        def step(a: Column, i: Column) -> Column:
            return let(a.w * ratio(i), lambda w: F.struct(w.alias("w"), (a.sum + w).alias("sum"), (a.n + F.when(mark >= a.sum + w, 1).otherwise(0) if mark is not None else a.n).alias("n")))

        return F.aggregate(steps, F.struct(F.lit(1.0).alias("w"), start.alias("sum"), F.lit(0).alias("n")), step)

    none = F.array().cast("array<int>")
    above = F.when(high > mode, F.sequence(mode, F.least(high, mode + reach) - 1)).otherwise(none)
    below = F.when(low < mode, F.sequence(mode, F.greatest(low, mode - reach) + 1, F.lit(-1))).otherwise(none)
    down = lambda i: 1 / up(i - 1)
    sums = F.struct(walk(above, up, F.lit(1.0), None).sum.alias("upper"), walk(below, down, F.lit(0.0), None).sum.alias("lower"))

    def draw(s: Column) -> Column:
        mark = u * (s.upper + s.lower)
        over = mode + 1 + F.least(walk(above, up, F.lit(1.0), mark).n, F.size(above) - 1)
        under = mode - 1 - F.least(walk(below, down, s.upper, mark).n, F.size(below) - 1)
        return F.when((mark < 1) | (high == low), mode).when((mark < s.upper) | (F.size(below) == 0), over).otherwise(under)

    return let(sums, draw).cast("int")


def split_quotas(quotas: DataFrame, depth: int, seed: int) -> DataFrame:
    """(source, shard, quota) from quotas(source, quota): exact counts of each source's drawn blocks for 2**depth shards.

    The tree's nodes hold one count per source in one row; a level turns each node into two. Above NODE_SOURCES sources,
    the sums of groups of sources are split first, and then each group by its own tree to the counts of its shards.
    """
    ranked = quotas.select("source", F.col("quota").cast("int").alias("q"), (F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1).alias("rank"))
    member = F.struct("rank", "source", "q")
    if quotas.count() <= NODE_SOURCES:
        node = ranked.groupBy().agg(F.sort_array(F.collect_list(member)).alias("qs")).withColumns({"shard": F.lit(0), "parts": F.lit(None).cast("array<int>")})
    else:
        ranked = cut(ranked.withColumn("group", F.floor(F.col("rank") / NODE_SOURCES).cast("int")))
        sums = cut(split_quotas(ranked.groupBy(F.col("group").alias("source")).agg(F.sum("q").alias("quota")), depth, seed + 1))
        parts = sums.groupBy(F.col("source").alias("group")).agg(F.transform(F.sort_array(F.collect_list(F.struct("shard", "quota"))), lambda x: x.quota).alias("parts"))
        node = ranked.groupBy("group").agg(F.sort_array(F.collect_list(member)).alias("qs")).join(parts, "group").select("qs", F.lit(0).alias("shard"), "parts")
    total = lambda xs, of: F.aggregate(xs, F.lit(0), lambda a, x: a + of(x))
    for level in range(depth):
        half = 1 << depth - level - 1
        size, known = total("qs", lambda x: x.q), total(F.slice("parts", 1, half), lambda x: x)
        unit = lambda x: F.pmod(F.xxhash64(F.lit(seed), F.lit(level), "shard", x.source, x.rank), F.lit(1 << 30)) / float(1 << 30)  # noqa: B023, E731
        start = F.struct(size.alias("total"), F.coalesce(known, F.floor((size + F.lit(1)) / 2)).cast("int").alias("n"), F.array().cast("array<int>").alias("out"))

        def draw(a: Column, x: Column) -> Column:
            got = hypergeometric(x.q, a.n, a.total, unit(x))  # noqa: B023
            return let(got, lambda g: F.struct((a.total - x.q).alias("total"), (a.n - g).alias("n"), F.concat(a.out, F.array(g)).alias("out")))

        halves = cut(node.withColumn("got", F.aggregate("qs", start, draw).out))
        left = F.zip_with("qs", "got", lambda x, g: F.struct(x["rank"].alias("rank"), x.source.alias("source"), g.alias("q")))
        right = F.zip_with("qs", "got", lambda x, g: F.struct(x["rank"].alias("rank"), x.source.alias("source"), (x.q - g).alias("q")))
        parts = F.slice("parts", F.col("side") * half + 1, F.lit(half))
        node = halves.select(F.posexplode(F.array(left, right)).alias("side", "qs"), "shard", "parts").select("qs", (F.col("shard") * 2 + F.col("side")).alias("shard"), parts.alias("parts"))
    return node.select("shard", F.explode("qs").alias("x")).select("x.source", "shard", F.col("x.q").alias("quota"))


def plan_mix(docs: DataFrame, doc_id: str = "doc_id", source: str = "source", text: str = "text", weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, cap: float = 2.0, depth: int | None = None, seed: int = 42) -> DataFrame:
    """doc_id, source, size, source_size, target and draws of every row of docs.

    size is the number of words of the whole text (null: 0); draws lists the row's draws as (epoch, block, shard), none
    for a row that the mix leaves out. The mix has 2**depth shards, of about SHARD_WORDS words unless depth is given.
    Rows are told apart by doc_id, so rows that repeat one are drawn together; null is an id and a source like any
    other. A source without words has target 0 and no draws; an empty table gives an empty table. Other columns are not
    read.
    """
    size = F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")
    h = F.xxhash64(F.lit(seed), F.col(doc_id))
    sized = cut(docs.select(F.col(doc_id).alias("doc_id"), F.col(source).cast("string").alias("source"), size.alias("size"), h.alias("h")))
    targets = cut(source_targets(sized, weights, share, cap))
    whole = targets.agg(F.count("*").alias("n"), F.coalesce(F.sum("target"), F.lit(0.0)).alias("words")).first()
    depth = max(0, math.ceil(whole.words / SHARD_WORDS) - 1).bit_length() if depth is None else depth
    block_words = max(1.0, whole.words / (SHARD_BLOCKS << depth))
    # Tables with a row per source, and those with a row per block, are broadcast up to a checked number of rows.
    few = whole.n <= BROADCAST_ROWS

    def with_source(rows: DataFrame, per_source: DataFrame, how: str = "inner") -> DataFrame:
        right = per_source.withColumnRenamed("source", "_s")
        return rows.join(F.broadcast(right) if few else right, rows["source"].eqNullSafe(right["_s"]), how).drop("_s")

    need = targets.withColumn("blocks", F.greatest(F.ceil(F.col("source_size") / block_words), F.lit(1)).cast("int"))
    need = need.withColumn("passes", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("int"))
    need = cut(need.withColumn("rest", F.col("target") - F.col("passes") * F.col("source_size")))
    # Digits of the hash: block, sub-block, and the rest; the prefix before the cut is found digit by digit.
    dealt = with_source(sized, need.select("source", "blocks")).withColumn("block", F.pmod("h", "blocks").cast("int")).withColumn("sub", F.pmod(F.shiftright("h", 40), F.lit(256)).cast("int"))

    def edge_of(sums: DataFrame, digit: str) -> DataFrame:
        """(source, digit, rest) of the bin at which a source's rest is reached, with the rest inside it."""
        order = Window.partitionBy("source").orderBy(digit).rowsBetween(Window.unboundedPreceding, -1)
        run = sums.withColumn("done", F.coalesce(F.sum("words").over(order), F.lit(0)))
        at = run.filter((F.col("done") < F.col("rest")) & (F.col("done") + F.col("words") >= F.col("rest")))
        return cut(at.select("source", F.col(digit).alias(f"edge_{digit}"), (F.col("rest") - F.col("done")).alias("rest")))

    by_block = dealt.groupBy("source", "block").agg(F.sum("size").alias("words"))
    block = edge_of(with_source(by_block, need.select("source", "rest")), "block")
    inside = cut(with_source(dealt, block).filter("block = edge_block"))
    sub = edge_of(inside.groupBy("source", "sub", "rest").agg(F.sum("size").alias("words")), "sub")
    last = with_source(inside.drop("rest"), sub).filter("sub = edge_sub").groupBy("source", "h", "rest").agg(F.sum("size").alias("words"))
    order = Window.partitionBy("source").orderBy("h").rowsBetween(Window.unboundedPreceding, -1)
    ran = last.withColumn("done", F.coalesce(F.sum("words").over(order), F.lit(0))).filter("done + words / 2 <= rest")
    final = cut(ran.groupBy("source").agg(F.max("h").alias("edge_h")))
    edges = cut(with_source(with_source(with_source(need.drop("rest"), block.drop("rest"), "left"), sub.drop("rest"), "left"), final, "left"))
    # The quotas: every whole pass draws all blocks, a part of a pass those up to its cut. The shards' shares of them
    # are the next blocks of the source's permutation, pass after pass.
    quotas = edges.select("source", (F.col("passes") * F.col("blocks") + F.coalesce(F.col("edge_block") + 1, F.lit(0))).alias("quota"))
    upto = Window.partitionBy("source").orderBy("shard").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    shares = split_quotas(quotas, depth, seed).filter("quota > 0").withColumn("upto", F.sum("quota").over(upto))
    each = with_source(shares, edges.select("source", "blocks")).select("source", "blocks", "shard", F.explode(F.sequence(F.col("upto") - F.col("quota"), F.col("upto") - 1)).alias("place"))
    epoch = F.floor(F.col("place") / F.col("blocks")).cast("int").alias("epoch")
    drawn = each.select("source", "shard", epoch, (F.col("place") % F.col("blocks")).cast("int").alias("block"))
    drawn = cut(drawn.groupBy("source", "block").agg(F.sort_array(F.collect_list(F.struct("epoch", "block", "shard"))).alias("all_draws")))
    blocks = drawn.select(F.col("source").alias("_s"), F.col("block").alias("_b"), "all_draws")
    known = with_source(dealt.drop("blocks"), edges)
    known = known.join(F.broadcast(blocks) if drawn.count() <= BROADCAST_ROWS else blocks, known["source"].eqNullSafe(blocks["_s"]) & (known["block"] == blocks["_b"]), "left")
    here = (F.col("sub") < F.col("edge_sub")) | ((F.col("sub") == F.col("edge_sub")) & (F.col("h") <= F.col("edge_h")))
    beyond = (F.col("block") == F.col("edge_block")) & ~F.coalesce(here, F.lit(False))  # in the last block, after the cut
    some = F.when(F.coalesce(beyond, F.lit(False)), F.filter("all_draws", lambda d: d.epoch < F.col("passes"))).otherwise(F.col("all_draws"))
    none = F.array().cast("array<struct<epoch:int,block:int,shard:int>>")
    return known.select("doc_id", "source", "size", "source_size", "target", F.coalesce(some, none).alias("draws"))


def mix(docs: DataFrame, doc_id: str = "doc_id", seed: int = 42, **options) -> DataFrame:
    """The rows that the mix takes, each as often as it is drawn, with mix_shard: a partition per shard, shuffled inside.

    The columns of docs and mix_shard, which replaces a column of that name; __id, __draws, __draw and __place may not be
    among them. The rows of a doc_id are drawn together.
    """
    drawn = plan_mix(docs, doc_id=doc_id, seed=seed, **options).filter(F.size("draws") > 0)
    drawn = cut(drawn.select(F.col("doc_id").alias("__id"), F.col("draws").alias("__draws")).dropDuplicates(["__id"]))
    shards = (drawn.select(F.explode("__draws").alias("d")).agg(F.max("d.shard").alias("n")).first().n or 0) + 1
    # A number for each shard whose hash puts it into the partition of its own.
    places = docs.sparkSession.range(16 * shards + 64).groupBy(F.pmod(F.hash("id"), F.lit(shards)).alias("mix_shard")).agg(F.min("id").alias("__place"))
    rows = docs.drop("mix_shard").join(drawn, docs[doc_id].eqNullSafe(drawn["__id"])).withColumn("__draw", F.explode("__draws"))
    rows = rows.withColumn("mix_shard", F.col("__draw.shard")).join(F.broadcast(places) if shards <= BROADCAST_ROWS else places, "mix_shard", "left")
    order = F.xxhash64(F.lit(seed + 1), "__draw.epoch", F.col(doc_id))
    placed = rows.repartition(shards, F.coalesce("__place", F.col("mix_shard").cast("long"))).sortWithinPartitions("mix_shard", order)
    return placed.select(*[c for c in docs.columns if c != "mix_shard"], "mix_shard")
