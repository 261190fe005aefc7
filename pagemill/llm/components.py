"""Connected components of a link table, as DataFrame joins and partial aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagemill.llm.shared import cut


#: Hubs of stars that are broadcast, the largest first, and the spokes from which on one is.
BROADCAST_HUBS, LARGE_HUB = 10_000, 100
#: Links of a partition: every round writes files for each partition, which may be far more than the links need.
PART_LINKS, LEAST_PARTS = 50_000, 12


def connected_components(links: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """(node, component) of every node that occurs in links; component is the smallest node reachable.

    Nodes whose only neighbour is smaller are spokes: they are kept out of the loop and take their hub's component at
    the end, the largest hubs by a broadcast of bounded size, so that a large star lands in no single task. Rounds of:
    take the smallest label among the neighbours, hook the old label's node to it, and jump to the label's own label.
    The distance to the smallest node at least halves a round on paths, so rounds grow with the logarithm of the longest
    chain. Every join reads checkpointed tables on both sides, so that Spark can split the rows of a node with very many
    links; every aggregate is combined before its shuffle. Links with a null end and links of a node to itself count as
    none; an empty table gives an empty table.
    """
    a, b = F.col(src).cast("long"), F.col(dst).cast("long")
    pairs = links.select(a.alias("u"), b.alias("v")).filter("u is not null and v is not null and u <> v")
    every = cut(pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct())
    parts = max(LEAST_PARTS, every.count() // PART_LINKS)
    every = every.coalesce(parts)
    degrees = every.groupBy("u").agg(F.count("*").alias("n"), F.min("v").alias("v"))
    spokes = cut(degrees.filter("n = 1 and v < u").select(F.col("u").alias("node"), F.col("v").alias("hub")).coalesce(parts))
    of = lambda u, v: spokes.select(F.col("node").alias(u), F.col("hub").alias(v))
    both = cut(every.join(of("u", "v"), ["u", "v"], "left_anti").join(of("v", "u"), ["u", "v"], "left_anti").coalesce(parts))
    labels = _label(both, parts)
    hubs = spokes.groupBy("hub").agg(F.count("*").alias("n"))
    named = cut(hubs.join(labels, F.col("hub") == F.col("node"), "left").select("hub", "n", F.coalesce("component", "hub").alias("component")).coalesce(parts))
    large = cut(named.filter(F.col("n") >= LARGE_HUB).orderBy(F.desc("n"), "hub").limit(BROADCAST_HUBS).select("hub", F.col("component").alias("large")))
    marked = spokes.join(F.broadcast(large), "hub", "left")
    rest = marked.filter("large is null").select("node", "hub").join(named.select("hub", "component"), "hub").select("node", "component")
    own = named.join(labels, F.col("hub") == F.col("node"), "left_anti").select(F.col("hub").alias("node"), "component")
    return labels.unionByName(own).unionByName(marked.filter("large is not null").select("node", F.col("large").alias("component"))).unionByName(rest)


def _label(both: DataFrame, parts: int) -> DataFrame:
    """(node, component) of every node of both(u, v), which holds each link in both directions; tables have up to `parts` partitions."""
    labels = cut(both.groupBy("u").agg(F.min("v").alias("v")).select(F.col("u").alias("node"), F.least("u", "v").alias("label")).coalesce(parts))
    while True:
        near = both.join(labels.select(F.col("node").alias("v"), "label"), "v").coalesce(parts).groupBy(F.col("u").alias("node")).agg(F.min("label").alias("near"))
        moved = labels.join(near, "node").select("node", F.col("label").alias("was"), F.least("label", "near").alias("label"))
        hooked = moved.filter("label < was").select(F.col("was").alias("node"), "label")
        least = cut(moved.select("node", "label").unionByName(hooked).coalesce(parts).groupBy("node").agg(F.min("label").alias("label")).coalesce(parts))
        jumped = cut(least.join(least.select(F.col("node").alias("label"), F.col("label").alias("next")), "label").select("node", F.col("next").alias("label")).coalesce(parts))
        changed = jumped.join(labels.withColumnRenamed("label", "was"), "node").filter("label <> was").limit(1).count()
        labels = jumped
        if not changed:
            return labels.select("node", F.col("label").alias("component"))
