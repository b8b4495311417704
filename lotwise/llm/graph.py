"""Connected components of undirected edges, in rounds of joins and grouped minima."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from lotwise.llm.common import materialize, note, scratch


def _stamp(edges: DataFrame) -> tuple:
    """Tells edge sets apart: their number and two sums of hashes."""
    h = lambda seed: F.sum(F.xxhash64(F.lit(seed), "a", "b").cast("decimal(38,0)"))
    return tuple(edges.agg(F.count("*"), h(1), h(2)).first())


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the edges (a, b), two long columns; the root is the component's least node.

    Alternates large-star and small-star steps (Kiveris et al., 2014): every node hangs its neighbours on the least
    of them until each component is a star. Rounds grow with the logarithm of the number of nodes; each is written to
    the shared folder, so no lineage piles up and a lost executor costs one round. A hub's edges are met by a join
    that Spark can split, never in one group. Tables of earlier rounds are deleted; the last stays.
    """
    with scratch(edges.sparkSession) as made:
        stars = _stars(edges)
        kept = made.pop()
    note(kept)
    return stars


def _stars(edges: DataFrame) -> DataFrame:
    now = materialize(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    stamp = _stamp(now)
    while True:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = materialize(now.select(F.col("b").alias("a"), F.col("a").alias("far")).join(least, "a").select(F.col("far").alias("a"), F.col("m").alias("b")).distinct())
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        hung = large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
        now = materialize(hung.unionByName(least.select("a", F.col("m").alias("b"))).distinct())
        last, stamp = stamp, _stamp(now)
        if last == stamp:
            return materialize(now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()))
