"""Connected components of a link table, by alternating star operations.

Large-star links every node's larger neighbours to its smallest neighbour,
small-star its smaller ones; the links shrink to one star a component in a
number of rounds that grows with the logarithm of the longest chain
(Kiveris et al., 2014). Every round is a partial aggregation and a join, so no
component is ever gathered in one task, and each round's links are written to
the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import materialize


def _large_star(links: DataFrame) -> DataFrame:
    both = links.select("u", "v").union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(links: DataFrame) -> DataFrame:
    least = links.groupBy("u").agg(F.min("v").alias("m"))
    joined = links.join(least, "u")
    hooked = joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return hooked.union(least.select("u", F.col("m").alias("v"))).distinct()


def _state(links: DataFrame):
    return links.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()


def connected_components(links: DataFrame) -> DataFrame:
    """(node, root) for every node in links (u, v); root is the smallest node of its component.

    Cases: nulls, loops and repeated links are ignored; nodes without links do
    not appear; no links give no rows.
    """
    pairs = links.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    pairs = materialize(pairs, "links")
    before = _state(pairs)
    while before["n"]:
        pairs = materialize(_small_star(_large_star(pairs)), "stars")
        after = _state(pairs)
        if (after["n"], after["h"]) == (before["n"], before["h"]):
            break
        before = after
    roots = pairs.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return pairs.select(F.col("u").alias("node"), F.col("v").alias("root")).union(roots)
