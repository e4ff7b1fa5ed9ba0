"""Connected components of links between numbers."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from seclake.llm.tables import stored


def components(links: DataFrame) -> DataFrame:
    """node, root: for each number in a link (columns a and b), the least one it is tied to.

    Alternating large-star and small-star steps: every node ties its larger neighbours, then
    itself and its smaller ones, to the least node it knows of. Each step is a minimum per node
    and a join with it, so a node with very many links is no burden, and the steps needed grow
    with the logarithm of the chains' length. Repeated links and loops are harmless; no links
    give no rows.
    """
    high, low = F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")
    now = stored(links.filter("a <> b").select(high, low).distinct(), "links")
    while True:
        # Done when every node has one link down, and what that leads to has none.
        ends = now.select("u", F.lit(1).alias("down"), F.lit(0).alias("up")).union(
            now.select("v", F.lit(0), F.lit(1)))
        if not ends.groupBy("u").agg(F.sum("down").alias("down"), F.max("up").alias("up")).filter(
                "down > 1 OR down = 1 AND up = 1").limit(1).count():
            break
        both = now.union(now.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select(
            "u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").filter("v > u").select(
            F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").filter("v <> m").select(
            F.col("v").alias("u"), F.col("m").alias("v"))
        now = stored(small.union(least).distinct(), "links")
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(
        now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
