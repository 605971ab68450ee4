"""Connected components of a graph that only exists as a DataFrame of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


def _stars(links: DataFrame, small: bool) -> DataFrame:
    """One step: the neighbours of each node are tied to the least of them.

    The least neighbour is found by a partial aggregation and joined back, so a hub's links are
    split over tasks instead of gathered in one.
    """
    both = links if small else links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    if small:
        both = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    low = both.groupBy("a").agg(F.min("b").alias("low")).withColumn("low", F.least("a", "low"))
    joined = both.join(low, "a")
    if small:
        out = joined.select(F.col("b").alias("a"), F.col("low").alias("b")).unionByName(low.select("a", F.col("low").alias("b")))
    else:
        out = joined.filter(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("low").alias("b"))
    return out.filter(F.col("a") != F.col("b")).distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, root) for each node of ``links`` (a, b: bigint) other than the roots themselves.

    root is the least node of the component. Large-star and small-star steps alternate until the
    links stop changing; each round is written to the shared checkpoint folder, and only two
    numbers a round reach the driver. No links give no rows.
    """
    links = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter(F.col("a") != F.col("b")).distinct()
    links, before = cut(links), None
    while True:
        after = links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if before == after or not after[0]:
            return links.select(F.col("a").alias("node"), F.col("b").alias("root"))
        before, links = after, cut(_stars(_stars(links, small=False), small=True))
