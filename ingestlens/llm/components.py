"""Union-find grouping over a table of links: alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ingestlens.llm.common import stored


def _large_star(links: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is linked to the least of the node and its neighbours."""
    both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(links: DataFrame) -> DataFrame:
    """A node and its smaller neighbours are linked to the least of them."""
    least = links.groupBy("u").agg(F.min("v").alias("m"))
    others = links.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return others.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def _state(links: DataFrame):
    return links.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()


#: Links that a task writes, about; a table of few links is few files, which the next round reads.
TASK_LINKS = 250_000


def components(links: DataFrame) -> DataFrame:
    """``id, component`` for every node of ``links`` (``u, v`` of one type): the least node that it reaches.

    A node's neighbours are never gathered: each step keeps a minimum per node,
    which combines before the shuffle, and a join that adaptive execution can
    split. Every round is written to the shared folder. The number of rounds
    grows with the logarithm of the number of links.
    """
    now = stored(
        links.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links"
    )
    before = None
    while (state := _state(now)) != before:
        before = state
        now = stored(_small_star(_large_star(now)).coalesce(-(-state[0] // TASK_LINKS) or 1), "links")
    leaves = now.select(F.col("u").alias("id"), F.col("v").alias("component"))
    return leaves.unionByName(now.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())
