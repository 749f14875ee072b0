"""Places of rows within their group, in order, where one group may hold most rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ingestlens.llm.common import stored

_ROW = (1 << 33) - 1


def placed(rows: DataFrame, group: str, order: list[str], name: str) -> DataFrame:
    """``rows`` plus ``__part, __pos, __n``: place in the group from 0 by ``order``, and the group's size.

    Rows are dealt by ranges of (group, order), so a large group is spread over
    tasks; only counts per (group, task) are summed up, at most a row a task
    more than there are groups. ``group`` has no nulls. Rows equal in all of
    ``order`` stand in any order, fixed once stored.
    """
    ranged = rows.repartitionByRange(group, *order).sortWithinPartitions(group, *order)
    kept = stored(ranged.withColumn("__id", F.monotonically_increasing_id()), name).withColumn("__part", F.shiftright("__id", 33).cast("int"))
    stretches = kept.groupBy(group, "__part").agg(F.min("__id").alias("__first"), F.count("*").alias("__here"))
    before = W.partitionBy(group).orderBy("__part").rowsBetween(W.unboundedPreceding, -1)
    ahead = stretches.select(
        group, "__part", "__first", F.coalesce(F.sum("__here").over(before), F.lit(0)).alias("__ahead"), F.sum("__here").over(W.partitionBy(group)).alias("__n")
    )
    return kept.join(ahead, [group, "__part"]).withColumn("__pos", F.col("__id") - F.col("__first") + F.col("__ahead")).drop("__id", "__first", "__ahead")
