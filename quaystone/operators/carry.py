"""Values carried forward along ids, in blocks, so that one large group is many tasks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BLOCK_IDS = 65_536


def carry_forward(df: DataFrame, group: str, order: str, value: str, out: str) -> DataFrame:
    """Add ``out``: ``value``, or where it is null the last one before it in the group.

    ``order`` is a bigint, unique in the group. Within a block of ids a window looks
    back; what an earlier block ends with is joined on. Null where nothing came before.
    """
    df = df.withColumn("__block", F.floor(F.col(order) / BLOCK_IDS).cast("bigint"))
    ends = df.where(F.col(value).isNotNull()).groupBy(group, "__block").agg(F.max_by(value, order).alias("__end"))
    blocks = df.groupBy(group, "__block").agg(F.lit(1).alias("__one")).join(ends, [group, "__block"], "left")
    earlier = Window.partitionBy(group).orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select(group, "__block", F.last("__end", ignorenulls=True).over(earlier).alias("__carried"))
    inside = Window.partitionBy(group, "__block").orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    df = df.withColumn("__inside", F.last(value, ignorenulls=True).over(inside)).join(blocks, [group, "__block"])
    return df.withColumn(out, F.coalesce("__inside", "__carried")).drop("__block", "__inside", "__carried")
