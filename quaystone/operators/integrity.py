"""How completely the ids of a channel are covered."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Ids that nobody may miss before it is worth an alarm.
ALARM = 25
#: Ids in one block: windows hold the posts of a block, never of a channel.
BLOCK_IDS = 65_536


def coverage(posts: DataFrame) -> DataFrame:
    """Coverage of each channel from (channel, message_id, media_count).

    Columns lowest, highest, posts, covered, unexplained, longest_gap,
    longest_gap_start (of equal gaps the first; null without gap), coverage, alarm.
    An album takes one id for each medium; overlaps count once; cost follows the posts,
    not the ids. Repeated rows of a post count once. Gaps are looked for within blocks
    of ids, with the highest id of all earlier blocks carried in, so that one channel
    with a third of all posts is still many tasks.
    """
    spans = posts.where(F.col("channel").isNotNull() & F.col("message_id").isNotNull())
    spans = spans.groupBy("channel", F.col("message_id").alias("lo")).agg((F.col("lo") + F.greatest(F.max(F.coalesce("media_count", F.lit(1))), F.lit(1)) - 1).alias("hi"))
    spans = spans.withColumn("block", F.floor(F.col("lo") / BLOCK_IDS).cast("bigint"))
    tops = spans.groupBy("channel", "block").agg(F.max("hi").alias("top"))
    earlier = Window.partitionBy("channel").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    tops = tops.withColumn("carried", F.max("top").over(earlier)).drop("top")
    inside = Window.partitionBy("channel", "block").orderBy("lo").rowsBetween(Window.unboundedPreceding, -1)
    seen = spans.withColumn("before", F.max("hi").over(inside)).join(tops, ["channel", "block"])
    seen = seen.withColumn("last", F.greatest("before", "carried"))
    gap = F.greatest(F.col("lo") - F.col("last") - 1, F.lit(0))
    seen = seen.withColumn("gap", F.coalesce(gap, F.lit(0))).withColumn("gap_start", F.col("last") + 1)
    seen = seen.withColumn("fresh", F.greatest(F.col("hi") - F.greatest(F.col("lo") - 1, F.coalesce("last", F.col("lo") - 1)), F.lit(0)))
    out = seen.groupBy("channel").agg(
        F.min("lo").alias("lowest"),
        F.max("hi").alias("highest"),
        F.count(F.lit(1)).alias("posts"),
        F.sum("fresh").alias("covered"),
        F.sum("gap").alias("unexplained"),
        F.max("gap").alias("longest_gap"),
        F.min_by("gap_start", F.struct(-F.col("gap"), "gap_start")).alias("start"),
    )
    share = F.round(100.0 * F.col("covered") / (F.col("highest") - F.col("lowest") + 1), 1)
    return out.select("*", F.when(F.col("longest_gap") > 0, F.col("start")).alias("longest_gap_start"), share.alias("coverage"), (F.col("longest_gap") >= ALARM).alias("alarm")).drop("start")


def post_counts(posts: DataFrame) -> DataFrame:
    """``(channel, posts)`` with repeated rows of a post counted once."""
    return posts.groupBy("channel", "message_id").agg(F.lit(1).alias("one")).groupBy("channel").agg(F.count(F.lit(1)).alias("posts"))
