"""Conversations rebuilt from post rows that reply to one another.

Every post's way up to the post that opens its conversation is found by pointer
jumping: each round doubles the length of the ways known, so a chain of a million
replies takes twenty joins, and a round that ends no way has only circles left.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quaystone.operators.deliveries import covered_ids, newest_rows
from quaystone.session import cut_lineage

#: Ids in one numbering block of a conversation: no window holds more rows than this.
BLOCK_IDS = 4096
#: Nothing but spaces and characters that are not seen.
UNSEEN = r"^[\s\p{Z}\p{Cc}\p{Cf}\x{115F}\x{1160}\x{3164}\x{FFA0}\x{2800}\x{34F}\x{FE00}-\x{FE0F}]*$"


def has_visible(text: Column) -> Column:
    """Whether a text holds a character that is seen; false for null."""
    return F.coalesce(~text.rlike(UNSEEN), F.lit(False))


def same_author(name: Column) -> Column:
    """A name without outer spaces and in lower case; null if nothing is left."""
    bare = F.lower(F.regexp_replace(name, r"^[\s\p{Z}]+|[\s\p{Z}]+$", ""))
    return F.when(bare != "", bare)


def resolve_roots(replies: DataFrame) -> DataFrame:
    """``(channel, message_id, root)`` of each reply whose way up ends at a post that replies to nothing.

    ``replies`` has channel, message_id, parent (null: the post replied to is missing)
    and is unique in (channel, message_id). Replies below a missing post or in a
    circle have no root and no row.
    """
    known = replies.select("channel", F.col("message_id").alias("parent"), F.lit(True).alias("is_reply"))
    first = cut_lineage(replies.where(F.col("parent").isNotNull()).join(known, ["channel", "parent"], "left").select("channel", "message_id", F.col("parent").alias("up"), F.col("is_reply").isNull().alias("ended")))
    ended, open_ways = first.where("ended").drop("ended"), first.where(~F.col("ended")).drop("ended")
    while not open_ways.isEmpty():
        # The post that an open way has reached is a reply itself; without a row it is broken, and so is the way.
        ways = ended.withColumn("ends", F.lit(True)).unionByName(open_ways.withColumn("ends", F.lit(False)))
        above = ways.select("channel", F.col("message_id").alias("up"), F.col("up").alias("next"), "ends")
        stepped = cut_lineage(open_ways.join(above, ["channel", "up"]).select("channel", "message_id", F.col("next").alias("up"), "ends"))
        now = stepped.where("ends").drop("ends")
        if now.isEmpty():  # some way ends in every round as long as there are any but circles
            break
        ended, open_ways = ended.unionByName(now), stepped.where(~F.col("ends")).drop("ends")
    return ended.withColumnRenamed("up", "root")


def conversations(posts: DataFrame) -> DataFrame:
    """``(channel, root_message_id, message_id, turn, speaker_role)`` of every whole conversation.

    Of each post the newest row counts. reply_to names a post of its channel by any id
    that post takes; removed posts still link. A conversation is left out if it has
    one message or one author only, or any message without author, with deleted_at or
    without a visible character. turn counts from 1: the opener, then by message_id.
    """
    rows = posts.select(
        "channel",
        "message_id",
        "row_id",
        "fetched_at",
        "media_count",
        "reply_to",
        same_author(F.col("author_name")).alias("author"),
        (F.col("deleted_at").isNotNull() | ~has_visible(F.col("text"))).alias("broken"),
    )
    # What a text says is judged before the shuffle; texts do not travel.
    newest = cut_lineage(newest_rows(rows, ["media_count", "reply_to", "author", "broken"]))
    # An id that several posts take means the one that starts nearest before it.
    ids = newest.select("channel", F.explode(covered_ids()).alias("reply_to"), F.col("message_id").alias("parent")).groupBy("channel", "reply_to").agg(F.max("parent").alias("parent"))
    replies = newest.where(F.col("reply_to").isNotNull()).select("channel", "message_id", "reply_to").join(ids, ["channel", "reply_to"], "left")
    roots = resolve_roots(replies.select("channel", "message_id", "parent"))
    openers = roots.select("channel", F.col("root").alias("message_id")).distinct().withColumn("root", F.col("message_id"))
    members = roots.unionByName(openers).join(newest.select("channel", "message_id", "author", "broken"), ["channel", "message_id"])
    members = cut_lineage(members.select("channel", "root", "message_id", "author", "broken"))
    whole = members.groupBy("channel", "root").agg(
        F.count(F.lit(1)).alias("n"),
        F.min("author").alias("one"),
        F.max("author").alias("other"),
        F.max(F.col("broken") | F.col("author").isNull()).alias("bad"),
        F.max(F.when(F.col("message_id") == F.col("root"), F.col("author"))).alias("opener"),
    )
    whole = whole.where((F.col("n") >= 2) & ~F.col("bad") & (F.col("one") != F.col("other"))).select("channel", "root", "opener")
    kept = members.join(whole, ["channel", "root"]).withColumn("late", (F.col("message_id") != F.col("root")).cast("int"))
    return _numbered(kept).select("channel", F.col("root").alias("root_message_id"), "message_id", "turn", F.when(F.col("author") == F.col("opener"), "opener").otherwise("replier").alias("speaker_role"))


def _numbered(kept: DataFrame) -> DataFrame:
    """Add ``turn``: ids are numbered within blocks of BLOCK_IDS, and a block starts after the rows of those before it."""
    block = F.when(F.col("late") == 0, F.lit(None).cast("bigint")).otherwise(F.floor(F.col("message_id") / BLOCK_IDS).cast("bigint"))
    kept = kept.withColumn("block", F.coalesce(block, F.lit(-(2**62))))
    key = ["channel", "root"]
    sizes = kept.groupBy(*key, "block").agg(F.count(F.lit(1)).alias("size"))
    before = Window.partitionBy(*key).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.withColumn("start", F.coalesce(F.sum("size").over(before), F.lit(0))).drop("size")
    inside = Window.partitionBy(*key, "block").orderBy("message_id")
    return kept.withColumn("place", F.row_number().over(inside)).join(starts, [*key, "block"]).withColumn("turn", (F.col("start") + F.col("place")).cast("int"))


def conversation_sizes(posts: DataFrame) -> DataFrame:
    """``(channel, conversations, messages, longest)`` of the whole conversations of each channel."""
    sizes = conversations(posts).groupBy("channel", "root_message_id").agg(F.count(F.lit(1)).alias("n"))
    return sizes.groupBy("channel").agg(F.count(F.lit(1)).alias("conversations"), F.sum("n").alias("messages"), F.max("n").alias("longest"))
