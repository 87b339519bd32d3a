"""Conversations as sessions: what a channel says between two silences.

Messages are sorted by time and cut where nothing was said for longer than the channel's
gap, which is calibrated on how soon its messages are replied to. Sessions without a reply
from one person to another are dropped. This is another notion of a conversation than the
replies of ``conversations``; ``compared`` says how far the two agree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quaystone.llm.conversations import conversations, has_visible, same_author
from quaystone.operators.deliveries import covered_ids, newest_values
from quaystone.operators.timestamps import normalise_instants
from quaystone.session import cut_lineage

#: Milliseconds of one block of time: no window holds more rows than a channel has in a block.
BLOCK_MS = 3_600_000
#: A gap is the delay by which this share of a channel's replies has come; channels with fewer replies than LEAST take that of all.
QUANTILE, LEAST = 0.9, 20


def timed_messages(posts: DataFrame, channels: DataFrame) -> DataFrame:
    """``(channel, message_id, at, a1, a2, parent)`` of the newest row of each post; ``parent`` is the post it replies to, if that is there.

    ``at`` is the instant of its date in milliseconds, or of its fetching if the date
    denotes none; a1 and a2 stand for the author (null: none).
    """
    zones = channels.where(F.col("channel").isNotNull()).groupBy("channel").agg(F.max("time_zone").alias("__zone"))
    rows = posts.select("channel", "message_id", "row_id", "fetched_at", "date", "media_count", "reply_to", same_author(F.col("author_name")).alias("__author"), (F.col("deleted_at").isNull() & has_visible(F.col("text"))).alias("__seen"))
    rows = normalise_instants(rows.join(zones, "channel", "left"), "date", channels.select(F.col("time_zone").alias("zone")), "__zone", "__at")
    author = lambda seed: F.when(F.col("__author").isNotNull(), F.xxhash64(F.lit(seed), "__author"))
    newest = newest_values(rows, {"at": F.coalesce("__at", F.unix_millis("fetched_at")), "a1": author(1), "a2": author(2), "media_count": F.col("media_count"), "reply_to": F.col("reply_to"), "seen": F.col("__seen")})
    newest = cut_lineage(newest.where(F.col("at").isNotNull()))
    ids = newest.select("channel", F.explode(covered_ids()).alias("reply_to"), F.col("message_id").alias("parent")).groupBy("channel", "reply_to").agg(F.max("parent").alias("parent"))
    seen = newest.where("seen and a1 is not null").drop("seen", "media_count")
    return cut_lineage(seen.join(ids, ["channel", "reply_to"], "left").drop("reply_to"))


def _replies(messages: DataFrame, *columns: str) -> DataFrame:
    """Messages with the parent's ``columns``, as ``up_...``."""
    up = messages.select("channel", F.col("message_id").alias("parent"), *[F.col(c).alias(f"up_{c}") for c in columns])
    return messages.where(F.col("parent").isNotNull()).join(up, ["channel", "parent"])


def gaps(messages: DataFrame) -> DataFrame:
    """``(channel, gap)`` in milliseconds; sketches are merged, so a channel with a third of all replies is no hot group."""
    delays = _replies(messages, "at").select("channel", (F.col("at") - F.col("up_at")).alias("delay")).where(F.col("delay") > 0)
    own = delays.groupBy("channel").agg(F.percentile_approx("delay", QUANTILE).alias("own"), F.count(F.lit(1)).alias("n"))
    usual = own.agg(F.sum(F.col("own") * F.col("n")) / F.sum("n")).first()[0] or 86_400_000.0
    every = messages.groupBy("channel").agg(F.lit(1).alias("one")).join(own, "channel", "left")
    return every.select("channel", F.when(F.col("n") >= LEAST, F.col("own")).otherwise(F.lit(int(usual))).alias("gap"))


def with_sessions(messages: DataFrame) -> DataFrame:
    """Add ``session``, counted from 0 in each channel by time. Windows are over blocks of time, and over what blocks end with."""
    rows = messages.join(gaps(messages), "channel").withColumn("block", F.floor(F.col("at") / BLOCK_MS).cast("bigint"))
    inside = Window.partitionBy("channel", "block").orderBy("at", "message_id")
    blocks = Window.partitionBy("channel").orderBy("block")
    ends = rows.groupBy("channel", "block").agg(F.max("at").alias("end")).withColumn("carried", F.lag("end").over(blocks)).drop("end")
    rows = rows.withColumn("last", F.lag("at").over(inside)).join(ends, ["channel", "block"])
    rows = rows.withColumn("opens", F.coalesce((F.col("at") - F.coalesce("last", "carried") > F.col("gap")).cast("int"), F.lit(0)))
    rows = cut_lineage(rows.select("channel", "message_id", "at", "a1", "a2", "parent", "block", F.sum("opens").over(inside.rowsBetween(Window.unboundedPreceding, 0)).alias("within"), "opens"))
    before = rows.groupBy("channel", "block").agg(F.sum("opens").alias("n")).withColumn("before", F.coalesce(F.sum("n").over(blocks.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("n")
    return rows.join(before, ["channel", "block"]).withColumn("session", F.col("within") + F.col("before")).drop("within", "before", "opens")


def sessions(posts: DataFrame, channels: DataFrame) -> DataFrame:
    """``(channel, session, message_id, turn, speaker_role)`` of sessions with a reply from one author to another in the same session.

    ``turn`` counts from 1 by time. The opener is who speaks first. Removed messages and
    those without author or visible text do not take part. Empty tables give nothing.
    """
    rows = cut_lineage(with_sessions(timed_messages(posts, channels)))
    key = ["channel", "session"]
    mutual = _replies(rows, "session", "a1", "a2").where((F.col("session") == F.col("up_session")) & ((F.col("a1") != F.col("up_a1")) | (F.col("a2") != F.col("up_a2"))))
    kept = rows.join(mutual.select(*key).distinct(), key, "left_semi")
    by_block = kept.groupBy(*key, "block").agg(F.count(F.lit(1)).alias("n"))
    starts = by_block.withColumn("start", F.coalesce(F.sum("n").over(Window.partitionBy(*key).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("n")
    numbered = kept.withColumn("place", F.row_number().over(Window.partitionBy(*key, "block").orderBy("at", "message_id"))).join(starts, [*key, "block"])
    numbered = cut_lineage(numbered.select(*key, "message_id", "a1", "a2", (F.col("start") + F.col("place")).cast("int").alias("turn")))
    openers = numbered.where("turn = 1").select(*key, F.col("a1").alias("o1"), F.col("a2").alias("o2"))
    opens: Column = (F.col("a1") == F.col("o1")) & (F.col("a2") == F.col("o2"))
    return numbered.join(openers, key).select(*key, "message_id", "turn", F.when(opens, "opener").otherwise("replier").alias("speaker_role"))


def compared(posts: DataFrame, channels: DataFrame) -> DataFrame:
    """``(channel, conversations, split, merged)``: of the conversations that replies make, how many sessions cut, and how many share a session with another."""
    told = conversations(posts).select("channel", "root_message_id", "message_id")
    placed = told.join(with_sessions(timed_messages(posts, channels)).select("channel", "message_id", "session"), ["channel", "message_id"])
    by_root = placed.groupBy("channel", "root_message_id").agg(F.min("session").alias("first"), F.max("session").alias("last"))
    shared = placed.select("channel", "session", "root_message_id").distinct().groupBy("channel", "session").agg(F.count(F.lit(1)).alias("roots"))
    at_first = by_root.join(shared.withColumnRenamed("session", "first"), ["channel", "first"])
    return at_first.groupBy("channel").agg(F.count(F.lit(1)).alias("conversations"), F.count_if(F.col("first") != F.col("last")).alias("split"), F.count_if(F.col("roots") > 1).alias("merged"))
