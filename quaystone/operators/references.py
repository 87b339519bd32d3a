"""References to posts and channels that the archive lacks or that were removed.

Parent and child keys are put under one another in long form, tagged with the
table they name, and grouped by table and key; a group without a parent flag is
an orphan key. Counts are made before the shuffle, so a parent that a third of all
rows name costs one row a task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quaystone.operators.deliveries import covered_ids, fold_channel, newest_rows

#: Stands for "no message id" in keys that name a channel only.
NO_ID = -1


def parent_keys(posts: DataFrame, channels: DataFrame) -> DataFrame:
    """``(parent_table, channel, id)`` of all that may be referred to: channels, and each id of each post that is not removed."""
    # Of each post's newest row, how many ids it takes; 0 once it is removed.
    taken = F.when(F.col("deleted_at").isNull(), F.greatest(F.coalesce("media_count", F.lit(1)), F.lit(1))).otherwise(0)
    newest = newest_rows(posts.select("channel", "message_id", "fetched_at", "row_id", taken.alias("media_count")), ["media_count"])
    living = newest.where(F.col("media_count") > 0).select(F.lit("post").alias("parent_table"), F.lower("channel").alias("channel"), F.explode(covered_ids()).alias("id"))
    known = channels.where(F.col("channel").isNotNull()).select(F.lit("channel").alias("parent_table"), F.lower("channel").alias("channel"), F.lit(NO_ID).cast("bigint").alias("id"))
    return living.unionByName(known)


def child_keys(posts: DataFrame) -> DataFrame:
    """``(row_id, field, period, parent_table, channel, id)``, one row for each key that a row of ``posts`` refers to.

    A forward names its channel and, with forward_message_id, a post there too.
    ``period`` is the month in which the row was fetched, in the session's zone.
    """
    target = fold_channel(F.col("forward_channel"))
    ref = lambda field, table, channel, id_: F.struct(F.lit(field).alias("field"), F.lit(table).alias("parent_table"), channel.alias("channel"), id_.cast("bigint").alias("id"))
    refs = F.array_compact(
        F.array(
            F.when(F.col("reply_to").isNotNull() & F.col("channel").isNotNull(), ref("reply_to", "post", F.lower("channel"), F.col("reply_to"))),
            F.when(F.col("forward_channel").isNotNull(), ref("forward", "channel", target, F.lit(NO_ID))),
            F.when(F.col("forward_channel").isNotNull() & F.col("forward_message_id").isNotNull(), ref("forward", "post", target, F.col("forward_message_id"))),
        )
    )
    rows = posts.where(F.col("reply_to").isNotNull() | F.col("forward_channel").isNotNull())
    return rows.select("row_id", F.date_format("fetched_at", "yyyy-MM").alias("period"), F.explode(refs).alias("__ref")).select("row_id", "__ref.field", "period", "__ref.parent_table", "__ref.channel", "__ref.id")


def orphan_keys(parents: DataFrame, children: DataFrame) -> DataFrame:
    """``(parent_table, channel, id)`` of the keys that children name and no parent has."""
    key = ["parent_table", "channel", "id"]
    tagged = parents.select(*key, F.lit(1).alias("is_parent")).unionByName(children.select(*key, F.lit(0).alias("is_parent")))
    return tagged.groupBy(*key).agg(F.max("is_parent").alias("is_parent")).where(F.col("is_parent") == 0).drop("is_parent")


def orphans(posts: DataFrame, channels: DataFrame) -> DataFrame:
    """``child_keys`` rows whose key is an orphan.

    Repeated rows of ``posts`` give repeated rows. Null references refer to nothing;
    empty tables give an empty result, an empty ``channels`` makes every forward an
    orphan. The orphan keys are unique, so a hot key is split on the child side only.
    """
    children = child_keys(posts)
    return children.join(orphan_keys(parent_keys(posts, channels), children), ["parent_table", "channel", "id"], "left_semi")


def orphan_rows(posts: DataFrame, channels: DataFrame) -> DataFrame:
    """``(row_id, field)`` of each row with an orphan reference, once each."""
    return orphans(posts, channels).select("row_id", "field").distinct()


def orphan_report(posts: DataFrame, channels: DataFrame) -> DataFrame:
    """``(field, parent_table, period, refs, keys)``: orphan references and distinct orphan keys for each field, table and month."""
    by_key = orphans(posts, channels).groupBy("field", "parent_table", "channel", "id", "period").agg(F.count(F.lit(1)).alias("n"))
    return by_key.groupBy("field", "parent_table", "period").agg(F.sum("n").alias("refs"), F.count(F.lit(1)).alias("keys"))
