"""Posts as nested records, with what belongs to them in a fixed order."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quaystone.functions.text import permalink, snippet, total_reactions

KEY = ["channel", "message_id"]


def single_reactions(reactions: DataFrame) -> DataFrame:
    """One row for each reaction_id of a post: of several, counted at different times, the one with the largest count."""
    kept = F.struct("count", "emoji", "is_paid")
    return reactions.groupBy("reaction_id", *KEY).agg(F.max(kept).alias("r")).select("reaction_id", *KEY, "r.*")


def hydrated(posts: DataFrame, links: DataFrame, reactions: DataFrame) -> DataFrame:
    """``posts`` with ``links`` and ``reactions`` as arrays of structs, duplicates dropped, links by ord, reactions by id.

    ``posts`` is unique in channel and message_id. Each side is grouped once and
    joined on the same key; a post without any has empty arrays. A record holds all
    that belongs to its post: for sums over posts with very many rows there is
    ``reaction_totals``.
    """
    link = F.struct("ord", "link_id", "url_raw", "url_canonical", "preview")
    reaction = F.struct("reaction_id", "emoji", "count", "is_paid")
    by_post = links.dropDuplicates(["link_id", *KEY]).groupBy(*KEY).agg(F.array_sort(F.collect_list(link)).alias("links"))
    counts = single_reactions(reactions).groupBy(*KEY).agg(F.array_sort(F.collect_list(reaction)).alias("reactions"))
    out = posts.join(by_post, KEY, "left").join(counts, KEY, "left")
    empty_links = F.array().cast(out.schema["links"].dataType)
    empty_reactions = F.array().cast(out.schema["reactions"].dataType)
    return out.withColumn("links", F.coalesce("links", empty_links)).withColumn("reactions", F.coalesce("reactions", empty_reactions))


def reaction_totals(posts: DataFrame, reactions: DataFrame) -> DataFrame:
    """``(channel, message_id, total)``: the sum of each post's reactions, paid ones included, duplicates once; 0 for none.

    Summed before the join, so a post with a third of all reactions is one row a task.
    """
    sums = single_reactions(reactions).groupBy(*KEY).agg(F.sum("count").alias("total"))
    return posts.select(*KEY).join(sums, KEY, "left").select(*KEY, F.coalesce("total", F.lit(0)).alias("total"))


def summaries(records: DataFrame) -> DataFrame:
    """``(channel, message_id, author, kind, snippet, reactions, link)`` of hydrated posts."""
    return records.select(
        *KEY,
        F.col("author_name").alias("author"),
        "kind",
        snippet(F.col("text"), F.col("poll.question")).alias("snippet"),
        total_reactions(F.col("reactions")).alias("reactions"),
        permalink(F.col("channel"), F.col("message_id")).alias("link"),
    )
