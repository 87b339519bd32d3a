"""Links between posts: the same resource under many addresses."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quaystone.functions.predicates import is_in
from quaystone.functions.text import iso_instant, permalink, snippet
from quaystone.functions.urls import canonical_url, effective_url

#: Addresses that lead to one resource and are looked up one by one; with more, all links are joined. Both give the same.
LOOKED_UP = 1000


def resolved_links(links: DataFrame, resolutions: DataFrame) -> DataFrame:
    """``links`` with ``resolved_canonical`` and ``effective``, what they are joined on.

    A link without a canonical form, or whose address was never or not successfully
    resolved, keeps its own. Repeated resolutions of an address count as the latest.
    """
    latest = resolutions.groupBy("url_canonical").agg(F.max_by("resolved_canonical", F.struct("resolved_at", "resolved_canonical")).alias("resolved_canonical"))
    joined = links.join(latest, "url_canonical", "left")
    return joined.withColumn("effective", effective_url(F.col("resolved_canonical"), F.col("url_canonical")))


def links_to(links: DataFrame, resolutions: DataFrame, url: str) -> DataFrame:
    """Links whose effective address is that of ``url``; if ``url`` has no canonical form, those with the same raw text.

    Ordered by channel, message_id, ord.
    """
    form = canonical_url(url)
    if form is None:
        found = links.where(F.col("url_raw") == url).withColumn("resolved_canonical", F.lit(None).cast("string")).withColumn("effective", F.col("url_canonical"))
        return found.orderBy("channel", "message_id", "ord")
    key = resource_of(resolutions, form)
    leading = [r[0] for r in resolutions.where(F.col("resolved_canonical") == key).select("url_canonical").distinct().limit(LOOKED_UP + 1).collect()]
    if len(leading) <= LOOKED_UP:
        # Only links with one of these addresses can have the key, so the scans are told.
        wanted = sorted({*leading, key})
        links, resolutions = links.where(is_in(F.col("url_canonical"), wanted)), resolutions.where(is_in(F.col("url_canonical"), wanted))
    return resolved_links(links, resolutions).where(F.col("effective") == key).orderBy("channel", "message_id", "ord")


def resource_of(resolutions: DataFrame, form: str) -> str:
    """The effective address of a canonical one: where it was last seen to lead, else itself."""
    known = resolutions.where(F.col("url_canonical") == form).orderBy(F.desc_nulls_last("resolved_at"), F.desc_nulls_last("resolved_canonical")).select("resolved_canonical").first()
    return (known and known[0]) or form


def link_hits(found: DataFrame, posts: DataFrame) -> DataFrame:
    """Links with what is shown of their post: ``(channel, message_id, ord, date, url_raw, url_canonical, resolved_canonical, snippet, link)``.

    A link whose post is not there is kept with null date and snippet. ``posts`` is unique in channel and message_id.
    """
    shown = posts.select("channel", "message_id", iso_instant(F.col("date")).alias("date"), snippet(F.col("text"), F.col("poll.question")).alias("snippet"))
    rows = found.select("channel", "message_id", "ord", "url_raw", "url_canonical", "resolved_canonical").join(shown, ["channel", "message_id"], "left")
    return rows.select("channel", "message_id", "ord", "date", "url_raw", "url_canonical", "resolved_canonical", "snippet", permalink(F.col("channel"), F.col("message_id")).alias("link"))


def shared_resources(links: DataFrame, resolutions: DataFrame, least: int = 2) -> DataFrame:
    """``(effective, posts, channels)`` of resources linked from at least ``least`` posts; exact duplicate links count once."""
    posts = resolved_links(links, resolutions).where(F.col("effective").isNotNull()).groupBy("effective", "channel", "message_id").agg(F.lit(1).alias("one"))
    by_channel = posts.groupBy("effective", "channel").agg(F.count(F.lit(1)).alias("n"))
    return by_channel.groupBy("effective").agg(F.sum("n").alias("posts"), F.count(F.lit(1)).alias("channels")).where(F.col("posts") >= least)
