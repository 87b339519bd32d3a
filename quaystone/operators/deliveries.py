"""Posts as delivered: several rows for one post, of which the newest holds."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Stands for a missing time, before all times; and the room that every row_id has below one microsecond.
_NO_TIME, _ROOM = -(10**17), Decimal(2 * 10**19)


def delivery_order() -> Column:
    """What makes one row of a post newer than another: (fetched_at, row_id), nulls oldest."""
    return F.struct("fetched_at", "row_id")


def order_key() -> Column:
    """``delivery_order`` as one number of fixed width, microseconds before row_id: aggregates over it hash and need no sort."""
    at = F.coalesce(F.unix_micros("fetched_at"), F.lit(_NO_TIME)).cast("decimal(18,0)")
    return at * F.lit(_ROOM).cast("decimal(20,0)") + F.coalesce("row_id", F.lit(-(2**63))).cast("decimal(20,0)")


def newest_values(posts: DataFrame, values: dict[str, Column]) -> DataFrame:
    """``(channel, message_id, *values)`` of the newest row of each post; ``values`` are numbers, flags or times.

    As ``newest_rows``, but for values of fixed width: both steps of the aggregate hash.
    """
    rows = posts.where(F.col("channel").isNotNull() & F.col("message_id").isNotNull())
    rows = rows.select("channel", "message_id", order_key().alias("__order"), *[v.alias(f"__{n}") for n, v in values.items()])
    return rows.groupBy("channel", "message_id").agg(*[F.max_by(f"__{n}", "__order").alias(n) for n in values])


def newest_rows(posts: DataFrame, columns: list[str]) -> DataFrame:
    """``columns`` of the newest row of each post, one row for each (channel, message_id).

    An aggregate with a partial step, so that a post delivered very often is no hot
    group. Rows without channel or message_id are no post and are left out.
    """
    kept = [c for c in columns if c not in ("channel", "message_id")]
    rows = posts.where(F.col("channel").isNotNull() & F.col("message_id").isNotNull())
    rows = rows.groupBy("channel", "message_id").agg(F.max_by(F.struct(F.lit(0).alias("__any"), *kept), delivery_order()).alias("__newest"))
    return rows.select("channel", "message_id", *[F.col(f"__newest.`{c}`").alias(c) for c in kept])


def covered_ids(message_id: str = "message_id", media_count: str = "media_count") -> Column:
    """The array of ids that a post takes; an album takes one for each medium, everything else one."""
    first = F.col(message_id)
    return F.sequence(first, first + F.greatest(F.coalesce(F.col(media_count), F.lit(1)), F.lit(1)) - 1)


def fold_channel(name: Column) -> Column:
    """A channel name without leading ``@`` and in lower case."""
    return F.lower(F.regexp_replace(name, "^@+", ""))
