"""Predicates of a few literal values, in a shape that scans can use."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Values of one pushed IN filter: longer lists reach the scan as a range only.
PUSHED = 10


def is_in(column: Column, values: list) -> Column:
    """Whether the column is one of ``values``: IN in parts small enough to be pushed one by one; false for no values."""
    parts = [column.isin(values[i : i + PUSHED]) for i in range(0, len(values), PUSHED)]
    return reduce(lambda a, b: a | b, parts) if parts else F.lit(False)


def has_key(keys: list[tuple[str | None, int]]) -> Column:
    """Whether (channel, message_id) is one of ``keys``."""
    by_channel: dict[str | None, list[int]] = {}
    for channel, id_ in keys:
        by_channel.setdefault(channel, []).append(id_)
    tests = [F.col("channel").eqNullSafe(F.lit(c)) & is_in(F.col("message_id"), sorted(set(ids))) for c, ids in sorted(by_channel.items(), key=lambda x: x[0] or "")]
    return reduce(lambda a, b: a | b, tests) if tests else F.lit(False)
