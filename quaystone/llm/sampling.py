"""Bounded samples of labelled rows for fitting classifiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F


def hashed_sample(df: DataFrame, key: str, columns: list[Column], size: int, of: Column | None = None) -> list[Row]:
    """About ``size`` rows (at most twice as many) whose hashed key falls into one of as many equal parts as there are ``size`` rows in the table.

    Of one table the same rows come out, in one order, however it is partitioned: should
    more than twice ``size`` fall into the part, as keys repeat, those with the smallest
    hashes of key and content are taken. ``of``: only rows where it holds.
    """
    parts = max(1, df.count() // size)
    rows = df if of is None else df.where(of)
    if parts > 1:
        rows = rows.where(F.pmod(F.xxhash64(F.lit(41), F.col(key)), F.lit(parts)) == 0)
    rows = rows.select(F.xxhash64(key).alias("__h"), F.xxhash64(*columns).alias("__c"), *columns)
    return rows.orderBy("__h", "__c").limit(2 * size).drop("__c").collect()
