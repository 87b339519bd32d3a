"""One session for all tests, and small tables with everything that may go wrong in them."""

from __future__ import annotations

import datetime as dt

import pytest

from quaystone.session import local_session

POST = """row_id bigint, channel string, message_id bigint, date string, kind string, format_source string, media_count int, text string, lang string,
author_name string, is_edited boolean, reply_to bigint, forward_channel string, forward_message_id bigint, forward_author string, views_value bigint,
views_is_approximate boolean, hashtags array<string>, poll struct<question: string, options: array<string>, total_votes: bigint>, fetched_at timestamp, deleted_at timestamp"""
NAMES = [part.strip().split(" ")[0] for part in POST.split(", ") if part.strip()]
#: Columns that a caller may have besides ours, with names that operators might use inside.
CLASHING = ("__f", "hit", "words", "h", "p", "g", "b", "low", "up", "block", "key", "tokens", "form", "lang_", "turn", "languages")


@pytest.fixture(scope="session")
def spark():
    session = local_session(4, 2, "4g")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


def at(day: int, hour: int = 0) -> dt.datetime:
    return dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc) + dt.timedelta(days=day, hours=hour)


def post_rows(spark, rows: list[dict], clash: bool = False):
    """Post rows from the given values; all else is null."""
    fields = spark.createDataFrame([], POST).schema
    df = spark.createDataFrame([tuple(r.get(f.name) for f in fields) for r in rows], fields)
    if clash:
        from pyspark.sql import functions as F

        df = df.select("*", *[F.lit("x").alias(c) for c in CLASHING])
    return df


@pytest.fixture(scope="session")
def posts_of(spark):
    return lambda rows, clash=False: post_rows(spark, rows, clash)


def rows_of(df) -> list[tuple]:
    return sorted((tuple(r) for r in df.collect()), key=repr)
