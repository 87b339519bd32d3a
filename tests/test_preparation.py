"""Incremental marks, orphan references and timestamps on small tables."""

from __future__ import annotations

import datetime as dt
from zoneinfo import ZoneInfo

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quaystone.operators import incremental, references, timestamps
from tests.conftest import at, rows_of

WALK = "walk_id bigint, channel string, started_at timestamp, finished_at timestamp, outcome string, lowest_message_id bigint, highest_message_id bigint, is_backfill_complete boolean"
CHANNEL = "channel string, raw_channel_id bigint, title string, subscriber_count bigint, reachability string, time_zone string"


def walks(spark, rows):
    return spark.createDataFrame([(i, c, None, f, o, lo, hi, done) for i, c, f, o, lo, hi, done in rows], WALK)


def channels(spark, zones):
    return spark.createDataFrame([(c, None, None, None, None, z) for c, z in zones.items()], CHANNEL)


def test_pending_posts(spark, posts_of):
    posts = posts_of(
        [
            {"row_id": 1, "channel": "a", "message_id": 1, "text": "x", "fetched_at": at(1)},  # handled
            {"row_id": 2, "channel": "a", "message_id": 2, "text": "x", "fetched_at": at(1)},
            {"row_id": 3, "channel": "a", "message_id": 2, "text": "y", "fetched_at": at(9)},  # edited later
            {"row_id": 4, "channel": "a", "message_id": 3, "text": None, "fetched_at": at(1)},
            {"row_id": 5, "channel": "a", "message_id": 3, "text": None, "views_value": 7, "fetched_at": at(9)},  # other views only
            {"row_id": 6, "channel": "a", "message_id": 99, "text": "x", "fetched_at": at(1)},  # above the mark
            {"row_id": 7, "channel": "b", "message_id": 1, "text": "x", "fetched_at": at(1)},  # below an open backfill
            {"row_id": 8, "channel": "b", "message_id": 5, "text": "x", "fetched_at": at(1)},
            {"row_id": 9, "channel": "c", "message_id": 5, "text": "x", "fetched_at": at(1)},  # no mark
            {"row_id": 10, "channel": "a", "message_id": 4, "text": "x", "fetched_at": at(1)},
            {"row_id": 11, "channel": "a", "message_id": 4, "text": "x", "deleted_at": at(8), "fetched_at": at(9)},  # removed
            {"row_id": 12, "channel": "a", "message_id": 7, "text": "x", "fetched_at": None},  # never fetched
            {"row_id": 13, "channel": None, "message_id": 7},
            {"row_id": 14, "channel": "a", "message_id": None},
        ],
        clash=True,
    )
    log = walks(
        spark,
        [
            (1, "a", at(2), "succeeded", 3, 10, True),
            (1, "a", at(2), "succeeded", 3, 10, True),
            (2, "a", at(7), "failed", 1, 500, True),
            (3, "a", at(8), "succeeded", None, None, True),
            (4, "b", at(2), "succeeded", 3, 10, False),
            (5, "c", None, "succeeded", 1, 10, True),
        ],
    )
    assert rows_of(incremental.pending_posts(posts, log)) == [("a", 2), ("a", 4), ("a", 7), ("a", 99), ("b", 1), ("c", 5)]
    assert rows_of(incremental.pending_counts(incremental.pending_posts(posts, log)))[0] == ("a", 4, 2, 99)
    assert incremental.pending_posts(posts, log.limit(0)).count() == 9
    assert incremental.pending_posts(posts.limit(0), log).count() == 0


def test_one_post_with_most_rows(spark, posts_of):
    rows = [{"row_id": i, "channel": "a", "message_id": 1, "text": "x" * (i % 3), "fetched_at": at(1, 0)} for i in range(200)]
    log = walks(spark, [(1, "a", at(2), "succeeded", 1, 10, True)])
    assert rows_of(incremental.pending_posts(posts_of(rows), log)) == []  # ties in fetched_at: the largest row_id is both newest and handled


def test_sync_runs_put_out_each_change_once(spark, posts_of, tmp_path):
    rows = [{"row_id": i, "channel": "ab"[i % 2], "message_id": i % 5, "text": f"t{i % 3}", "fetched_at": at(i)} for i in range(12)] + [{"row_id": 50, "channel": "a", "message_id": 9, "fetched_at": None}]
    log = walks(spark, [(1, "a", at(2), "succeeded", 0, 10, True), (2, "quiet", at(2), "succeeded", 1, 3, True)])
    posts = posts_of(rows)
    run = incremental.SyncRun(spark, str(tmp_path), log)
    assert run.output().count() == 0
    part = posts.where("row_id < 6 or row_id = 50")

    def lose():
        raise RuntimeError("lost")

    with pytest.raises(RuntimeError):
        run.run(part, lose)
    assert run.output().count() == 0 and run.log.latest().version == 0
    run.run(part)
    assert rows_of(run.output()) == rows_of(incremental.pending_posts(part, log))
    run.run(posts)
    # Of the later rows, those whose content differs from what the post had before.
    seen = {}
    for r in rows[:6]:
        seen[r["channel"], r["message_id"]] = r["text"]
    last = seen | {(r["channel"], r["message_id"]): r["text"] for r in rows[6:12]}
    assert rows_of(run.output()) == sorted(k for k, t in last.items() if seen.get(k) != t)
    assert run.run(posts).version == 2  # nothing is due
    assert rows_of(run.watermarks().select("channel", "lowest_message_id", "highest_message_id", "is_backfill_complete")) == [("a", 0, 10, True), ("b", 0, 4, False), ("quiet", 1, 3, True)]
    later = posts_of([*rows, {"row_id": 60, "channel": "a", "message_id": 2, "text": "new", "fetched_at": at(20)}])
    run.run(later)
    assert rows_of(run.output()) == [("a", 2)]


def test_incremental_run_survives_failures(spark, tmp_path):
    rows = [(i, at(i // 3), f"t{i}") for i in range(10)] + [(None, at(1), "no id"), (99, None, "no time")]
    source = spark.createDataFrame(rows, "row_id bigint, fetched_at timestamp, text string")
    run = incremental.IncrementalRun(spark, str(tmp_path), ["fetched_at", "row_id"])
    part = source.where("row_id < 5")
    first = run.run(part, lambda df: df.withColumn("n", F.length("text")))
    assert first.version == 1 and rows_of(run.output().select("row_id")) == [(i,) for i in range(5)]

    def broken(df):
        raise RuntimeError("lost")

    with pytest.raises(RuntimeError):
        run.run(source, broken)
    assert run.log.latest() == first

    def half(df):  # written, but the commit is lost
        return df

    commit, run.log.commit = run.log.commit, lambda m: (_ for _ in ()).throw(ConnectionError())
    with pytest.raises(ConnectionError):
        run.run(source, half)
    run.log.commit = commit
    assert run.output().count() == 5
    run.run(source, lambda df: df.withColumn("n", F.length("text")))
    assert rows_of(run.output().select("row_id")) == [(i,) for i in range(10)]
    assert run.run(source, broken).version == 2  # nothing is due
    with pytest.raises(FileExistsError):
        run.log.commit(incremental.Manifest(2, "x", []))
    assert incremental.IncrementalRun(spark, str(tmp_path / "other"), ["row_id"]).run(source.limit(0), broken).version == 0


def test_orphans(spark, posts_of):
    posts = posts_of(
        [
            {"row_id": 1, "channel": "a", "message_id": 10, "media_count": 3, "fetched_at": at(1)},
            {"row_id": 2, "channel": "a", "message_id": 20, "reply_to": 12, "fetched_at": at(1)},  # within the album
            {"row_id": 3, "channel": "a", "message_id": 21, "reply_to": 13, "fetched_at": at(40)},  # behind it
            {"row_id": 4, "channel": "b", "message_id": 1, "fetched_at": at(1)},
            {"row_id": 5, "channel": "b", "message_id": 1, "deleted_at": at(3), "fetched_at": at(4)},
            {"row_id": 6, "channel": "a", "message_id": 22, "forward_channel": "@@B", "forward_message_id": 1, "fetched_at": at(1)},  # removed
            {"row_id": 7, "channel": "a", "message_id": 23, "forward_channel": "B", "fetched_at": at(1)},
            {"row_id": 8, "channel": "a", "message_id": 24, "forward_channel": "nowhere", "forward_message_id": 3, "reply_to": 999, "fetched_at": None},
            {"row_id": 9, "channel": "a", "message_id": 25, "forward_author": "someone"},
            {"row_id": 10, "channel": None, "message_id": 25, "reply_to": 1},
            {"row_id": 3, "channel": "a", "message_id": 21, "reply_to": 13, "fetched_at": at(40)},
        ],
        clash=True,
    )
    known = channels(spark, {"a": None, "b": None, None: None})
    assert rows_of(references.orphan_rows(posts, known)) == [(3, "reply_to"), (6, "forward"), (8, "forward"), (8, "reply_to")]
    report = {(r["field"], r["parent_table"], r["period"]): (r["refs"], r["keys"]) for r in references.orphan_report(posts, known).collect()}
    assert report["reply_to", "post", "2024-02"] == (2, 1) and report["forward", "channel", None] == (1, 1)
    assert references.orphan_rows(posts.limit(0), known).count() == 0
    assert {r["row_id"] for r in references.orphan_rows(posts, known.limit(0)).collect()} == {3, 6, 7, 8}


UTC = dt.timezone.utc
SPELT = [
    ("2024-05-06T07:08:09.123+02:00", dt.datetime(2024, 5, 6, 5, 8, 9, 123000, UTC)),
    ("2024-05-06T07:08:09.123456+00:00", dt.datetime(2024, 5, 6, 7, 8, 9, 123456, UTC)),
    (" 2024-05-06T07:08-04:00 ", dt.datetime(2024, 5, 6, 11, 8, tzinfo=UTC)),
    ("2024-05-06 07:08:09+0545", dt.datetime(2024, 5, 6, 1, 23, 9, tzinfo=UTC)),
    ("2024-05-06 07:08:09 +05:30", dt.datetime(2024, 5, 6, 1, 38, 9, tzinfo=UTC)),
    ("06.05.2024 07:08:09 UTC-05:00", dt.datetime(2024, 5, 6, 12, 8, 9, tzinfo=UTC)),
    ("2023-08-04 02:00:49 CEST", dt.datetime(2023, 8, 4, 0, 0, 49, tzinfo=UTC)),
    ("2023-08-04 02:00:49 MSK", dt.datetime(2023, 8, 3, 23, 0, 49, tzinfo=UTC)),
    ("20240506T070809Z", dt.datetime(2024, 5, 6, 7, 8, 9, tzinfo=UTC)),
    ("Mon, 06 May 2024 07:08:09 -0700", dt.datetime(2024, 5, 6, 14, 8, 9, tzinfo=UTC)),
    ("1714979289", dt.datetime(2024, 5, 6, 7, 8, 9, tzinfo=UTC)),
    ("1714979289123", dt.datetime(2024, 5, 6, 7, 8, 9, 123000, UTC)),
    ("1714979289123999", dt.datetime(2024, 5, 6, 7, 8, 9, 123000, UTC)),
    ("2023-08-04T10:00:00", dt.datetime(2023, 8, 4, 8, 0, tzinfo=UTC)),
    ("2023-02-04 10:00:00.5", dt.datetime(2023, 2, 4, 9, 0, 0, 500000, UTC)),
    ("2022/02/16 06:39:55", dt.datetime(2022, 2, 16, 5, 39, 55, tzinfo=UTC)),
    ("19.02.2024 13:16", dt.datetime(2024, 2, 19, 12, 16, tzinfo=UTC)),
    ("14 October 2021, 16:14:58", dt.datetime(2021, 10, 14, 14, 14, 58, tzinfo=UTC)),
    ("12. März 2022 08:12:21", dt.datetime(2022, 3, 12, 7, 12, 21, tzinfo=UTC)),
    ("4 сентября 2023 г., 08:05", dt.datetime(2023, 9, 4, 6, 5, tzinfo=UTC)),
    ("May 1, 2023 12:24:25 AM", dt.datetime(2023, 4, 30, 22, 24, 25, tzinfo=UTC)),
    ("Apr 8, 2023 12:26:40 PM", dt.datetime(2023, 4, 8, 10, 26, 40, tzinfo=UTC)),
    ("29.10.2023 02:30:00", dt.datetime(2023, 10, 29, 0, 30, tzinfo=UTC)),  # twice: the first
    ("26.03.2023 02:30:00", None),  # skipped
    ("26.03.2023 03:00:00", dt.datetime(2023, 3, 26, 1, 0, tzinfo=UTC)),
    ("2023-13-05T10:00:00Z", None), ("2024-06-31 08:00", None), ("0000-00-00 00:00:00", None), ("2024-05-06T25:00:00Z", None), ("unknown", None), ("--", None), ("", None), (None, None),
    ("yesterday at 10:15", None), ("2024-05-06T07:08:09.123Z", None), ("31 Juny 2023, 10:00:00", None), ("13:00 PM", None), ("x" * 100_000, None), ("2024-05-06 07:08:09 XYZ", None),
]


def millis(when):
    return (when - dt.datetime(1970, 1, 1, tzinfo=UTC)) // dt.timedelta(milliseconds=1)


def test_timestamps(spark, posts_of):
    posts = posts_of([{"row_id": i, "channel": "berlin", "message_id": i, "date": text} for i, (text, _) in enumerate(SPELT)], clash=True)
    link = spark.createDataFrame([(1, "nozone", ("2023-08-04T10:00:00",)), (2, "berlin", ("2023-08-04T10:00:00",)), (2, "berlin", ("2023-08-04T10:00:00",)), (3, "berlin", None), (4, "bad", ("2023-08-04T10:00:00",))], "link_id bigint, channel string, preview struct<observed_at: string>")
    zones = channels(spark, {"berlin": "Europe/Berlin", "nozone": None, "bad": "Mars/Olympus"})
    found = {(r["src"], r["src_id"]): r["utc_ms"] for r in timestamps.dirty_instants(posts, link, zones).collect()}
    want = {("post", i): millis(when) for i, (_, when) in enumerate(SPELT) if when} | {("link", 2): millis(dt.datetime(2023, 8, 4, 8, tzinfo=UTC))}
    assert found == want
    assert timestamps.dirty_instants(posts.limit(0), link.limit(0), zones).count() == 0
    assert timestamps.dirty_instants(posts, link, zones.limit(0)).count() == 13  # the first thirteen name their zone or are epochs


def test_zone_intervals_against_zoneinfo(spark):
    """Every interval list gives the offsets of the zone database itself, in all cases of folds and gaps."""
    names = ["Europe/Berlin", "America/New_York", "Asia/Kolkata", "Australia/Lord_Howe", "UTC"]
    spans = {(r["zone"], r["year"]): [(s["lo"], s["hi"], s["off"]) for s in r["spans"]] for r in timestamps.zone_intervals(spark.createDataFrame([(n,) for n in [*names, "No/Where"]], "zone string")).collect()}
    assert {z for z, _ in spans} == set(names)
    epoch = dt.datetime(1970, 1, 1)

    @settings(max_examples=300, deadline=None)
    @given(st.sampled_from(names), st.datetimes(dt.datetime(1930, 1, 1), dt.datetime(2095, 1, 1)).map(lambda d: d.replace(second=0, microsecond=0)))
    def check(name, local):
        at_micros = int((local - epoch).total_seconds()) * 10**6
        held = [off for lo, hi, off in spans.get((name, local.year), []) if lo <= at_micros < hi]
        zone = ZoneInfo(name)
        offsets = set()
        for fold in (0, 1):
            aware = local.replace(tzinfo=zone, fold=fold)
            if aware.astimezone(UTC).astimezone(zone).replace(tzinfo=None) == local:
                offsets.add(int(aware.utcoffset().total_seconds()) * 10**6)
        assert set(held) == offsets

    check()


@pytest.mark.parametrize("zone", ["Europe/Berlin", "America/New_York", "Asia/Tokyo", "Australia/Lord_Howe", "Africa/Casablanca"])
def test_years_beyond_the_list(spark, zone):
    stamps = [dt.datetime(y, m, d, 10, 30) for y in (1700, 1799, 1850, 2100, 2101, 2148, 2200, 2399, 2400, 2999, 9998) for m, d in ((1, 1), (3, 28), (7, 1), (12, 31))] + [dt.datetime(2104, 2, 29, 1, 2)]
    df = spark.createDataFrame([(i, f"{t:%Y-%m-%d %H:%M:%S}".rjust(19, "0"), zone) for i, t in enumerate(stamps)], "i int, value string, zone string")
    got = {r["i"]: r["utc_ms"] for r in timestamps.normalise_instants(df, "value", df.select("zone"), "zone").collect()}
    epoch = dt.datetime(1970, 1, 1, tzinfo=dt.timezone.utc)
    assert got == {i: (t.replace(tzinfo=ZoneInfo(zone)) - epoch) // dt.timedelta(milliseconds=1) for i, t in enumerate(stamps)}


def test_months_and_short_offsets(spark):
    texts = {"5 mai 2024, 10:00 +02": 8, "5 de mayo de 2024 10:00 Z": 10, "5 de maio de 2024, 10:00 Z": 10, "5 травня 2024 р., 10:00 Z": 10, "5 мая 2024 г., 10:00 Z": 10, "2024-05-05 10:00-0330": 13.5}
    df = spark.createDataFrame([(t, None) for t in texts], "value string, zone string")
    got = {r["value"]: r["utc_ms"] for r in timestamps.normalise_instants(df, "value", df.select("zone"), "zone").collect()}
    assert got == {t: int((dt.datetime(2024, 5, 5, tzinfo=dt.timezone.utc).timestamp() + h * 3600) * 1000) for t, h in texts.items()}


def test_findings_name_what_the_clock_does(spark):
    values = {"2024-03-31 02:30:00": "nonexistent", "2024-10-27 02:30:00": "ambiguous", "2024-06-01 02:30:00": "instant", "never": "unreadable", "2024-06-01 02:30:00 +02:00": "instant", "2024-02-31 02:30:00": "unreadable"}
    df = spark.createDataFrame([(v, "Europe/Berlin") for v in values] + [("2024-06-01 02:30:01", None)], "value string, zone string")
    got = {r["value"]: r["what"] for r in timestamps.normalise_instants(df, "value", df.select("zone"), "zone", finding="what").collect()}
    assert got == values | {"2024-06-01 02:30:01": "no_zone"}
