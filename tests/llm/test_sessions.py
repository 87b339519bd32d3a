"""Sessions: cut at silences, kept with an answer, numbered by time, against brute force."""

from __future__ import annotations

import datetime as dt
import random

from quaystone.llm import sessions
from tests.conftest import at, post_rows, rows_of

CHANNEL = "channel string, raw_channel_id bigint, title string, subscriber_count bigint, reachability string, time_zone string"


def message(i, hours, author, reply=None, channel="a", **more):
    then = dt.datetime(2024, 1, 1) + dt.timedelta(hours=hours)
    return {"row_id": i, "channel": channel, "message_id": i, "date": f"{then:%Y-%m-%d %H:%M:%S}", "author_name": author, "reply_to": reply, "text": "hi", "fetched_at": at(50), **more}


def channels(spark, *names):
    return spark.createDataFrame([(n, None, None, None, None, "UTC") for n in names], CHANNEL)


def test_sessions(spark):
    rows = [
        message(1, 0, "Ann"), message(2, 1, " bob ", 1), message(3, 2, "Ann", 2),
        message(10, 100, "Ann"), message(11, 101, "ann", 10),  # nobody answers
        message(20, 200, "Bob"), message(21, 201, "Ann", 20), message(22, 202, "Eve"), message(23, 203, None), message(24, 203, "Eve", text=" "), message(25, 203, "Eve", deleted_at=at(60)),
        {**message(30, 0, "Ann"), "channel": None},
    ]
    df = post_rows(spark, rows + rows[:2], clash=True)
    found = [tuple(r) for r in sessions.sessions(df, channels(spark, "a")).orderBy("message_id").collect()]
    assert found == [("a", 0, 1, 1, "opener"), ("a", 0, 2, 2, "replier"), ("a", 0, 3, 3, "opener"), ("a", 2, 20, 1, "opener"), ("a", 2, 21, 2, "replier"), ("a", 2, 22, 3, "replier")]
    assert rows_of(sessions.compared(df, channels(spark, "a"))) == [("a", 2, 0, 0)]
    assert sessions.sessions(df.limit(0), channels(spark)).count() == 0 and sessions.compared(df.limit(0), channels(spark)).count() == 0


def test_against_brute_force(spark):
    draw = random.Random(2)
    rows, hours = [], 0.0
    for i in range(1, 400):
        hours += draw.choice((0.1, 0.3, 1, 2, 30)) if draw.random() > 0.05 else 200
        rows.append(message(i, hours, draw.choice(("Ann", "Bob", "Eve")), draw.choice((None, max(1, i - draw.randint(1, 3))))))
    df = post_rows(spark, rows)
    messages = sessions.timed_messages(df, channels(spark, "a")).persist()
    gap = sessions.gaps(messages).first()["gap"]
    delays = sorted(int((b["__t"] - a["__t"]) * 1000) for b in [dict(r, __t=dt.datetime.fromisoformat(r["date"]).timestamp()) for r in rows] if b["reply_to"] for a in [dict(rows[b["reply_to"] - 1], __t=dt.datetime.fromisoformat(rows[b["reply_to"] - 1]["date"]).timestamp())])
    assert gap == [d for d in delays if d > 0][int(0.9 * len([d for d in delays if d > 0]) - 1e-9)]
    number, last, want = 0, None, {}
    for r in rows:
        then = dt.datetime.fromisoformat(r["date"]).timestamp() * 1000
        number += last is not None and then - last > gap
        want[r["message_id"]], last = number, then
    assert {r["message_id"]: r["session"] for r in sessions.with_sessions(messages).collect()} == want
    mutual = {want[r["message_id"]] for r in rows if r["reply_to"] and want[r["reply_to"]] == want[r["message_id"]] and rows[r["reply_to"] - 1]["author_name"] != r["author_name"]}
    found = sessions.sessions(df, channels(spark, "a")).collect()
    assert {r["message_id"] for r in found} == {i for i, s in want.items() if s in mutual}
    for s in mutual:
        turns = sorted((r["turn"], r["message_id"]) for r in found if r["session"] == s)
        assert [t for t, _ in turns] == list(range(1, len(turns) + 1)) and [m for _, m in turns] == sorted(i for i, x in want.items() if x == s)
