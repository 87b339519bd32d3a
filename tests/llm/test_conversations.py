"""Conversations: whole trees, broken ones, circles and long chains."""

from __future__ import annotations

from quaystone.llm import conversations
from tests.conftest import at, post_rows, rows_of


def post(i, reply=None, author="Ann", text="hi", **more):
    return {"row_id": i, "channel": "a", "message_id": i, "reply_to": reply, "author_name": author, "text": text, "fetched_at": at(1), **more}


def test_conversations(spark):
    rows = [
        post(1, media_count=2), post(3, 2, " bob "), post(4, 3, "ANN"), post(5, 4, "Bob"),  # whole; 2 is the album's second id
        post(10), post(11, 10, "ann "),  # one author
        post(20), post(21, 20, None),  # no author
        post(30), post(31, 30, "Bob", deleted_at=at(2)),
        post(40), post(41, 40, "Bob", "​  "),
        post(50, 999), post(51, 50, "Bob"),  # the way up is broken
        post(60, 61), post(61, 60, "Bob"), post(62, 61),  # a circle
        post(70),  # alone
        post(80, 80),  # itself
        post(91, None, "Bob"), post(90, 91),  # a reply with the smaller id
        post(100), post(101, 100, "Bob", "old", fetched_at=at(1)), {**post(101, 100, "Bob", "new", fetched_at=at(2)), "row_id": 500},
        {**post(7, None), "channel": None}, {**post(8, None), "message_id": None},
    ]
    df = post_rows(spark, rows + rows[:2], clash=True)
    found = [tuple(r) for r in conversations.conversations(df).orderBy("root_message_id", "turn").collect()]
    assert found == [
        ("a", 1, 1, 1, "opener"), ("a", 1, 3, 2, "replier"), ("a", 1, 4, 3, "opener"), ("a", 1, 5, 4, "replier"),
        ("a", 91, 91, 1, "opener"), ("a", 91, 90, 2, "replier"), ("a", 100, 100, 1, "opener"), ("a", 100, 101, 2, "replier"),
    ]
    assert rows_of(conversations.conversation_sizes(df)) == [("a", 3, 8, 4)]
    assert conversations.conversations(df.limit(0)).count() == 0


def test_long_chain_and_large_conversation(spark, monkeypatch):
    monkeypatch.setattr(conversations, "BLOCK_IDS", 16)
    chain = [post(1)] + [post(i, i - 1, "Bob" if i % 2 == 0 else "Ann") for i in range(2, 70)]
    fan = [post(1000)] + [post(i, 1000, "Bob") for i in range(1001, 1100)]
    found = conversations.conversations(post_rows(spark, chain + fan)).orderBy("root_message_id", "turn").collect()
    assert [(r["message_id"], r["turn"]) for r in found] == [(i, i) for i in range(1, 70)] + [(1000 + k, k + 1) for k in range(100)]
