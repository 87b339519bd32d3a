"""Leaked passages against brute force over all runs of words."""

from __future__ import annotations

import random

import pytest

from quaystone.llm.leakage import WordSearch, leaks, leaks_by_item, words_of
from tests.conftest import rows_of

ITEM = "item_id bigint, suite string, lang string, text string"


def brute(docs, items, n):
    runs = {i: {tuple(words_of(t)[k : k + n]) for k in range(len(words_of(t)) - n + 1)} for i, t in items if t}
    out = []
    for d, text in docs:
        if text:
            w = words_of(text)
            mine = {tuple(w[k : k + n]) for k in range(len(w) - n + 1)}
            out += [(d, i) for i, r in runs.items() if r & mine]
    return sorted(out, key=repr)


def test_leaks_against_brute_force(spark):
    draw = random.Random(5)
    vocabulary = "the le слой layout engine resets 15 cache que wenn x".split()
    items = [(i, " ".join(draw.choices(vocabulary, k=draw.randint(8, 30)))) for i in range(40)] + [(40, None), (41, ""), (42, "too short"), (43, "The Layout, engine’s")]
    items.append((44, items[3][1]))
    docs = [(None, "x"), (0, None), (1, ""), (2, "x" * 100_000)]
    for d in range(3, 120):
        text = " ".join(draw.choices(vocabulary, k=draw.randint(0, 40)))
        if d % 3 == 0:
            w = words_of(draw.choice(items[:40])[1])
            a = draw.randint(0, max(0, len(w) - 12))
            text += " — " + ",\n".join(x.upper() for x in w[a : a + draw.randint(11, 14)]) + "! " + text
        docs.append((d, text))
    document = spark.createDataFrame([(d, t, "x", "y") for d, t in docs + docs[-5:]], "doc_id bigint, text string, item_id string, __text string")
    item = spark.createDataFrame([(i, "s", "en", t) for i, t in items], ITEM)
    want = brute(docs, items, 12)
    assert want and rows_of(leaks(document, item)) == want
    assert rows_of(leaks(document, item, block=7)) == want  # in blocks of items
    assert leaks(document, item.limit(0)).count() == 0 and leaks(document.limit(0), item).count() == 0
    assert sum(r["documents"] for r in leaks_by_item(document, item).collect()) == len(want)


def test_many_items_in_many_tables(spark, monkeypatch):
    from quaystone.llm import leakage

    monkeypatch.setattr(leakage, "HELD", 2000)
    items = spark.range(3000).selectExpr("id as item_id", "'s' as suite", "'en' as lang", "concat_ws(' ', transform(sequence(1, 14), k -> concat('w', id * 20 + k))) as text")
    docs = spark.range(200).selectExpr("id as doc_id", "concat_ws(' ', 'before', concat_ws(' ', transform(sequence(3, 14), k -> concat('W', id * 300 + k))), 'after') as text")
    want = [(i, i * 15) for i in range(200)]
    assert rows_of(leaks(docs, items, block=100)) == sorted(want, key=repr)


def test_words_and_bounds():
    assert words_of("Café, L'été 4.5_x") == ["café", "l", "été", "4", "5", "x"]
    with pytest.raises(ValueError):
        WordSearch([(1, "a b c")], 3)
