"""Look-alike spellings: the consistent form, and pairs against brute force."""

from __future__ import annotations

import random
import unicodedata

from hypothesis import given, settings
from hypothesis import strategies as st

from quaystone.llm.lookalikes import CLASSES, WIDTHS, Spelling, consistent_form, look_alike_classes, look_alike_pairs, public_classes, token_finding, with_form
from tests.conftest import post_rows, rows_of


def test_consistent_form():
    cases = {
        "Ｗｉｄｅ　１２": "Wide 12", "café": "café", "no break here": "no break here", "ze​ro­wi﻿dth": "zerowidth",
        "thе сode": "the code", "нa мeсте": "на месте", "КX-12": "KX-12", "x² и x2": "x² и x2", "Straße": "Straße", "ñ ж": "ñ ж",
        "Мы собрали cор": "Мы собрали сор", "ｶﾞ": "ガ", "👩‍💻": "👩‍💻", "": "", "a\nb": "a\nb", "Ravenbus ν": "Ravenbus v",
    }
    for text, want in cases.items():
        assert consistent_form(text) == want, text
        assert consistent_form(want) == want


def test_findings():
    assert token_finding("thе") == "mixed" and token_finding("сор") == "whole" and token_finding("word") == "single" and token_finding("ж") == "single"


def disguised(text: str, draw: random.Random) -> str:
    """The text in other characters that look the same."""
    out = []
    wide = {v: k for k, v in WIDTHS.items() if len(v) == 1 and v.isascii()}
    for c in text:
        roll = draw.random()
        if roll < 0.2 and c in CLASSES:
            c = draw.choice(list(CLASSES[c].values()))
        elif roll < 0.3 and c in wide:
            c = wide[c]
        elif roll < 0.4 and c == " ":
            c = draw.choice("   ")
        elif roll < 0.45:
            c = unicodedata.normalize("NFD", c)
        if draw.random() < 0.05 and not unicodedata.combining(c[0]):
            out.append("⁠")
        out.append(c)
    return "".join(out)


WORDS = "the old thread Ravenbus про кэш сборки ещё é ñandú Größe сор КХ 21e2ac A. с a о".split()


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(WORDS), min_size=1, max_size=8), st.integers(0, 10**6))
def test_equal_looks_have_equal_forms(words, seed):
    text = " ".join(words)
    assert consistent_form(disguised(text, random.Random(seed))) == consistent_form(text)
    assert consistent_form(consistent_form(text)) == consistent_form(text)


def test_pairs_against_brute_force(spark):
    draw = random.Random(3)
    texts = [None, "", " ", "​", "​​", "a" * 60_000, "а" * 60_000]
    for i in range(30):
        base = " ".join(draw.choices(WORDS, k=3)) + str(i % 9)
        texts += [base, disguised(base, draw), base]
    df = post_rows(spark, [{"row_id": i, "text": t} for i, t in enumerate(texts)], clash=True)
    found = rows_of(look_alike_pairs(df, "row_id", "text"))
    spelling = Spelling(public_classes(spark)[0])
    form = [None if t is None else spelling.form(t) for t in texts]
    want = [(i, j) for i in range(len(texts)) for j in range(i + 1, len(texts)) if form[i] and form[i].strip() and form[i] == form[j] and texts[i] != texts[j]]
    assert found == sorted(want, key=repr)
    classes = look_alike_classes(df, "row_id", "text").collect()
    assert {r["row_id"]: r["links"] for r in classes} == {i: sum(i in pair for pair in want) for i in {i for pair in want for i in pair}}
    assert len({(r["class_id"], form[r["row_id"]]) for r in classes}) == len({r["class_id"] for r in classes}) == len({form[r["row_id"]] for r in classes})
    assert look_alike_classes(df.limit(0), "row_id", "text").count() == look_alike_pairs(df.limit(0), "row_id", "text").count() == 0
    assert with_form(df, "text", "form2").count() == len(texts)


def test_all_scripts_with_two_cases(spark):
    classes, version = public_classes(spark)
    assert version and classes.items() >= {c: classes[c] for c in CLASSES}.items()
    spelling = Spelling(classes)
    for text, want in {"օpen": "open", "аррӏе": "appie", "Ꭺpple": "Apple", "ⲟld": "old", "Հայերեն": "Հայերեն", "про кэш": "про кэш", "на сopе": "на соре", "ո": "n", "Հայերեն ո": "Հայերեն ո"}.items():
        assert spelling.form(text) == want and spelling.form(want) == want, text
    for letter, spelled in classes.items():
        assert letter in spelled.values()


def test_a_text_that_most_rows_share(spark):
    df = post_rows(spark, [{"row_id": i, "text": "сор" if i % 50 else "cop"} for i in range(500)])
    classes = look_alike_classes(df, "row_id", "text")
    assert sorted({(r["links"]) for r in classes.collect()}) == [10, 490] and classes.count() == 500
    assert look_alike_pairs(df, "row_id", "text").count() == 490 * 10
